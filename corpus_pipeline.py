"""A training-data pipeline over the documents table.

Five stages, each an operator of lexiloom.llm: low quality goes, exact copies go, near copies go, texts
that hold benchmark items go, and what is left is cut into training sequences. Each stage reads all its
predecessor kept, as Parquet. All but the last return the columns of documents, whatever else is among them.
Rows with null columns, empty tables and repeated rows pass through every stage; a stage that must tell equal rows apart numbers them itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import stored, table, without
from lexiloom.llm.decontaminate import find_items
from lexiloom.llm.exact_dedup import exact_dedup
from lexiloom.llm.packing import pack
from lexiloom.llm.quality import fit_quality, rated
from lexiloom.llm.simhash import near_copies


def whole_row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, fitted on the labels of this input, predicts to be good. Null and empty texts are judged like any other."""
    forest = fit_quality(docs, table(spark, sf_dir, "labels"))
    return rated(docs.select(whole_row(docs).alias("doc")), forest, "doc.text").filter("predicted = 1").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the row with the smallest doc_id stays; all null and empty texts are one group."""
    return exact_dedup(docs, carry={"doc": whole_row(docs)}).filter("kept").select("doc.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by SimHash fingerprints and by sets of shingles, the document with the smallest doc_id stays (null last). Texts without words are copies of each other."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs).alias("doc")))
    groups = near_copies(rows.select("row", F.col("doc.text").alias("text")), doc_id="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    ids = rows.select("row", F.col("doc.doc_id").alias("id"))
    groups = stored(ids.join(groups, "row"))
    stays = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row"))["row"].alias("row"))
    dropped = groups.select("row").join(stays.select("row"), "row", "left_anti")
    return without(rows, stored(dropped), "row").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item occurs within its error budget; null and empty texts hold none."""
    found = find_items(docs.select(whole_row(docs).alias("doc")), table(spark, sf_dir, "benchmark"), text="doc.text")
    return found.filter(F.size("hits") == 0).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their tokens; a null or empty text is one sequence of the end id."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
