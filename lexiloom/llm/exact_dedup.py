"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by the length of their normalised text and a hash of its first bytes; a text
is hashed as a whole only where that pair occurs again, and only equal hashes are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, filter_of, stored, with_hit

def normal_text(text: Column) -> Column:
    """Runs of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = 96, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the carry expressions over the input's columns.

    Texts are equal when their normalised forms are. Of equal texts the row with the smallest
    doc_id stays (kept); a null doc_id sorts behind the others, and of rows that also agree in
    doc_id exactly one stays. Null counts as the empty text. An empty table gives an empty one.

    No text is shuffled. The first pass sets bits of a filter of bounded size for the pairs that
    occur again; the second hashes the texts that hit it (a false hit only costs a hash) and
    writes narrow rows. Groups are summed over (group, salt) first, so a group of any size
    is spread over SALTS tasks both when it is counted and when its rows get the result.
    """
    body = normal_text(F.col(text))
    size, head = F.octet_length(body).cast("long"), F.xxhash64(F.substring(body, 1, prefix))
    pairs = docs.select(size.alias("_size"), head.alias("_head")).groupBy("_size", "_head").agg(F.count("*").alias("_n"))
    maps = filter_of(pairs.filter("_n > 1"), "_size", "_head")

    extra = carry or {}
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("_size"), head.alias("_head"), body.alias("_body"), *[c.alias(f"_carry_{k}") for k, c in extra.items()])
    rows = with_hit(rows, maps, "_size", "_head").select(
        "doc_id", "_size", "_head", F.monotonically_increasing_id().alias("_row"),
        F.when(F.col("_hit"), F.unhex(F.sha2(F.col("_body"), 256))).alias("_full"), *[f"_carry_{k}" for k in extra],
    )
    rows = stored(rows).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))

    key = ["_size", "_head", "_full"]
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    parts = rows.filter("_full is not null").groupBy(*key, "_salt").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    whole = parts.groupBy(*key).agg(F.min("_first").alias("_keep"), F.sum("_n").alias("_all")).filter("_all > 1")
    groups = parts.select(*key, "_salt").join(whole, key)
    out = [F.col(f"_carry_{k}").alias(k) for k in extra]
    grouped = rows.filter("_full is not null").join(groups, [*key, "_salt"], "left")
    alone = rows.filter("_full is null")
    return grouped.select(
        "doc_id", F.when(F.col("_keep").isNull(), F.col("doc_id")).otherwise(F.col("_keep.id")).alias("keep_id"),
        F.coalesce("_all", F.lit(1)).alias("group_size"), F.coalesce(F.col("_keep.row") == F.col("_row"), F.lit(True)).alias("kept"), *out,
    ).unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *out))
