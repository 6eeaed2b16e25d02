"""The four query verbs over tables of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.operators import graph, tables
from lexiloom.operators import search as ranking
from lexiloom.operators.grep import clamp, grep


def search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], mode: str = "hybrid", limit: int | None = 25, path: str = "", compat: bool = False, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """mode grep gives grep's rows in the shape of a search; anything else is the hybrid search."""
    if mode == "grep":
        return grep(chunks, query, limit, path=path, compat=compat).drop("matches")
    return ranking.hybrid(chunks, vectors, query, query_vector, clamp(limit), path, compat, index)


def percent(found: DataFrame) -> DataFrame:
    """Scores as percent of the best of what was found."""
    return found.withColumn("score", 100 * F.col("score") / F.max("score").over(W.partitionBy())).orderBy(F.desc("score"), "id")


class Engine:
    """An index of tables in one folder: chunks, vectors, symbols, refs, each partitioned by branch."""

    def __init__(self, spark, path: str, branch: str = "main", embed=None):
        self.spark, self.path, self.branch, self.embed = spark, path, branch, embed

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, f"{self.path}/{name}").filter(F.col("branch") == self.branch)

    def search(self, query: str, limit: int = 25, path: str = "", mode: str = "hybrid") -> DataFrame:
        vector = self.embed([query])[0] if mode != "grep" else []
        return percent(search(self.table("chunks"), self.table("vectors"), query, vector, mode, limit, path, index=(self.table("postings"), self.table("lengths"))))

    def grep(self, query: str, **how) -> DataFrame:
        return percent(grep(self.table("chunks"), query, **how))

    def symbol_info(self, name: str, path: str = "") -> DataFrame:
        symbols = self.table("symbols")
        return graph.formatted(graph.symbol_info(symbols, graph.resolve(self.table("refs"), symbols), name, path))

    def find_imports(self, part: str) -> DataFrame:
        return graph.imports(self.table("symbols"), part)

    def list_files(self) -> DataFrame:
        return self.table("chunks").select("rel_path").distinct().orderBy("rel_path")

    def stats(self) -> DataFrame:
        return self.table("chunks").agg(F.count("*").alias("chunks"), F.countDistinct("rel_path").alias("files"))
