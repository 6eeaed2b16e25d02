"""Files to lines to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.schema import chunk_id


def lines_of(content: Column) -> Column:
    """Lines without \\r; a final newline begins no line; the empty text has none."""
    body = F.regexp_replace(content, r"\n\z", "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r$", "")))


def window(size: int, overlap: int) -> tuple[int, int]:
    """Sane settings: 50 lines if none are given, an overlap below the size."""
    size = size if size > 0 else 50
    overlap = max(0, overlap)
    return size, size // 4 if overlap >= size else overlap


def sliding_chunks(files: DataFrame, size: int = 50, overlap: int = 10) -> DataFrame:
    """Windows of lines over each file; the last one that reaches the end is the last. Generated in the JVM, no shuffle."""
    size, overlap = window(size, overlap)
    step = max(1, size - overlap)
    n = F.size("lines")
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(float(step))) + 1).cast("int")
    at = files.withColumn("lines", lines_of(F.col("content"))).withColumn("n", n).withColumn("count", count).filter("count > 0")
    at = at.withColumn("pos", F.explode(F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: i * step)))
    start, end = F.col("pos") + 1, F.least(F.col("pos") + size, F.col("n"))
    keep = [c for c in ("doc_id", "branch") if c in files.columns]
    return at.select(
        chunk_id(F.col("hash"), F.col("rel_path"), start, end).alias("id"), *keep, "rel_path", "language", start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
        F.array_join(F.slice("lines", start, size), "\n").alias("content"), F.col("hash").alias("file_hash"),
    )
