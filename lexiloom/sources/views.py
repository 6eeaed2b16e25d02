"""The engine's tables over the driver's star schema, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.chunks import sliding_chunks
from lexiloom.schema import file_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text as files."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), "doc_id", F.lit(".md"))
    return d.select("doc_id", path.alias("rel_path"), F.col("lang").alias("language"), file_hash(F.col("text")).alias("hash"), F.octet_length("text").alias("size"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str, size: int = 5, overlap: int = 1) -> DataFrame:
    return sliding_chunks(files(spark, sf_dir), size, overlap)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat('fn_', p_partkey % 97) AS name", "cast(p_size % 11 AS int) AS kind", "concat(p_brand, '/', p_type) AS rel_path",
        "cast(p_partkey % 50 * 20 + 1 AS int) AS start_line", "cast(p_partkey % 50 * 20 + 20 AS int) AS end_line", "p_name AS signature",
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("source_id"))  # noqa: E741
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "concat(p_brand, '/', p_type) AS rel_path")
    return l.join(p, "l_partkey").selectExpr(
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS id", "source_id", "concat('fn_', l_partkey % 131) AS target_name",
        "cast(l_linenumber % 4 AS int) AS kind", "rel_path", "cast(l_orderkey % 1000 + 1 AS int) AS line",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream: file, order, whether it is a deletion, and a payload hash."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS file", "ts", "event_id", "event_type = 'error' AS deleted", "substr(sha2(coalesce(props, ''), 256), 1, 16) AS payload")


FILES = """v_files AS (SELECT doc_id, concat(source, '/', lang, '/doc', doc_id, '.md') AS rel_path, lang AS language, substr(sha256(text), 1, 16) AS hash,
  strlen(text) AS size, text AS content FROM documents WHERE text IS NOT NULL)"""
LINES = r"""v_split AS (SELECT *, CASE WHEN content = '' THEN [] ELSE list_transform(string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)),
  lambda x: regexp_replace(x, '\r$', '')) END AS lines FROM v_files)"""


def chunks_sql(size: int = 5, overlap: int = 1) -> str:
    step = size - overlap
    return f"""{FILES}, {LINES},
v_pos AS (SELECT *, len(lines) AS n, unnest(generate_series(0, CASE WHEN len(lines) = 0 THEN -1 WHEN len(lines) <= {size} THEN 0 ELSE CAST(ceil((len(lines) - {size}) / {step}.0) AS BIGINT) END)) * {step} AS pos FROM v_split),
v_chunks AS (SELECT concat(hash, ':', rel_path, ':', pos + 1, '-', least(pos + {size}, n)) AS id, doc_id, rel_path, language, CAST(pos + 1 AS INTEGER) AS start_line,
  CAST(least(pos + {size}, n) AS INTEGER) AS end_line, array_to_string(lines[pos + 1 : pos + {size}], chr(10)) AS content, hash AS file_hash FROM v_pos)"""


VECTORS = "v_vec AS (SELECT vec_id AS chunk_id, label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
SYMBOLS = """v_symbols AS (SELECT p_partkey AS id, concat('fn_', p_partkey % 97) AS name, CAST(p_size % 11 AS INTEGER) AS kind, concat(p_brand, '/', p_type) AS rel_path,
  CAST(p_partkey % 50 * 20 + 1 AS INTEGER) AS start_line, CAST(p_partkey % 50 * 20 + 20 AS INTEGER) AS end_line, p_name AS signature FROM part)"""
REFS = """v_refs AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS id, source_id, concat('fn_', l_partkey % 131) AS target_name,
  CAST(l_linenumber % 4 AS INTEGER) AS kind, concat(p_brand, '/', p_type) AS rel_path, CAST(l_orderkey % 1000 + 1 AS INTEGER) AS line
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS source_id FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey)"""
CHANGES = "v_changes AS (SELECT user_id AS file, ts, event_id, event_type = 'error' AS deleted, substr(sha256(coalesce(props, '')), 1, 16) AS payload FROM events)"
