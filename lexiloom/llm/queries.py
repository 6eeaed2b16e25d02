"""The registered queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of powers of two, with the bucket (log2 of the length) that each piece goes to. Null and empty texts are one piece, the end id."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the documents that are not held out, applied to all. A null doc_id is not held out; a null lang teaches nothing."""
    from .language_id import fit_languages, predict_languages

    docs = table(spark, sf_dir, "documents")
    held_out = held("doc_id", 4, 2)
    return predict_languages(docs, fit_languages(docs.filter(~held_out)), keep={"held_out": held_out})


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the labels of documents that are not held out, applied to all. A null doc_id is not held out and has no label."""
    from .quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    held_out = held("doc_id", 5, 0)
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out)), keep={"held_out": held_out})


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document; null and empty texts have none."""
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays and the hash of its normalised text."""
    from .exact_dedup import exact_dedup, normal_text

    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(normal_text(F.col("text")), 256)})


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items in it (item_ids) and the least distance at which one occurs; none for null and empty texts."""
    from .decontaminate import find_items

    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"), F.col("hits.item_id").alias("item_ids"), F.array_min("hits.distance").alias("distance"))


def op7_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents to a new folder of the shared one and reads them back; a null text is the end id alone, a null doc_id comes first."""
    from .common import shared_dir
    from .rans_store import read_ids, write_ids

    path = shared_dir(spark)
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component; texts without words have the fingerprint zero."""
    from .simhash import simhash_classes

    rows = simhash_classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the documents that are not held out, applied to all. A null doc_id is not held out."""
    from .bloom_lm import score_texts

    docs = table(spark, sf_dir, "documents")
    held_out = held("doc_id", 7, 2)
    return score_texts(docs, ~held_out, keep={"held_out": held_out})


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of a table of pages (which has none): a quarter of the hosts is listed on some day, of these
    half are taken off later, of these half come back; a sixteenth of the hosts has its /fr/ pages listed; two domains are listed for a time."""
    from .url_filter import host_of

    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().withColumn("m", F.md5("host"))
    number = lambda a, n: F.conv(F.substring("m", a, n), 16, 10).cast("int")
    first = F.date_add(F.lit("2024-01-01").cast("date"), number(3, 2) % 200)
    off = F.date_add(first, 30 + number(5, 1) * 5)
    own = hosts.filter(number(1, 1) < 4)
    parts = [
        own.select(F.col("host").alias("entry"), F.lit("add").alias("action"), first.alias("day")),
        own.filter(number(2, 1) < 8).select("host", F.lit("remove"), off),
        own.filter(number(2, 1) < 4).select("host", F.lit("add"), F.date_add(off, 60)),
        hosts.filter(number(1, 1) == 15).select(F.concat("host", F.lit("/fr/")), F.lit("add"), F.lit("2024-05-01").cast("date")),
        pages.sparkSession.sql("""SELECT entry, action, CAST(day AS DATE) AS day FROM VALUES ('example.org', 'add', '2024-02-01'), ('example.org', 'remove', '2024-04-01'), ('example.org', 'add', '2024-09-01'), ('example.net', 'add', '2024-06-15'), ('example.net', 'remove', '2024-07-15') AS t(entry, action, day)"""),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no day of capture: it is taken from page_id, through the year 2024."""
    from .url_filter import filter_urls

    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    out = filter_urls(pages, list_changes(pages), day)
    return out.withColumn("fetch_day", F.col("fetch_day").cast("string"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, row_number() OVER () AS r, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetch_day,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
    string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/') AS parts
  FROM pages),
h AS (SELECT DISTINCT host, md5(host) AS m FROM p WHERE host <> ''),
n AS (SELECT host, ('0x' || m[1])::INT AS n1, ('0x' || m[2])::INT AS n2, DATE '2024-01-01' + ('0x' || m[3:4])::INT % 200 AS first, 30 + ('0x' || m[5])::INT * 5 AS stay FROM h),
changes AS (
  SELECT host AS entry, 'add' AS action, first AS day FROM n WHERE n1 < 4
  UNION ALL SELECT host, 'remove', first + stay FROM n WHERE n1 < 4 AND n2 < 8
  UNION ALL SELECT host, 'add', first + stay + 60 FROM n WHERE n1 < 4 AND n2 < 4
  UNION ALL SELECT host || '/fr/', 'add', DATE '2024-05-01' FROM n WHERE n1 = 15
  UNION ALL VALUES ('example.org', 'add', DATE '2024-02-01'), ('example.org', 'remove', DATE '2024-04-01'), ('example.org', 'add', DATE '2024-09-01'), ('example.net', 'add', DATE '2024-06-15'), ('example.net', 'remove', DATE '2024-07-15')),
spans AS (SELECT entry, day AS since, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until, action FROM changes),
keys AS (
  SELECT DISTINCT r, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    CASE WHEN len(parts) > 1 THEN list_transform(range(1, len(parts)), lambda i: host || array_to_string(parts[1:i], '/') || '/') ELSE [] END)) AS key
  FROM p WHERE host <> '')
SELECT p.page_id, CAST(p.fetch_day AS VARCHAR) AS fetch_day, count(s.entry) > 0 AS blocked, count(s.entry) AS n_entries, min(s.entry) AS entry
FROM p LEFT JOIN keys k ON k.r = p.r LEFT JOIN spans s ON s.entry = k.key AND s.action = 'add' AND p.fetch_day >= s.since AND (s.until IS NULL OR p.fetch_day < s.until)
GROUP BY p.r, p.page_id, p.fetch_day
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_language_id, op3_quality, op4_token_counts, op5_exact_dedup, op6_decontamination, op7_binary_ids, op8_simhash, op9_lm_scores, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op10_url_filter": OP10_SQL}
