"""Building and renewing an index: files to chunks, vectors, symbols and references, each table kept as versions of parts by path; and the steps by which an index is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.patterns import ignore_regex
from lexiloom.operators import tables
from lexiloom.operators.embed import embedded, hashing
from lexiloom.operators.extract import extract_refs, extract_symbols
from lexiloom.operators.search import document_lengths, postings
from lexiloom.operators.structural import structural_chunks
from lexiloom.schema import FORMAT_VERSION
from lexiloom.storage import shared_dir

NAMES = ("chunks", "vectors", "symbols", "refs", "postings", "lengths")


def built(files: DataFrame, embed=None, size: int = 50, overlap: int = 10) -> dict[str, DataFrame]:
    """The tables of a listing of files (branch, file_path, rel_path, language, hash, content). Postings are stored sorted by term, so a search reads the row groups of its terms."""
    where = files.select("branch", "file_path", "rel_path")
    chunks = structural_chunks(files, size, overlap).join(where, "rel_path")
    place = chunks.select("id", "branch", "rel_path")
    own = {"chunks": chunks.drop("strategy"), "vectors": embedded(chunks, embed or hashing()).join(place.withColumnRenamed("id", "chunk_id"), "chunk_id")}
    own |= {"symbols": extract_symbols(files).join(where, "rel_path"), "refs": extract_refs(files).join(where, "rel_path")}
    return own | {"postings": postings(chunks).join(place, "id"), "lengths": document_lengths(chunks).join(place, "id")}


#: Postings lie sorted by this column in each part.
ORDER = {"postings": "term"}


def _touched(paths: DataFrame) -> list[int]:
    """The parts in which rows with these paths lie: tables.PARTS at most."""
    return [r[0] for r in paths.select(tables.part_of().alias("part")).distinct().collect()]


def index_all(files: DataFrame, path: str, embed=None) -> None:
    for name, rows in built(files, embed).items():
        tables.overwrite_parts(rows, f"{path}/{name}", by=ORDER.get(name))


def index_changed(spark: SparkSession, files: DataFrame, path: str, embed=None) -> DataFrame:
    """Renews only what differs by content hash, and drops what is gone; returns the changes (rel_path, change). Only the parts in which changed files lie are read and written again.

    The changes are written to the shared folder once and stay a table; if there are none, nothing else is written.
    """
    old = tables.read(spark, f"{path}/chunks").select("rel_path", F.col("file_hash").alias("hash")).distinct()
    at = shared_dir(spark)
    tables.snapshot_diff(old, files.filter("content <> ''")).write.parquet(at)
    diff = spark.read.schema("rel_path string, change string").parquet(at)
    if diff.isEmpty():
        return diff
    renewed = files.join(diff.filter("change <> 'deleted'").select("rel_path"), "rel_path", "left_semi")
    parts = _touched(diff)
    for name, rows in built(renewed, embed).items():
        tables.renew(spark, f"{path}/{name}", parts, lambda old, rows=rows: tables.delete_paths(old, diff).unionByName(rows), ORDER.get(name))
    return diff


def refs_missing(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """The second phase: files that have chunks but neither symbols nor references yet, as after a run that stopped between; their symbols and references are added and the files returned."""
    have = tables.read(spark, f"{path}/symbols").select("rel_path").union(tables.read(spark, f"{path}/refs").select("rel_path")).distinct()
    chunked = tables.read(spark, f"{path}/chunks").select("rel_path").distinct()
    left = files.join(chunked, "rel_path", "left_semi").join(have, "rel_path", "left_anti")
    at = shared_dir(spark)
    left.select("rel_path").write.parquet(at)
    gap = spark.read.schema("rel_path string").parquet(at)
    if not gap.isEmpty():
        own = files.join(gap, "rel_path", "left_semi")
        where = own.select("branch", "file_path", "rel_path")
        for name, rows in (("symbols", extract_symbols(own)), ("refs", extract_refs(own))):
            new = rows.join(where, "rel_path")
            tables.renew(spark, f"{path}/{name}", _touched(gap), lambda old, new=new: tables.delete_paths(old, gap).unionByName(new), ORDER.get(name))
    return gap


def ignore_changed(spark: SparkSession, path: str, before: tuple[str, ...], after: tuple[str, ...]) -> bool:
    """What a change of ignore rules asks for: rows of files that are ignored now are dropped at once; true if some files are no longer ignored, so that the tree has to be read again."""
    hidden = F.col("rel_path").rlike(ignore_regex(after))
    for name in NAMES:
        parts = _touched(tables.read(spark, f"{path}/{name}").filter(hidden))
        if parts:
            tables.renew(spark, f"{path}/{name}", parts, lambda old: old.filter(~hidden), ORDER.get(name))
    return not set(before) <= set(after)


def start(spark: SparkSession, files: DataFrame, path: str, sha: str = "", seeds: dict[str, str] | None = None, embed=None, cancelled=lambda: False) -> str:
    """Brings an index up to date by the cheapest step that will do, and says which: ``current`` (the commit is the one that is noted), ``incremental`` (there is an
    index), ``seeded`` (another branch's index is copied, then renewed), ``full``; ``cancelled`` where the caller said so between two steps. seeds: branch and path of other indexes.

    A run that stops leaves the last complete version of each table; the next start finds by hashes what is missing.
    """
    meta = f"{path}/meta"
    noted = tables.read(spark, meta, "key string, value string")
    known = {r["key"]: r["value"] for r in noted.collect()}  # a handful of keys
    complete = all(tables.versions(spark, f"{path}/{n}") for n in NAMES)
    if complete and sha and known.get("commit_sha") == sha and known.get("format") == FORMAT_VERSION:
        return "current"
    how = "incremental" if complete and known.get("format") == FORMAT_VERSION else "full"
    sources = {b: p for b, p in (seeds or {}).items() if all(tables.versions(spark, f"{p}/{n}") for n in NAMES)}
    if how == "full" and sources:
        sized = [(b, tables.read(spark, f"{p}/chunks").count(), "commit_sha" in {r["key"] for r in tables.read(spark, f"{p}/meta", "key string, value string").collect()}, k) for k, (b, p) in enumerate(sources.items())]
        best = tables.pick_source(spark.createDataFrame(sized, "branch string, records long, has_sha boolean, ord int")).first()["branch"]
        branch = files.select("branch").first()["branch"]
        for name in NAMES:
            tables.overwrite_parts(tables.read(spark, f"{sources[best]}/{name}").withColumn("branch", F.lit(branch)), f"{path}/{name}", by=ORDER.get(name))
        how = "seeded"
    if cancelled():
        return "cancelled"
    index_all(files, path, embed) if how == "full" else index_changed(spark, files, path, embed)
    if cancelled():
        return "cancelled"
    refs_missing(spark, files, path)
    for key, value in (("format", FORMAT_VERSION), ("commit_sha", sha)):
        noted = tables.set_meta(noted, key, value)
    tables.overwrite(noted, meta)
    return how
