"""Changes of the index tables, as plans that give the table after the change, and tables kept as versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_chunks(old: DataFrame, new: DataFrame, vectors: DataFrame) -> DataFrame:
    """Only chunks that have a vector are written."""
    return upsert(old, new.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_semi"))


def delete_paths(rows: DataFrame, paths: DataFrame, column: str = "rel_path") -> DataFrame:
    return rows.join(paths.select(column), column, "left_anti")


def replace_files(old: DataFrame, new: DataFrame, column: str = "rel_path") -> DataFrame:
    """All rows of the files that occur in new are replaced."""
    return delete_paths(old, new.select(column).distinct(), column).unionByName(new)


def prune(rows: DataFrame, present: DataFrame, column: str = "rel_path") -> DataFrame:
    """Rows of files that are still there."""
    return rows.join(present.select(column).distinct(), column, "left_semi")


def seed(source: DataFrame, changed: DataFrame, branch: str) -> DataFrame:
    """Another branch's rows without the files that differ."""
    return delete_paths(source, changed).withColumn("branch", F.lit(branch))


def pick_source(candidates: DataFrame) -> DataFrame:
    """The branch to seed from: most records, then one with a commit, then the order they were given in."""
    return candidates.orderBy(F.desc("records"), F.desc("has_sha"), "ord").limit(1)


def set_meta(old: DataFrame, key: str, value: str) -> DataFrame:
    spark = old.sparkSession
    return upsert(old, spark.createDataFrame([(key, value)], "key string, value string"), "key")


def cleared(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """rel_path and change: added, modified or deleted, from two listings (rel_path, hash)."""
    both = old.select("rel_path", F.col("hash").alias("was")).join(new.select("rel_path", F.col("hash").alias("now")), "rel_path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return both.select("rel_path", change.alias("change")).filter("change is not null")


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each file of a change stream; deleted files are gone."""
    last = changes.groupBy("file").agg(F.max_by(F.struct("deleted", "payload"), F.struct("ts", "event_id")).alias("x"))
    return last.select("file", "x.*").filter("not deleted").drop("deleted")


def same_multiset(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: equal, whether both have the same rows as often."""
    x, y = a.groupBy(*columns).agg(F.count("*").alias("n")), b.groupBy(*columns).agg(F.count("*").alias("n"))
    return x.exceptAll(y).unionByName(y.exceptAll(x)).agg((F.count("*") == 0).alias("equal"))


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


#: Parts by a hash of the path of tables that are renewed in part.
PARTS = 64


def part_of(column: str = "rel_path") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """Number, parts (a bit each; 0: the table is not in parts) and folder of the versions that are complete, the newest first."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return []
    found = [x.getPath().getName() for x in fs.listStatus(at(path)) if x.getPath().getName().startswith("v=")]
    numbered = [(int(n[2:].split("-")[0]), int(n.partition("-")[2] or "0", 16), f"{path}/{n}") for n in found if fs.exists(at(f"{path}/{n}/_SUCCESS"))]
    return sorted(numbered, reverse=True)


def _state(known: list[tuple[int, int, str]], parts=range(PARTS)) -> dict[str, set[int]]:
    """The versions a table consists of, and the parts that each still gives: a part is in the newest version that wrote it."""
    left, out = set(parts), {}
    for _, mask, folder in known:
        own = {k for k in left if mask >> k & 1} if mask else set(left)
        if own:
            out[folder] = own
        left -= own
    return out


def _dropped(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes the versions that none of the newest ``keep`` states of a table needs."""
    known = _versions(spark, path)
    needed = {folder for k in range(min(keep, len(known))) for folder in _state(known[k:])}
    fs, at = _files(spark, path)
    for _, _, folder in known:
        if folder not in needed:
            fs.delete(at(folder), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that are complete, the newest first: a version counts once Spark has marked its folder as done."""
    return [n for n, _, _ in _versions(spark, path)]


def overwrite(rows: DataFrame, path: str, keep: int = 2) -> None:
    """Writes a new version of the table beside the last ones (path/v=N) and drops what the newest ``keep`` do not need.

    Nothing is renamed: whenever a run stops, the last complete version is what readers find, and a half-written one is no version. rows may read from the
    table. A reader that has opened a version can read it until ``keep`` more have been written.
    """
    spark = rows.sparkSession
    known = versions(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/v={known[0] + 1 if known else 0}")
    _dropped(spark, path, keep)


def overwrite_parts(rows: DataFrame, path: str, parts=range(PARTS), column: str = "rel_path", by: str | None = None, keep: int = 2) -> None:
    """Writes a new version of some parts (path/v=N-PARTS, a bit a part): rows are all their rows, other parts stay where they are. The first version has to be of all parts.

    by: within a part the rows are sorted and cut into files by this column. A part takes as many tasks as shuffle partitions are left for it.
    """
    spark, parts = rows.sparkSession, sorted(parts)
    known = versions(spark, path)
    number = known[0] + 1 if known else 0
    folder = f"{path}/v={number}-{sum(1 << k for k in parts):x}"
    fs, at = _files(spark, path)
    fs.delete(at(folder), True)  # what a run that stopped has left
    spark.createDataFrame([], rows.schema).write.parquet(f"{folder}/schema")  # a table without rows has one too
    placed = rows.withColumn("part", part_of(column))
    if by:
        placed = placed.repartitionByRange("part", by).sortWithinPartitions("part", by)
    else:
        spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(parts)))
        placed = placed.repartition("part", F.pmod(F.xxhash64(column, F.lit("file")), F.lit(spread)))
    placed.write.mode("append").partitionBy("part").parquet(folder)
    _dropped(spark, path, keep)


def renew(spark: SparkSession, path: str, parts, change, by: str | None = None) -> None:
    """Replaces the rows of some parts by what change makes of them; it must move no row to another part. A table that is not in parts yet is rewritten whole, in parts."""
    known = _versions(spark, path)
    if known and not known[0][1]:
        parts = range(PARTS)
    overwrite_parts(change(read(spark, path, parts=parts)), path, parts, by=by)


def read(spark: SparkSession, path: str, schema: str | None = None, parts=range(PARTS)) -> DataFrame:
    """The newest version of a table, or some parts of it; an empty one of the schema where there is none yet."""
    known = _versions(spark, path)
    if not known and schema:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read
    if not known or not known[0][1]:
        return reader.parquet(known[0][2] if known else f"{path}/v=0")
    fs, at = _files(spark, path)
    folders = [str(x.getPath()) for folder, own in _state(known, parts).items() for x in fs.listStatus(at(folder)) if x.getPath().getName() in {f"part={k}" for k in own}]
    kind = spark.read.parquet(f"{known[0][2]}/schema").schema
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)
