"""What the operators share: tables, the shared folder, and keys without hot spots."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.arrow import mapped, slices  # noqa: F401
from lexiloom.filters import filter_of, with_hit
from lexiloom.storage import shared_dir  # noqa: F401

#: Rows of a key are spread over so many salts where one key may hold a third of all rows.
SALTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, lost executors cost nothing that is done, and the shuffle files of what was written go at once."""
    path = shared_dir(df.sparkSession)
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def held(doc_id: str, modulus: int, left: int) -> Column:
    """Whether a document is held out by that remainder; a null id is not."""
    return F.coalesce(remainder(doc_id, modulus) == left, F.lit(False))


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in dropped. Only rows that hit a filter of the dropped keys are shuffled."""
    met = with_hit(rows, filter_of(dropped, key), key)
    return met.filter("not _hit").drop("_hit").unionByName(met.filter("_hit").drop("_hit").join(dropped.select(key), key, "left_anti"))
