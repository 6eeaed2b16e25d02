"""Keeping an index up to date from a stream of changes (file, ts, event_id, deleted, payload)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.tables import overwrite, read

STATE = "file long, ts timestamp, event_id long, deleted boolean, payload string"


def merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The last change of each file over what is known and what came; deletions stay as marks, so late changes lose against them. A batch that is seen twice changes nothing."""
    order = F.struct("ts", "event_id")
    last = state.unionByName(batch).groupBy("file").agg(F.max_by(F.struct("ts", "event_id", "deleted", "payload"), order).alias("x"))
    return last.select("file", "x.*")


#: Parts of the state by a hash of the file; a batch rewrites those that it touches.
PARTS = 16


def part_of(file: Column) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(PARTS)).cast("int")


def watch(changes: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: int = 60) -> StreamingQuery:
    """Merges each batch of a streaming DataFrame into the state at path, which lies in PARTS tables of versions (see tables.overwrite). once: takes what is there and ends.

    A batch that is interrupted is run again by the stream; parts that it had already written then change no more.
    """
    spark = changes.sparkSession

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.select("file", "ts", "event_id", "deleted", "payload").withColumn("part", part_of(F.col("file"))).persist()
        try:
            for (k,) in batch.select("part").distinct().orderBy("part").collect():  # at most PARTS
                own = f"{path}/part={k}"
                overwrite(merged(read(spark, own, STATE), batch.filter(F.col("part") == k).drop("part")).coalesce(1), own)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """All parts; a part that no batch has touched is empty."""
    return reduce(DataFrame.unionByName, [read(spark, f"{path}/part={k}", STATE) for k in range(PARTS)])


def live(spark: SparkSession, path: str) -> DataFrame:
    return current(spark, path).filter("not deleted").select("file", "payload")
