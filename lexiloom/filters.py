"""Filters of keys: bit arrays of a fixed size, broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filters below: 1,024 maps of 4 KB, whatever the input; that is what is broadcast.
FILTER_BITS, _MAP_BITS = 1 << 25, 1 << 15


def filter_of(keys: DataFrame, *columns: str) -> DataFrame:
    """A bit array over the hashes of some columns: rows _map and _bits."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    return keys.select(bit.alias("_bit")).groupBy(F.expr(f"_bit div {_MAP_BITS}").alias("_map")).agg(F.expr(f"bitmap_construct_agg(_bit % {_MAP_BITS})").alias("_bits"))


def with_hit(rows: DataFrame, maps: DataFrame, *columns: str) -> DataFrame:
    """Adds _hit: false only if the columns' values are not among the filter's keys."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    byte = F.expr(f"conv(hex(substring(_bits, cast((_bit % {_MAP_BITS}) div 8 + 1 as int), 1)), 16, 10)").cast("int")
    met = rows.withColumn("_bit", bit).withColumn("_map", F.expr(f"_bit div {_MAP_BITS}")).join(F.broadcast(maps), "_map", "left").withColumn("_byte", byte)
    return met.withColumn("_hit", F.coalesce(F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1, F.lit(False))).drop("_bit", "_map", "_bits", "_byte")
