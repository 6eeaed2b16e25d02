"""Symbols and references: look-ups, resolution, and what symbol_info puts together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.schema import CALLS, IMPORT, METHOD


def is_definition(name: str) -> Column:
    """The name itself, or a method's name behind its receiver."""
    return (F.col("name") == name) | ((F.col("kind") == METHOD) & F.lower("name").endswith("." + name.lower()))


def definitions(symbols: DataFrame, name: str, path: str = "") -> DataFrame:
    return symbols.filter(is_definition(name) & F.col("rel_path").startswith(path)).orderBy("kind", "rel_path", "id")


def usages(refs: DataFrame, name: str, path: str = "") -> DataFrame:
    return refs.filter((F.col("target_name") == name) & F.col("rel_path").startswith(path)).orderBy("rel_path", "line", "id")


def callers(refs: DataFrame, name: str, path: str = "") -> DataFrame:
    return usages(refs.filter(F.col("kind") == CALLS), name, path)


def callees(refs: DataFrame, source_id) -> DataFrame:
    return refs.filter((F.col("source_id") == source_id) & (F.col("kind") == CALLS)).orderBy("line", "id")


def imports(symbols: DataFrame, part: str) -> DataFrame:
    has = lambda c: F.contains(F.lower(F.col(c)), F.lit(part.lower()))
    return symbols.filter((F.col("kind") == IMPORT) & (has("name") | has("signature"))).orderBy("name", "id")


def file_refs(refs: DataFrame, rel_path: str) -> DataFrame:
    return refs.filter(F.col("rel_path") == rel_path).orderBy("line", "id")


def unresolved(refs: DataFrame) -> DataFrame:
    return refs.filter(F.coalesce(F.col("target_id").cast("string"), F.lit("")) == "")


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with target_id: the symbol of that name, one of the same file before others, then the smallest id; null if there is none.

    Symbols are reduced to one a name and file and one a name before they are joined, so
    a reference meets two rows however many symbols share its name.
    """
    by_file = symbols.groupBy(F.col("name").alias("target_name"), "rel_path").agg(F.min("id").alias("in_file"))
    by_name = by_file.groupBy("target_name").agg(F.min("in_file").alias("anywhere"))
    met = refs.drop("target_id").join(by_file, ["target_name", "rel_path"], "left").join(by_name, "target_name", "left")
    return met.withColumn("target_id", F.coalesce("in_file", "anywhere")).drop("in_file", "anywhere")


def ordered(defs: DataFrame) -> DataFrame:
    """Definitions of one name with their order."""
    return defs.withColumn("def_order", F.row_number().over(W.orderBy("kind", "rel_path", "id")))


def callers_by_target(calls: DataFrame, defs: DataFrame) -> DataFrame:
    return calls.join(defs.select(F.col("id").alias("def_id")), F.col("target_id") == F.col("def_id"))


def callers_by_range(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Calls inside a definition of the same file: the first such definition."""
    d = defs.select(F.col("id").alias("def_id"), "def_order", F.col("rel_path").alias("def_path"), "start_line", "end_line")
    met = calls.join(d, (F.col("rel_path") == F.col("def_path")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return met.groupBy("id", "rel_path", "line").agg(F.min_by("def_id", "def_order").alias("def_id"))


def symbol_info(symbols: DataFrame, refs: DataFrame, name: str, path: str = "") -> DataFrame:
    """def_id, role (caller, callee, usage), ref_id, rel_path, line. refs need target_id (see resolve).

    A caller belongs to the definition it is resolved to, else to the first that encloses it, else to all; another usage to the last
    definition of its file, else of its directory, else to all; callees are the first call of each line inside a definition.
    Definitions of one name are few and are broadcast only through Spark's own size check.
    """
    defs = ordered(definitions(symbols, name, path))
    all_defs = defs.select(F.col("id").alias("def_id"))
    used = usages(refs, name, path)
    calls, other = used.filter(F.col("kind") == CALLS), used.filter(F.col("kind") != CALLS)
    by_target = callers_by_target(calls, defs).select("def_id", "id", "rel_path", "line")
    rest = calls.join(by_target.select("id"), "id", "left_anti")
    by_range = callers_by_range(rest, defs).select("def_id", "id", "rel_path", "line")
    free = rest.join(by_range.select("id"), "id", "left_anti")
    to_all = free.crossJoin(all_defs).select("def_id", "id", "rel_path", "line")
    caller = by_target.unionByName(by_range).unionByName(to_all).withColumn("role", F.lit("caller"))

    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    of_file = defs.groupBy("rel_path").agg(F.max_by("id", "def_order").alias("by_file"))
    of_folder = defs.groupBy(folder("rel_path").alias("folder")).agg(F.max_by("id", "def_order").alias("by_folder")).filter("folder <> ''")
    placed = other.withColumn("folder", folder("rel_path")).join(of_file, "rel_path", "left").join(of_folder, "folder", "left").withColumn("def_id", F.coalesce("by_file", "by_folder"))
    one = placed.filter("def_id is not null").select("def_id", "id", "rel_path", "line")
    many = placed.filter("def_id is null").drop("def_id").crossJoin(all_defs).select("def_id", "id", "rel_path", "line")
    usage = one.unionByName(many).withColumn("role", F.lit("usage"))
    callee = callees_by_range(refs, defs).withColumn("role", F.lit("callee"))
    return caller.unionByName(usage).unionByName(callee).select("def_id", "role", F.col("id").alias("ref_id"), "rel_path", "line")


def callees_by_range(refs: DataFrame, defs: DataFrame) -> DataFrame:
    d = defs.select(F.col("id").alias("def_id"), F.col("rel_path").alias("def_path"), "start_line", "end_line")
    inside = refs.filter(F.col("kind") == CALLS).join(d, (F.col("rel_path") == F.col("def_path")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return inside.groupBy("def_id", "rel_path", "line").agg(F.min("id").alias("id"))


def formatted(info: DataFrame) -> DataFrame:
    """One JSON text a definition; usages are left out where they are the callers again."""
    entry = F.struct("rel_path", "line", "ref_id")
    role = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, entry)))
    out = info.groupBy("def_id").agg(role("caller").alias("callers"), role("callee").alias("callees"), role("usage").alias("usages"))
    return out.select("def_id", F.to_json(F.struct("callers", "callees", F.when(F.col("usages") != F.col("callers"), F.col("usages")).alias("usages"))).alias("json"))
