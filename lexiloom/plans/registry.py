"""Every query of the engine over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.filters import filter_of, with_hit
from lexiloom.functions import patterns, text as words
from lexiloom.operators import graph, search, tables
from lexiloom.operators.chunks import lines_of
from lexiloom.operators.grep import grep, line_matches, matched
from lexiloom.sources import views as v
from lexiloom.sources.views import CHANGES, FILES, LINES, REFS, SYMBOLS, VECTORS, chunks_sql, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    from lexiloom.plans import local  # noqa: F401  (adds its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()  # all modules with queries
    return dict(_SQL)


CHUNKS = chunks_sql()
DEFINITION = r"(?i)^\s*(" + "|".join(patterns.DEFINITION_WORDS) + r")\b"
#: The vector that stands for the query in every search: that of vec_id 7.
ASKED = 7


def asked(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(v.vectors(spark, sf_dir).filter(F.col("chunk_id") == ASKED).first()["vector"])


def some_files(spark, sf_dir, modulus: int) -> DataFrame:
    """A second listing of the files: every modulus-th is missing and every fifth has other content."""
    f = v.files(spark, sf_dir)
    return f.filter(F.col("doc_id") % modulus != 0).withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.col("hash")))


def some_files_sql(modulus: int) -> str:
    return f"v_now AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE hash END AS hash) FROM v_files WHERE doc_id % {modulus} <> 0)"


# -- scans ------------------------------------------------------------------------------------


@query("src_scan_chunks", f"WITH {CHUNKS} SELECT id, rel_path, language, start_line, end_line, content, file_hash FROM v_chunks")
def src_scan_chunks(s, d):
    return v.chunks(s, d).drop("doc_id")


@query("ch_sliding", f"WITH {chunks_sql(50, 10)} SELECT id, start_line, end_line, content FROM v_chunks")
def ch_sliding(s, d):
    return v.chunks(s, d, 50, 10).select("id", "start_line", "end_line", "content")


@query("src_list_files", f"WITH {FILES} SELECT DISTINCT rel_path FROM v_files")
def src_list_files(s, d):
    return v.files(s, d).select("rel_path").distinct().orderBy("rel_path")


@query("src_list_symbol_files", f"WITH {SYMBOLS} SELECT DISTINCT rel_path FROM v_symbols")
def src_list_symbol_files(s, d):
    return v.symbols(s, d).select("rel_path").distinct().orderBy("rel_path")


@query("src_file_hash_map", f"WITH {FILES} SELECT DISTINCT rel_path, hash FROM v_files WHERE hash <> ''")
def src_file_hash_map(s, d):
    return v.files(s, d).filter("hash <> ''").select("rel_path", "hash").distinct()


@query("src_hash", f"WITH {FILES} SELECT rel_path, hash, size FROM v_files")
def src_hash(s, d):
    return v.files(s, d).select("rel_path", "hash", F.col("size").cast("long").alias("size"))


_LANG_CASE = "CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in patterns.EXTENSIONS.items()) + " END"
_PATHS = "SELECT url AS path FROM pages UNION ALL SELECT concat('src/m', p_partkey, CASE p_partkey % 7 WHEN 0 THEN '.go' WHEN 1 THEN '.PY' WHEN 2 THEN '.tsx' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.txt' WHEN 5 THEN '.h' ELSE '' END) FROM part"


def paths(s, d) -> DataFrame:
    end = "CASE p_partkey % 7 WHEN 0 THEN '.go' WHEN 1 THEN '.PY' WHEN 2 THEN '.tsx' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.txt' WHEN 5 THEN '.h' ELSE '' END"
    return table(s, d, "pages").select(F.col("url").alias("path")).union(table(s, d, "part").selectExpr(f"concat('src/m', p_partkey, {end})"))


@query("src_lang", f"WITH p AS ({_PATHS}) SELECT path, {_LANG_CASE} AS language FROM p WHERE {_LANG_CASE} IS NOT NULL")
def src_lang(s, d):
    return paths(s, d).withColumn("language", patterns.language_of(F.col("path"))).filter("language is not null")


@query("src_lang_narrow", f"WITH p AS ({_PATHS}) SELECT {_LANG_CASE} AS language, count(*) AS n FROM p GROUP BY 1")
def src_lang_narrow(s, d):
    return paths(s, d).groupBy(patterns.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("src_lines", f"WITH {FILES}, {LINES} SELECT rel_path, unnest(lines) AS content, CAST(generate_subscripts(lines, 1) AS INTEGER) AS line FROM v_split")
def src_lines(s, d):
    rows = v.files(s, d).select("rel_path", F.posexplode(lines_of(F.col("content"))).alias("line", "content"))
    return rows.withColumn("line", F.col("line") + 1)


@query("src_changed", f"""WITH {FILES}, {some_files_sql(11)} SELECT coalesce(o.rel_path, n.rel_path) AS rel_path,
  CASE WHEN o.rel_path IS NULL THEN 'added' WHEN n.rel_path IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM (SELECT * FROM v_files WHERE doc_id % 13 <> 0) o FULL JOIN v_now n ON o.rel_path = n.rel_path WHERE o.hash IS DISTINCT FROM n.hash""")
def src_changed(s, d):
    return tables.snapshot_diff(v.files(s, d).filter("doc_id % 13 <> 0"), some_files(s, d, 11))


@query("src_submodules", f"WITH {FILES} SELECT rel_path FROM v_files WHERE NOT starts_with(rel_path, 'src1/') AND NOT starts_with(rel_path, 'src2/en/')")
def src_submodules(s, d):
    from lexiloom.sources.files import without_submodules

    return without_submodules(v.files(s, d), ["src1", "src2/en"]).select("rel_path")


# -- predicates ---------------------------------------------------------------------------------


@query("flt_eq_lang", f"WITH {CHUNKS} SELECT id FROM v_chunks WHERE language = 'fr'")
def flt_eq_lang(s, d):
    return v.chunks(s, d).filter("language = 'fr'").select("id")


@query("flt_like", f"WITH {CHUNKS} SELECT id FROM v_chunks WHERE contains(lower(content), 'licensed under')")
def flt_like(s, d):
    return v.chunks(s, d).filter(F.col("content").ilike("%licensed under%")).select("id")


def _line_query(name, where, q, **how):
    @query(name, f"WITH {FILES}, {LINES}, l AS (SELECT rel_path, unnest(lines) AS content, CAST(generate_subscripts(lines, 1) AS INTEGER) AS line FROM v_split) SELECT rel_path, line FROM l WHERE {where}")
    def run(s, d):
        return src_lines(s, d).filter(line_matches(F.col("content"), q, **how)).select("rel_path", "line")


_line_query("flt_regex", r"regexp_matches(content, '(?i)th[aeiou]+\w*ing\b')", r"th[aeiou]+\w*ing\b")
_line_query("flt_contains_cs", "contains(content, 'The')", "The", case_sensitive=True)
_line_query("flt_contains_ci", "contains(lower(content), 'der ')", "der ")
_line_query("flt_whole_word", "regexp_matches(lower(content), '(^|[^0-9a-z_])heit($|[^0-9a-z_])')", "heit", whole_word=True)


@query("flt_whole_word_first", f"""WITH {FILES}, {LINES}, l AS (SELECT rel_path, lower(unnest(lines)) AS t, CAST(generate_subscripts(lines, 1) AS INTEGER) AS line FROM v_split),
  m AS (SELECT *, strpos(t, 'and') AS p FROM l) SELECT rel_path, line FROM m WHERE p > 0 AND NOT regexp_matches(CASE WHEN p > 1 THEN substr(t, p - 1, 1) ELSE '' END, '^[0-9A-Za-z_]$') AND NOT regexp_matches(substr(t, p + 3, 1), '^[0-9A-Za-z_]$')""")
def flt_whole_word_first(s, d):
    return src_lines(s, d).filter(line_matches(F.col("content"), "and", whole_word=True, compat=True)).select("rel_path", "line")


@query("flt_def_line", f"WITH {FILES}, {LINES}, l AS (SELECT rel_path, unnest(lines) AS content, CAST(generate_subscripts(lines, 1) AS INTEGER) AS line FROM v_split) SELECT rel_path, line FROM l WHERE regexp_matches(content, '{DEFINITION}')")
def flt_def_line(s, d):
    return src_lines(s, d).filter(F.col("content").rlike(patterns.DEFINITION_LINE)).select("rel_path", "line")


@query("flt_regex_prefilter", f"WITH {CHUNKS} SELECT id FROM v_chunks WHERE contains(lower(content), 'licensed') AND regexp_matches(content, '(?i)licensed\\s+under')")
def flt_regex_prefilter(s, d):
    q = r"licensed\s+under"
    return v.chunks(s, d).filter(F.contains(F.lower("content"), F.lit(patterns.literal_factor(q))) & F.col("content").rlike(patterns.java_regex(q))).select("id")


_GLOBS = ("src1/*/doc?.md", "*7.md", "**/fr/doc[12]*.md", "SRC1", "doc1*")


@query("flt_path_glob", f"WITH {FILES} " + " UNION ALL ".join(
    f"SELECT '{g}' AS pattern, rel_path FROM v_files WHERE " + (f"regexp_matches(rel_path, '{patterns.path_regex(g)}')" if patterns.path_regex(g) else f"starts_with(lower(rel_path), '{g.lower()}')") for g in _GLOBS))
def flt_path_glob(s, d):
    f = v.files(s, d).select("rel_path")
    parts = [f.filter(patterns.path_matches(F.col("rel_path"), g)).select(F.lit(g).alias("pattern"), "rel_path") for g in _GLOBS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("flt_path_prefix", f"WITH {SYMBOLS} SELECT id FROM v_symbols WHERE starts_with(rel_path, 'Brand#1')")
def flt_path_prefix(s, d):
    return v.symbols(s, d).filter(F.col("rel_path").startswith("Brand#1")).select("id")


_ODD = "CASE doc_id % 9 WHEN 0 THEN 'a/node_modules/x.js' WHEN 1 THEN 'lib/a.min.js' WHEN 2 THEN 'build/out.go' WHEN 3 THEN 'src/build.go' WHEN 4 THEN 'go.sum' WHEN 5 THEN 'x/.git/config' WHEN 6 THEN 'docs/a.pdf' WHEN 7 THEN 'vendored/a.go' ELSE 'src/a.py' END"


@query("flt_ignore", f"SELECT doc_id, {_ODD} AS path FROM documents WHERE doc_id % 9 IN (3, 7, 8)")
def flt_ignore(s, d):
    return table(s, d, "documents").selectExpr("doc_id", f"{_ODD} AS path").filter(~F.col("path").rlike(patterns.ignore_regex()))


@query("flt_is_indexed", f"WITH {FILES}, {some_files_sql(11)} SELECT f.rel_path FROM v_files f SEMI JOIN v_now n ON f.rel_path = n.rel_path AND f.hash = n.hash")
def flt_is_indexed(s, d):
    return v.files(s, d).join(some_files(s, d, 11).select("rel_path", "hash"), ["rel_path", "hash"], "left_semi").select("rel_path")


@query("flt_has_file", f"WITH {SYMBOLS}, {REFS} SELECT DISTINCT rel_path FROM v_refs SEMI JOIN v_symbols USING (rel_path)")
def flt_has_file(s, d):
    return v.refs(s, d).select("rel_path").distinct().join(v.symbols(s, d).select("rel_path"), "rel_path", "left_semi")


_RESOLVED = f"""{SYMBOLS}, {REFS}, v_res AS (SELECT r.*, coalesce((SELECT min(s.id) FROM v_symbols s WHERE s.name = r.target_name AND s.rel_path = r.rel_path),
  (SELECT min(s.id) FROM v_symbols s WHERE s.name = r.target_name)) AS target_id FROM v_refs r)"""


def resolved(s, d) -> DataFrame:
    return graph.resolve(v.refs(s, d), v.symbols(s, d))


@query("flt_unresolved", f"WITH {_RESOLVED} SELECT id, target_name FROM v_res WHERE target_id IS NULL")
def flt_unresolved(s, d):
    return graph.unresolved(resolved(s, d)).select("id", "target_name")


@query("flt_def_name", f"WITH {SYMBOLS} SELECT * FROM v_symbols WHERE name = 'fn_5' OR (kind = 1 AND ends_with(lower(name), '.fn_5'))")
def flt_def_name(s, d):
    return graph.definitions(v.symbols(s, d), "fn_5")


@query("flt_import", f"WITH {SYMBOLS} SELECT * FROM v_symbols WHERE kind = 9 AND (contains(lower(name), '7') OR contains(lower(signature), '7'))")
def flt_import(s, d):
    return graph.imports(v.symbols(s, d), "7")


# -- joins of the graph ----------------------------------------------------------------------------

_DEF = "d AS (SELECT *, row_number() OVER (ORDER BY kind, rel_path, id) AS def_order FROM v_symbols WHERE name = 'fn_5')"


def defs(s, d) -> DataFrame:
    return graph.ordered(graph.definitions(v.symbols(s, d), "fn_5"))


@query("jn_resolve", f"WITH {_RESOLVED} SELECT id, target_id FROM v_res")
def jn_resolve(s, d):
    return resolved(s, d).select("id", "target_id")


@query("snk_resolve_update", f"WITH {_RESOLVED} SELECT count(*) AS refs, count(target_id) AS resolved FROM v_res")
def snk_resolve_update(s, d):
    return resolved(s, d).agg(F.count("*").alias("refs"), F.count("target_id").alias("resolved"))


@query("jn_callers_target", f"WITH {_RESOLVED}, {_DEF} SELECT d.id AS def_id, r.id FROM v_res r JOIN d ON r.target_id = d.id WHERE r.kind = 0")
def jn_callers_target(s, d):
    return graph.callers_by_target(resolved(s, d).filter("kind = 0"), defs(s, d)).select("def_id", "id")


@query("jn_callers_range", f"WITH {SYMBOLS}, {REFS}, {_DEF} SELECT r.id, arg_min(d.id, d.def_order) AS def_id FROM v_refs r JOIN d ON r.rel_path = d.rel_path AND r.line BETWEEN d.start_line AND d.end_line WHERE r.kind = 0 GROUP BY r.id")
def jn_callers_range(s, d):
    return graph.callers_by_range(v.refs(s, d).filter("kind = 0"), defs(s, d)).select("id", "def_id")


@query("jn_callers_broadcast", f"WITH {SYMBOLS}, {REFS}, {_DEF} SELECT r.id, d.id AS def_id FROM (SELECT * FROM v_refs WHERE kind = 0 AND target_name = 'fn_5') r ANTI JOIN d x ON r.rel_path = x.rel_path CROSS JOIN d")
def jn_callers_broadcast(s, d):
    own = defs(s, d)
    free = graph.callers(v.refs(s, d), "fn_5").join(own.select("rel_path"), "rel_path", "left_anti")
    return free.select("id").crossJoin(own.select(F.col("id").alias("def_id")))


@query("jn_callees_exact", f"WITH {REFS} SELECT id, line FROM v_refs WHERE source_id = 3 AND kind = 0")
def jn_callees_exact(s, d):
    return graph.callees(v.refs(s, d), 3).select("id", "line")


@query("jn_callees_range", f"WITH {SYMBOLS}, {REFS}, {_DEF} SELECT d.id AS def_id, r.rel_path, r.line, min(r.id) AS id FROM v_refs r JOIN d ON r.rel_path = d.rel_path AND r.line BETWEEN d.start_line AND d.end_line WHERE r.kind = 0 GROUP BY ALL")
def jn_callees_range(s, d):
    return graph.callees_by_range(v.refs(s, d), defs(s, d))


_USAGE = f"{_RESOLVED}, {_DEF}, u AS (SELECT * FROM v_res WHERE target_name = 'fn_5' AND kind <> 0), df AS (SELECT rel_path, arg_max(id, def_order) AS by_file FROM d GROUP BY 1), dd AS (SELECT split_part(rel_path, '/', 1) AS folder, arg_max(id, def_order) AS by_folder FROM d GROUP BY 1), w AS (SELECT u.*, coalesce(by_file, by_folder) AS def_id, by_file, by_folder FROM u LEFT JOIN df USING (rel_path) LEFT JOIN dd ON dd.folder = split_part(u.rel_path, '/', 1))"


def info(s, d) -> DataFrame:
    return graph.symbol_info(v.symbols(s, d), resolved(s, d), "fn_5")


@query("jn_usage_file", f"WITH {_USAGE} SELECT id, by_file AS def_id FROM w WHERE by_file IS NOT NULL")
def jn_usage_file(s, d):
    own = defs(s, d)
    met = info(s, d).filter("role = 'usage'").join(own.select("rel_path").distinct(), "rel_path", "left_semi")
    return met.select(F.col("ref_id").alias("id"), "def_id")


@query("jn_usage_dir", f"WITH {_USAGE} SELECT id, by_folder AS def_id FROM w WHERE by_file IS NULL AND by_folder IS NOT NULL")
def jn_usage_dir(s, d):
    own = defs(s, d).select("rel_path", F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("folder"))
    met = info(s, d).filter("role = 'usage'").join(own.select("rel_path"), "rel_path", "left_anti").withColumn("folder", F.split_part("rel_path", F.lit("/"), F.lit(1)))
    return met.join(own.select("folder"), "folder", "left_semi").select(F.col("ref_id").alias("id"), "def_id")


@query("jn_usage_rest", f"WITH {_USAGE} SELECT w.id, d.id AS def_id FROM w CROSS JOIN d WHERE w.def_id IS NULL")
def jn_usage_rest(s, d):
    own = defs(s, d).select(F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("folder"))
    met = info(s, d).filter("role = 'usage'").withColumn("folder", F.split_part("rel_path", F.lit("/"), F.lit(1)))
    return met.join(own, "folder", "left_anti").select(F.col("ref_id").alias("id"), "def_id")


_INFO = f"""{_USAGE}, c AS (SELECT * FROM v_res WHERE target_name = 'fn_5' AND kind = 0),
  ct AS (SELECT d.id AS def_id, c.id, c.rel_path, c.line FROM c JOIN d ON c.target_id = d.id),
  cr AS (SELECT arg_min(d.id, d.def_order) AS def_id, c.id, c.rel_path, c.line FROM c JOIN d ON c.rel_path = d.rel_path AND c.line BETWEEN d.start_line AND d.end_line WHERE c.id NOT IN (SELECT id FROM ct) GROUP BY c.id, c.rel_path, c.line),
  ca AS (SELECT d.id AS def_id, c.id, c.rel_path, c.line FROM c CROSS JOIN d WHERE c.id NOT IN (SELECT id FROM ct) AND c.id NOT IN (SELECT id FROM cr)),
  ce AS (SELECT d.id AS def_id, min(r.id) AS id, r.rel_path, r.line FROM v_res r JOIN d ON r.rel_path = d.rel_path AND r.line BETWEEN d.start_line AND d.end_line WHERE r.kind = 0 GROUP BY d.id, r.rel_path, r.line),
  i AS (SELECT 'caller' AS role, * FROM ct UNION ALL SELECT 'caller', * FROM cr UNION ALL SELECT 'caller', * FROM ca UNION ALL SELECT 'callee', * FROM ce
    UNION ALL SELECT 'usage', def_id, id, rel_path, line FROM w WHERE def_id IS NOT NULL UNION ALL SELECT 'usage', d.id, w.id, w.rel_path, w.line FROM w CROSS JOIN d WHERE w.def_id IS NULL)"""


@query("gq_symbol_info", f"WITH {_INFO} SELECT def_id, role, id AS ref_id, rel_path, line FROM i")
def gq_symbol_info(s, d):
    return info(s, d)


@query("ag_callers_group", f"WITH {_INFO} SELECT def_id, count(*) FILTER (role = 'caller') AS callers, count(*) FILTER (role = 'callee') AS callees, count(*) FILTER (role = 'usage') AS usages, string_agg(id, ',' ORDER BY id) FILTER (role = 'caller') AS caller_ids FROM i GROUP BY 1")
def ag_callers_group(s, d):
    ids = F.array_sort(F.collect_list(F.when(F.col("role") == "caller", F.col("ref_id"))))
    out = info(s, d).groupBy("def_id").agg(*[F.count_if(F.col("role") == r).alias(r + "s") for r in ("caller", "callee", "usage")], ids.alias("x"))
    return out.withColumn("caller_ids", F.when(F.size("x") > 0, F.array_join("x", ","))).drop("x")


for _name, _sql, _run in (
    ("gq_definition", f"{SYMBOLS} SELECT id, kind, rel_path FROM v_symbols WHERE name = 'fn_9'", lambda s, d: graph.definitions(v.symbols(s, d), "fn_9").select("id", "kind", "rel_path")),
    ("gq_usages", f"{REFS} SELECT * FROM v_refs WHERE target_name = 'fn_9' AND starts_with(rel_path, 'Brand#2')", lambda s, d: graph.usages(v.refs(s, d), "fn_9", "Brand#2")),
    ("gq_callers", f"{REFS} SELECT * FROM v_refs WHERE target_name = 'fn_9' AND kind = 0", lambda s, d: graph.callers(v.refs(s, d), "fn_9")),
    ("gq_callees", f"{REFS} SELECT * FROM v_refs WHERE source_id = 4 AND kind = 0", lambda s, d: graph.callees(v.refs(s, d), 4)),
    ("gq_imports", f"{SYMBOLS} SELECT id, name FROM v_symbols WHERE kind = 9 AND (contains(lower(name), 'fn_1') OR contains(lower(signature), 'fn_1'))", lambda s, d: graph.imports(v.symbols(s, d), "FN_1").select("id", "name")),
    ("gq_file_refs", f"{REFS} SELECT * FROM v_refs WHERE rel_path = (SELECT min(concat(p_brand, '/', p_type)) FROM part)", lambda s, d: graph.file_refs(v.refs(s, d), v.symbols(s, d).agg(F.min("rel_path")).first()[0])),
):
    query(_name, "WITH " + _sql)(_run)


@query("jn_gap_anti", f"WITH {CHUNKS}, {SYMBOLS} SELECT DISTINCT rel_path FROM v_chunks ANTI JOIN v_symbols USING (rel_path)")
def jn_gap_anti(s, d):
    return v.chunks(s, d).select("rel_path").distinct().join(v.symbols(s, d).select("rel_path"), "rel_path", "left_anti")


@query("jn_changed_filter", f"WITH {FILES}, {some_files_sql(11)} SELECT rel_path FROM v_files f WHERE doc_id % 3 = 0 AND NOT (EXISTS (FROM v_now n WHERE n.rel_path = f.rel_path AND n.hash = f.hash) AND doc_id % 2 = 0)")
def jn_changed_filter(s, d):
    f = v.files(s, d)
    done = f.join(some_files(s, d, 11).select("rel_path", "hash"), ["rel_path", "hash"], "left_semi").filter("doc_id % 2 = 0")
    return f.filter("doc_id % 3 = 0").join(done.select("rel_path"), "rel_path", "left_anti").select("rel_path")


for _name in ("jn_prune", "snk_prune"):

    @query(_name, f"WITH {CHUNKS}, {some_files_sql(11)} SELECT id FROM v_chunks SEMI JOIN v_now USING (rel_path)")
    def jn_prune(s, d):
        return tables.prune(v.chunks(s, d), some_files(s, d, 11)).select("id")


# -- changes ----------------------------------------------------------------------------------------


@query("snk_upsert_chunks", f"""WITH {CHUNKS}, new AS (SELECT id, 'new' AS content FROM v_chunks JOIN embeddings ON vec_id = doc_id WHERE doc_id % 4 = 0),
  old AS (SELECT id, content FROM v_chunks WHERE doc_id % 3 = 0) SELECT * FROM old ANTI JOIN new USING (id) UNION ALL SELECT * FROM new""")
def snk_upsert_chunks(s, d):
    c = v.chunks(s, d)
    new = c.filter("doc_id % 4 = 0").select("id", "doc_id", F.lit("new").alias("content"))
    has = v.vectors(s, d).join(new.select("id", F.col("doc_id").alias("chunk_id")), "chunk_id").select(F.col("id").alias("chunk_id"))
    return tables.upsert_chunks(c.filter("doc_id % 3 = 0").select("id", "content"), new.select("id", "content"), has)


@query("jn_chunk_embed", f"WITH {CHUNKS}, {VECTORS} SELECT id, label FROM v_chunks JOIN v_vec ON chunk_id = doc_id")
def jn_chunk_embed(s, d):
    return v.chunks(s, d).join(v.vectors(s, d).select(F.col("chunk_id").alias("doc_id"), "label"), "doc_id").select("id", "label")


@query("snk_delete_path", f"WITH {CHUNKS} SELECT id FROM v_chunks WHERE doc_id % 10 <> 0")
def snk_delete_path(s, d):
    return tables.delete_paths(v.chunks(s, d), v.files(s, d).filter("doc_id % 10 = 0")).select("id")


@query("snk_remove_file", f"WITH {SYMBOLS} SELECT id FROM v_symbols WHERE rel_path NOT IN (SELECT concat(p_brand, '/', p_type) FROM part WHERE p_partkey <= 5)")
def snk_remove_file(s, d):
    return tables.delete_paths(v.symbols(s, d), v.symbols(s, d).filter("id <= 5")).select("id")


@query("snk_store_file", f"WITH {SYMBOLS}, new AS (SELECT id + 1000000 AS id, 'stored' AS name, rel_path FROM v_symbols WHERE id <= 5) SELECT id, name, rel_path FROM v_symbols WHERE rel_path NOT IN (SELECT rel_path FROM new) UNION ALL SELECT * FROM new")
def snk_store_file(s, d):
    old = v.symbols(s, d).select("id", "name", "rel_path")
    return tables.replace_files(old, old.filter("id <= 5").select((F.col("id") + 1000000).alias("id"), F.lit("stored").alias("name"), "rel_path"))


@query("snk_clear", f"WITH {SYMBOLS} SELECT count(*) AS n FROM v_symbols WHERE false")
def snk_clear(s, d):
    return tables.cleared(v.symbols(s, d)).agg(F.count("*").alias("n"))


@query("snk_meta", "SELECT * FROM (VALUES ('commit_sha', 'b'), ('dimensions', '64')) t(key, value)")
def snk_meta(s, d):
    old = s.createDataFrame([("commit_sha", "a"), ("dimensions", "64")], "key string, value string")
    return tables.set_meta(old, "commit_sha", "b")


@query("snk_seed", f"WITH {CHUNKS} SELECT id, 'feature' AS branch FROM v_chunks WHERE doc_id % 6 <> 0")
def snk_seed(s, d):
    return tables.seed(v.chunks(s, d), v.files(s, d).filter("doc_id % 6 = 0"), "feature").select("id", "branch")


@query("snk_seed_pick", "SELECT source AS branch, count(*) AS records, source IN ('src3', 'src7') AS has_sha FROM documents GROUP BY source ORDER BY records DESC, has_sha DESC, branch LIMIT 1")
def snk_seed_pick(s, d):
    c = table(s, d, "documents").groupBy(F.col("source").alias("branch")).agg(F.count("*").alias("records"))
    c = c.withColumn("has_sha", F.col("branch").isin("src3", "src7")).withColumn("ord", F.col("branch"))
    return tables.pick_source(c).drop("ord")


@query("snk_json", f"""WITH {SYMBOLS} SELECT id, concat('{{"id":', id, ',"name":"', name, '","start_line":', start_line, '}}') AS json FROM v_symbols""")
def snk_json(s, d):
    return v.symbols(s, d).select("id", F.to_json(F.struct("id", "name", "start_line")).alias("json"))


@query("snk_text", f"WITH {SYMBOLS} SELECT id, concat(rel_path, ':', start_line, '-', end_line, ' (', printf('%.1f', id % 1000 / 10.0), '%)') AS line FROM v_symbols")
def snk_text(s, d):
    share = F.format_string("%.1f", F.col("id") % 1000 / F.lit(10.0))
    return v.symbols(s, d).select("id", F.concat("rel_path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit(" ("), share, F.lit("%)")).alias("line"))


@query("sm_latest", f"WITH {CHANGES}, s AS (SELECT file, arg_max({{'deleted': deleted, 'payload': payload}}, (ts, event_id)) AS x FROM v_changes GROUP BY 1) SELECT file, x.payload AS payload FROM s WHERE NOT x.deleted")
def sm_latest(s, d):
    return tables.latest(v.changes(s, d))


# -- sums, sorts, sets -------------------------------------------------------------------------------


@query("ag_stats", f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT rel_path) AS files FROM v_chunks")
def ag_stats(s, d):
    return v.chunks(s, d).agg(F.count("*").alias("chunks"), F.countDistinct("rel_path").alias("files"))


@query("ag_graph_stats", f"WITH {SYMBOLS}, {REFS} SELECT (SELECT count(*) FROM v_symbols) AS symbols, (SELECT count(*) FROM v_refs) AS refs")
def ag_graph_stats(s, d):
    return v.symbols(s, d).agg(F.count("*").alias("symbols")).crossJoin(v.refs(s, d).agg(F.count("*").alias("refs")))


@query("ag_exists_count", f"WITH {FILES} SELECT count(*) > 0 AS found FROM v_files WHERE rel_path = 'src0/fr/doc0.md'")
def ag_exists_count(s, d):
    return v.files(s, d).filter("rel_path = 'src0/fr/doc0.md'").limit(1).agg((F.count("*") > 0).alias("found"))


def _grep_sql(line: str, where: str = "true", tail: str = "") -> str:
    return f"""WITH {CHUNKS}, l AS (SELECT id, rel_path, start_line, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM v_chunks WHERE {where}),
  m AS (SELECT id, rel_path, count(*) * CASE WHEN bool_or(regexp_matches(t, '{DEFINITION}')) THEN 2 ELSE 1 END::DOUBLE AS score, count(*) AS matches, min(CAST(start_line + k - 1 AS INTEGER)) AS first_line, bool_or(regexp_matches(t, '{DEFINITION}')) AS defines FROM l WHERE {line} GROUP BY id, rel_path) {tail}"""


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "rel_path", F.round("score", 6).alias("score"), F.size("matches").cast("long").alias("matches"), F.col("matches")[0]["line"].alias("first_line"))


_TOP = "SELECT id, rel_path, round(score / max(score) OVER (), 6) AS score, matches, first_line FROM (SELECT * FROM m ORDER BY score DESC, id LIMIT {}) x"


@query("so_topk_grep", _grep_sql("contains(lower(t), 'the')", tail=_TOP.format(25)))
def so_topk_grep(s, d):
    return shown(grep(v.chunks(s, d), "the"))


@query("flt_path_apply", _grep_sql("contains(lower(t), 'the')", "regexp_matches(rel_path, '^(?:src1/[^/]*/[^/]*)$')", _TOP.format(10)))
def flt_path_apply(s, d):
    return shown(grep(v.chunks(s, d), "the", 10, path="src1/*/*"))


@query("flt_path_apply_late", _grep_sql("contains(lower(t), 'the')", tail=f"SELECT * FROM ({_TOP.format(50)}) y WHERE starts_with(lower(rel_path), 'src1')"))
def flt_path_apply_late(s, d):
    return shown(grep(v.chunks(s, d), "the", 50, path="src1", compat=True))


@query("ag_max_norm_grep", _grep_sql(r"regexp_matches(t, '(?i)\bund\b|licensed')", "language = 'de'", _TOP.format(50)))
def ag_max_norm_grep(s, d):
    return shown(grep(v.chunks(s, d), r"\bund\b|licensed", 50, language="de"))


@query("ag_match_count", _grep_sql("contains(t, 'La')", tail="SELECT id, matches FROM m"))
def ag_match_count(s, d):
    return matched(v.chunks(s, d), "La", case_sensitive=True).select("id", F.size("matches").cast("long").alias("matches"))


@query("ag_any_def", _grep_sql("contains(lower(t), 'licensed')", tail="SELECT id, defines, score FROM m"))
def ag_any_def(s, d):
    m = matched(v.chunks(s, d), "licensed")
    return m.select("id", F.exists("matches", lambda x: x["content"].rlike(patterns.DEFINITION_LINE)).alias("defines"), "score")


@query("ag_collect_matches", f"""WITH {CHUNKS}, l AS (SELECT id, start_line, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM v_chunks)
  SELECT id, CAST(start_line + k - 1 AS INTEGER) AS line, content FROM l WHERE contains(lower(content), 'scum')""")
def ag_collect_matches(s, d):
    return matched(v.chunks(s, d), "scum").select("id", F.explode("matches").alias("m")).select("id", "m.line", "m.content")


@query("so_limit_clamp", _grep_sql("contains(lower(t), 'a')", tail="SELECT count(*) AS n FROM (SELECT * FROM m LIMIT 25)"))
def so_limit_clamp(s, d):
    return grep(v.chunks(s, d), "a", 99).agg(F.count("*").alias("n"))


@query("ag_chunk_stats", f"WITH {CHUNKS} SELECT language, count(*) AS chunks, count(DISTINCT rel_path) AS files FROM v_chunks GROUP BY 1")
def ag_chunk_stats(s, d):
    return v.chunks(s, d).groupBy("language").agg(F.count("*").alias("chunks"), F.countDistinct("rel_path").alias("files"))


@query("ag_multiset_eq", f"WITH {REFS}, a AS (SELECT target_name, rel_path, line FROM v_refs WHERE target_name = 'fn_9'), b AS (SELECT target_name, rel_path, line FROM v_refs WHERE target_name = 'fn_9' AND kind = 0) SELECT NOT EXISTS (FROM a EXCEPT ALL FROM b) AND NOT EXISTS (FROM b EXCEPT ALL FROM a) AS equal")
def ag_multiset_eq(s, d):
    return tables.same_multiset(graph.usages(v.refs(s, d), "fn_9"), graph.callers(v.refs(s, d), "fn_9"), ["target_name", "rel_path", "line"])


@query("so_distinct", f"WITH {REFS} SELECT DISTINCT rel_path, kind FROM v_refs")
def so_distinct(s, d):
    return v.refs(s, d).select("rel_path", "kind").distinct()


@query("so_union_changed", f"WITH {FILES} SELECT rel_path FROM v_files WHERE doc_id % 3 = 0 UNION SELECT rel_path FROM v_files WHERE doc_id % 5 = 0 UNION SELECT rel_path FROM v_files WHERE doc_id % 7 = 0")
def so_union_changed(s, d):
    f = v.files(s, d)
    part = lambda m: f.filter(F.col("doc_id") % m == 0).select("rel_path")
    return part(3).union(part(5)).union(part(7)).distinct()


@query("so_untracked_except", f"WITH {FILES} SELECT rel_path FROM v_files WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def so_untracked_except(s, d):
    f = v.files(s, d)
    return f.filter("doc_id % 2 = 0").join(f.filter("doc_id % 3 = 0"), "rel_path", "left_anti").select("rel_path")


@query("so_orderings", f"WITH {SYMBOLS} SELECT id, row_number() OVER (ORDER BY kind, rel_path, id) AS place FROM v_symbols WHERE name = 'fn_5'")
def so_orderings(s, d):
    return defs(s, d).select("id", F.col("def_order").cast("long").alias("place"))


@query("so_blocks", f"WITH {SYMBOLS} SELECT rel_path, string_agg(concat(start_line, '-', end_line), ',' ORDER BY start_line, end_line) AS blocks FROM v_symbols GROUP BY 1")
def so_blocks(s, d):
    b = F.array_sort(F.collect_list(F.struct("start_line", "end_line")))
    return v.symbols(s, d).groupBy("rel_path").agg(F.array_join(F.transform(b, lambda x: F.concat(x["start_line"], F.lit("-"), x["end_line"])), ",").alias("blocks"))


# -- full text, vectors, fusion ------------------------------------------------------------------------

_TOKENS = r"list_filter(regexp_split_to_array(lower(strip_accents(content)), '[^\p{L}\p{N}\p{Co}]+'), lambda t: t <> '')"
_DOCS = f"{FILES}, t AS (SELECT rel_path AS id, doc_id, {_TOKENS} AS tokens FROM v_files)"


def docs(s, d) -> DataFrame:
    """Whole files as chunks, for the ranking."""
    return v.files(s, d).select(F.col("rel_path").alias("id"), "doc_id", "rel_path", "content")


def _bm25_sql(*terms: str) -> str:
    """Of prefixes, all of them required."""
    f = [f"len(list_filter(tokens, lambda t: starts_with(t, '{t}')))" for t in terms]
    cols = ", ".join(f"{x} AS f{i}" for i, x in enumerate(f))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(f)))
    score = " + ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * dl * n / total))" for i in range(len(f)))
    return f"c AS (SELECT id, doc_id, len(tokens) AS dl, {cols} FROM t), w AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE AS total, {n} FROM c), b AS (SELECT id, doc_id, {score} AS score FROM c, w WHERE {' AND '.join(f'f{i} > 0' for i in range(len(f)))})"


@query("ft_tokenize", f"WITH {_DOCS} SELECT id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM t")
def ft_tokenize(s, d):
    t = words.tokens(F.col("content"))
    return docs(s, d).select("id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("ft_postings", f"WITH {_DOCS}, u AS (SELECT id, unnest(tokens) AS term FROM t) SELECT term, count(*) AS total, count(DISTINCT id) AS files FROM u GROUP BY 1")
def ft_postings(s, d):
    """Only an id that may occur in several rows is told apart from others; an empty one stands for a row of its own."""
    rows = docs(s, d)
    again = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    rows = with_hit(rows, filter_of(again, "id"), "id").withColumn("id", F.when(F.col("id").isNull() | F.col("_hit"), F.col("id")).otherwise(""))
    files = F.count_if(F.col("id") == "") + F.count_distinct(F.nullif("id", F.lit("")))
    return search.postings(rows).groupBy("term").agg(F.sum("tf").alias("total"), files.alias("files"))


@query("ft_bm25", f"WITH {_DOCS}, {_bm25_sql('th', 'an')} SELECT id, round(score, 6) AS score FROM b")
def ft_bm25(s, d):
    return search.bm25(docs(s, d), words.sanitize("th an")).select("id", F.round("score", 6).alias("score"))


@query("ft_prefix", f"WITH {_DOCS} SELECT id FROM t WHERE len(list_filter(tokens, lambda x: starts_with(x, 'licen'))) > 0")
def ft_prefix(s, d):
    return search.bm25(docs(s, d), "licen*").select("id")


_PHRASE = "len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'licensed' AND starts_with(tokens[i + 1], 'un'))) > 0"


@query("ft_phrase", f"WITH {_DOCS} SELECT id FROM t WHERE {_PHRASE}")
def ft_phrase(s, d):
    return search.matching(docs(s, d), "licensed_un*").select("id")


@query("ft_bm25_indexed", f"WITH {_DOCS}, {_bm25_sql('th', 'an')} SELECT id, round(score, 6) AS score FROM b")
def ft_bm25_indexed(s, d):
    rows = docs(s, d)
    return search.bm25_indexed(search.postings(rows), search.document_lengths(rows), words.sanitize("th an")).select("id", F.round("score", 6).alias("score"))


_SANITIZED = r"""SELECT conv_id, turn, CASE WHEN q = '' OR (length(q) > 1 AND starts_with(q, '"') AND ends_with(q, '"')) THEN q
  WHEN regexp_matches(q, '[^A-Za-z0-9_" \t\n\r\f\v]') THEN ''
  ELSE array_to_string(list_transform(list_filter(regexp_split_to_array(replace(q, '"', '""'), '[ \t\n\r\f\v]+'), lambda w: w <> ''), lambda w: w || '*'), ' ') END AS expression
  FROM (SELECT conv_id, turn, regexp_replace(substr(coalesce(text, ''), 1, turn * 20), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS q FROM conversations)"""


@query("ft_sanitize", _SANITIZED)
def ft_sanitize(s, d):
    """The first characters of each turn as someone might type them."""
    q = F.substring(F.coalesce("text", F.lit("")), F.lit(1), (F.col("turn") * 20).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", words.sanitized(q).alias("expression"))

_EITHER = f"{_PHRASE.replace('starts_with(tokens[i + 1], ' + chr(39) + 'un' + chr(39) + ')', 'tokens[i + 1] = ' + chr(39) + 'under' + chr(39))} OR len(list_filter(tokens, lambda x: x = 'scum')) > 0"


@query("flt_fts", f"WITH {_DOCS} SELECT doc_id FROM t WHERE {_EITHER}")
def flt_fts(s, d):
    return search.matching(docs(s, d), '"licensed under" OR scum').select("doc_id")


@query("jn_fts_semi", f"WITH {_DOCS} SELECT doc_id FROM t WHERE {_EITHER}")
def jn_fts_semi(s, d):
    """The rows that postings find, through a semi join."""
    rows = docs(s, d)
    hits = search.bm25_indexed(search.postings(rows), search.document_lengths(rows), '"licensed under" OR scum')
    return rows.join(hits.select("id"), "id", "left_semi").select("doc_id")


@query("jn_fts_chunks", f"WITH {_DOCS}, {_bm25_sql('scum')} SELECT doc_id, round(score, 6) AS score, t.rel_path FROM b JOIN v_files t USING (doc_id)")
def jn_fts_chunks(s, d):
    return docs(s, d).join(search.bm25(docs(s, d), "scum*"), "id").select("doc_id", F.round("score", 6).alias("score"), "rel_path")


@query("so_topk_bm25", f"WITH {_DOCS}, {_bm25_sql('the')} SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 9) DESC, id LIMIT 50")
def so_topk_bm25(s, d):
    return search.bm25(docs(s, d), "the*", 50).select("id", F.round("score", 6).alias("score"))


@query("ft_error_swallow", f"WITH {_DOCS} SELECT id FROM t WHERE false")
def ft_error_swallow(s, d):
    try:
        return search.bm25(docs(s, d), words.sanitize("foo AND bar")).select("id")
    except words.QuerySyntaxError:
        return search.bm25(docs(s, d), "").select("id")


_DISTANCE = f"{VECTORS}, q AS (SELECT vector AS qv FROM v_vec WHERE chunk_id = {ASKED}), n AS (SELECT chunk_id, round(list_distance(vector, qv), 6) AS distance FROM v_vec, q)"


@query("vs_knn", f"WITH {_DISTANCE} SELECT chunk_id, distance, round(1 - distance, 6) AS score FROM n ORDER BY distance, chunk_id LIMIT 25")
def vs_knn(s, d):
    return search.knn(v.vectors(s, d), asked(s, d)).withColumn("score", F.round("score", 6))


@query("so_topk_vec", f"WITH {_DISTANCE} SELECT chunk_id, distance FROM n ORDER BY distance, chunk_id LIMIT 50")
def so_topk_vec(s, d):
    return search.knn(v.vectors(s, d), asked(s, d), 50).select("chunk_id", "distance")


@query("vs_knn_map", f"WITH {_DISTANCE} SELECT chunk_id, round(1 - min(distance), 6) AS score FROM n GROUP BY 1 ORDER BY min(distance), chunk_id LIMIT 50")
def vs_knn_map(s, d):
    twice = v.vectors(s, d).unionByName(v.vectors(s, d))
    return search.knn(twice, asked(s, d), 50, repeated=True).select("chunk_id", F.round("score", 6).alias("score"))


@query("vs_metric", f"WITH {VECTORS}, q AS (SELECT vector AS qv FROM v_vec WHERE chunk_id = {ASKED}), n AS (SELECT chunk_id, round(list_cosine_distance(vector, qv), 6) AS distance FROM v_vec, q) SELECT chunk_id, distance FROM n ORDER BY distance, chunk_id LIMIT 25")
def vs_metric(s, d):
    return search.knn(v.vectors(s, d), asked(s, d), 25, search.cosine_distance).select("chunk_id", "distance")


@query("vs_knn_many", f"WITH {VECTORS}, q AS (SELECT chunk_id AS query_id, vector AS qv FROM v_vec WHERE chunk_id % 100 = 0), n AS (SELECT query_id, chunk_id, round(list_distance(vector, qv), 6) AS distance FROM v_vec, q), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM n) SELECT * FROM r WHERE rank <= 10")
def vs_knn_many(s, d):
    x = v.vectors(s, d)
    return search.knn_many(x, x.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query")), 10)


@query("jn_vec_meta", f"WITH {_DISTANCE}, k AS (SELECT * FROM n ORDER BY distance, chunk_id LIMIT 25), {FILES} SELECT rel_path, distance FROM k JOIN v_files ON doc_id = chunk_id")
def jn_vec_meta(s, d):
    top = search.knn(v.vectors(s, d), asked(s, d))
    return v.files(s, d).join(F.broadcast(top), F.col("doc_id") == F.col("chunk_id")).select("rel_path", "distance")  # at most 25 rows


_FUSED = f"""WITH {_DOCS}, {_bm25_sql('the')}, {_DISTANCE},
  vr AS (SELECT chunk_id AS id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM (FROM n ORDER BY distance, chunk_id LIMIT 50)),
  tr AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM (FROM b ORDER BY round(score, 9) DESC, doc_id LIMIT 50)),
  f AS (SELECT coalesce(vr.id, tr.id) AS id, coalesce(1.0 / (60 + vr.r), 0) + coalesce(1.0 / (60 + tr.r), 0) AS score FROM vr FULL JOIN tr ON vr.id = tr.id),
  top AS (SELECT * FROM f ORDER BY round(score, 12) DESC, id LIMIT 25)"""


def _lists(s, d):
    near = search.knn(v.vectors(s, d), asked(s, d), 50).select(F.col("chunk_id").alias("id"), "score")
    return near, search.bm25(docs(s, d).select(F.col("doc_id").alias("id"), "content"), "the*", 50)


for _name in ("fu_rrf", "so_topk_rrf"):

    @query(_name, _FUSED + " SELECT id, round(score, 6) AS score FROM top")
    def fu_rrf(s, d):
        return search.fuse(*_lists(s, d), 25).select("id", F.round("score", 6).alias("score"))


@query("so_rank", _FUSED + " SELECT id, CAST(r AS INTEGER) AS rank FROM tr")
def so_rank(s, d):
    return search.ranks(_lists(s, d)[1], "rank")


@query("so_union_ids", _FUSED + " SELECT count(*) AS ids FROM f")
def so_union_ids(s, d):
    near, found = _lists(s, d)
    return near.select("id").join(found.select("id"), "id", "full_outer").agg(F.count("*").alias("ids"))


@query("fu_hybrid_dispatch", _FUSED + " SELECT doc_id, round(score, 6) AS score FROM top JOIN v_files ON doc_id = id")
def fu_hybrid_dispatch(s, d):
    from lexiloom.engine import search as dispatch

    rows = docs(s, d).select(F.col("doc_id").alias("id"), "rel_path", "content")
    found = dispatch(rows, v.vectors(s, d), "the", asked(s, d), mode="hybrid")
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("ag_max_norm_search", _FUSED + " SELECT doc_id, round(100 * score / max(score) OVER (), 4) AS score FROM top JOIN v_files ON doc_id = id")
def ag_max_norm_search(s, d):
    from lexiloom.engine import percent

    rows = docs(s, d).select(F.col("doc_id").alias("id"), "rel_path", "content")
    return percent(search.hybrid(rows, v.vectors(s, d), "the", asked(s, d))).select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


# -- whole runs ------------------------------------------------------------------------------------------


@query("src_walk", f"WITH p AS ({_PATHS}) SELECT path, {_LANG_CASE} AS language FROM p WHERE {_LANG_CASE} IS NOT NULL AND NOT regexp_matches(path, '{patterns.ignore_regex()}') AND NOT starts_with(path, 'src/m1/')")
def src_walk(s, d):
    """What a walk keeps of a listing: known languages, nothing ignored, no submodule (sources.files.walk reads the files themselves)."""
    from lexiloom.sources.files import kept

    return kept(paths(s, d).withColumnRenamed("path", "rel_path"), ["src/m1", "src/m14"]).withColumnRenamed("rel_path", "path")


_NOW = CHUNKS.replace("WHERE text IS NOT NULL)", "WHERE text IS NOT NULL AND doc_id % 11 <> 0)").replace("substr(sha256(text), 1, 16) AS hash", "CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE substr(sha256(text), 1, 16) END AS hash")


@query("sm_incremental", f"WITH {_NOW} SELECT id, content FROM v_chunks")
def sm_incremental(s, d):
    """Only what differs is cut anew, what is gone is dropped: the same chunks as a full run over the new files."""
    from lexiloom.operators.chunks import sliding_chunks

    old, new = v.files(s, d).filter("doc_id % 13 <> 0"), some_files(s, d, 11)
    diff = tables.snapshot_diff(old, new)
    kept = tables.delete_paths(sliding_chunks(old, 5, 1), diff)
    renewed = sliding_chunks(new.join(diff.select("rel_path"), "rel_path", "left_semi"), 5, 1)
    return kept.unionByName(renewed).select("id", "content")


@query("sm_full", f"WITH {_NOW} SELECT id, content FROM v_chunks")
def sm_full(s, d):
    from lexiloom.operators.chunks import sliding_chunks

    return sliding_chunks(some_files(s, d, 11), 5, 1).select("id", "content")


_QUERY_TEXTS = "SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations"


@query("flt_is_regex", f"WITH c AS ({_QUERY_TEXTS}) SELECT conv_id, turn, regexp_matches(q, '[.*+?|()\\[\\]{{}}^$\\\\]') AS is_regex FROM c")
def flt_is_regex(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", patterns.has_marks(F.coalesce("text", F.lit(""))).alias("is_regex"))
