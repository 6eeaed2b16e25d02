"""Queries over source files made from the documents, whose blocks, chunks, symbols and references are known in closed form, and those that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators.embed import embedded, hashing
from lexiloom.operators.extract import extract_refs, extract_symbols
from lexiloom.operators.search import bm25
from lexiloom.operators.structural import structural_blocks, structural_chunks
from lexiloom.plans import registry
from lexiloom.plans.registry import docs, query
from lexiloom.sources import views as v
from lexiloom.sources.views import FILES
from lexiloom.storage import shared_dir

#: Languages in turn, so that every splitter and extractor runs over all documents: what opens and closes a block, and how a line of comment begins.
_SOURCE = {
    "go": ("func f{0}() {{", "}}", "// "), "python": ("def f{0}():", "    pass", "# "), "javascript": ("function f{0}() {{", "}}", "// "), "typescript": ("function f{0}() {{", "}}", "// "),
    "tsx": ("function f{0}() {{", "}}", "// "), "rust": ("fn f{0}() {{", "}}", "// "), "java": ("class f{0} {{", "}}", "// "), "c": ("int f{0}() {{", "}}", "// "), "cpp": ("void f{0}() {{", "}}", "// "),
    "csharp": ("class f{0} {{", "}}", "// "), "ruby": ("def f{0}", "end", "# "), "php": ("function f{0}() {{", "}}", "// "), "swift": ("func f{0}() {{", "}}", "// "), "kotlin": ("fun f{0}() {{", "}}", "// "),
    "scala": ("def f{0}() = {{", "}}", "// "), "sql": ("CREATE TABLE f{0} (", ");", "-- "), "zig": ("pub fn f{0}() void {{", "}}", "// "), "bash": ("f{0}() {{", "}}", "# "), "json": ('"f{0}": {{', "}},", "// "),
    "yaml": ("f{0}:", "  x: 1", "# "), "toml": ("[f{0}]", "x = 1", "# "), "markdown": ("# f{0}", "text", "> "),
}


def _cases(k: int) -> tuple[str, str, str, str]:
    """Language, the first two lines, the mark of a comment, and the last three lines."""
    language = list(_SOURCE)[k]
    opening, closing, mark = (x.format("1") for x in _SOURCE[language])
    return language, f"{opening}\n{closing}\n", mark, f"\n{_SOURCE[language][0].format('2')}\n    f1()\n{closing}"


def sources(s, d):
    """Every document as a source file of some language: a block of two lines, the text as a comment, a block of three lines."""
    which, cases = F.col("doc_id") % len(_SOURCE), [_cases(k) for k in range(len(_SOURCE))]
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in cases]), (which + 1).cast("int"))
    mark = pick(2)
    body = F.concat(mark, F.replace(F.col("content"), F.lit("\n"), F.concat(F.lit("\n"), mark)))
    return v.files(s, d).select("rel_path", pick(0).alias("language"), "hash", F.concat(pick(1), body, pick(3)).alias("content"))


def _listed(i: int) -> str:
    quoted = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "[" + ", ".join(quoted(_cases(k)[i]) for k in range(len(_SOURCE))) + "]"


# n: lines of comment. Sections run up to the next one; other blocks end where they close.
_SRC = f"""{FILES}, v_pick AS (SELECT *, CAST(doc_id % {len(_SOURCE)} + 1 AS INTEGER) AS k, length(content) - length(replace(content, chr(10), '')) + 1 AS n FROM v_files),
v_src AS (SELECT rel_path, hash, n, {_listed(0)}[k] AS language, {_listed(1)}[k] || {_listed(2)}[k] || replace(content, chr(10), chr(10) || {_listed(2)}[k]) || {_listed(3)}[k] AS content FROM v_pick),
v_blocks AS (SELECT *, unnest([1, n + 3]) AS a, unnest([CASE WHEN language IN ('toml', 'markdown') THEN n + 2 ELSE 2 END, n + 5]) AS b FROM v_src)"""


def _cut_sql(size: int, overlap: int) -> str:
    """Windows over blocks and over what lies between, or over the whole of a short file."""
    return f"""{_SRC}, v_parts AS (SELECT *, 'structural' AS strategy FROM v_blocks WHERE n + 5 > {size}
  UNION ALL SELECT *, 3, n + 2, 'structural' FROM v_src WHERE n + 5 > {size} AND language NOT IN ('toml', 'markdown') UNION ALL SELECT *, 1, n + 5, 'sliding' FROM v_src WHERE n + 5 <= {size}),
v_cut AS (SELECT *, a + {size - overlap} * unnest(range(0, CASE WHEN b - a + 1 <= {size} THEN 1 ELSE CAST(ceil((b - a + 1 - {size}) / {size - overlap}.0) AS BIGINT) + 1 END)) AS first FROM v_parts),
v_lines AS (SELECT *, CAST(first AS INTEGER) AS start_line, CAST(least(b, first + {size} - 1) AS INTEGER) AS end_line, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS lines FROM v_cut)"""


@query("st_blocks", f"WITH {_SRC} SELECT rel_path, language, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, false AS has_decorators FROM v_blocks")
def st_blocks(s, d):
    return structural_blocks(sources(s, d))


@query("ch_structural", f"WITH {_cut_sql(5, 1)} SELECT concat(hash, ':', rel_path, ':', start_line, '-', end_line) AS id, rel_path, language, start_line, end_line, array_to_string(lines[start_line:end_line], chr(10)) AS content, hash AS file_hash, strategy FROM v_lines")
def ch_structural(s, d):
    return structural_chunks(sources(s, d), 5, 1)


@query("ch_do_structural", f"WITH {_cut_sql(50, 10)} SELECT strategy, language, count(*) AS chunks, count(DISTINCT rel_path) AS files FROM v_lines GROUP BY 1, 2")
def ch_do_structural(s, d):
    return structural_chunks(sources(s, d), 50, 10).groupBy("strategy", "language").agg(F.count("*").alias("chunks"), F.countDistinct("rel_path").alias("files"))


#: Languages with an extractor; in them the blocks are functions.
_READ = "('go', 'python', 'javascript', 'typescript', 'tsx', 'rust', 'c', 'cpp', 'php', 'zig')"
_OPENED = "[" + ", ".join("'" + _SOURCE[k][0].format("{}").replace("{{", "{") + "'" for k in _SOURCE) + "]"


@query("gx_symbols", f"""WITH {_SRC}, f AS (SELECT *, CASE WHEN a = 1 THEN '1' ELSE '2' END AS number, list_position({_listed(0)}, language) AS k FROM v_blocks WHERE language IN {_READ})
  SELECT concat(hash, ':', rel_path, ':', a, ':f', number) AS id, concat('f', number) AS name, 0 AS kind, rel_path, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line,
    replace({_OPENED}[k], '{{}}', number) AS signature, language <> 'go' AS exported FROM f""")
def gx_symbols(s, d):
    return extract_symbols(sources(s, d))


@query("gx_refs", f"""WITH {_SRC}, c AS (SELECT *, concat(hash, ':', rel_path, ':', n + 4, ':call:f1') AS source_id FROM v_src WHERE language IN {_READ})
  SELECT concat(source_id, '->f1:calls:', n + 4) AS id, source_id, 'f1' AS target_name, 0 AS kind, rel_path, CAST(n + 4 AS INTEGER) AS line, 1.0::DOUBLE AS confidence FROM c""")
def gx_refs(s, d):
    return extract_refs(sources(s, d))


@query("ix_embed")
def ix_embed(s, d):
    return embedded(v.chunks(s, d, 50, 10), hashing(64))


@query("ft_bm25_stemmed")
def ft_bm25_stemmed(s, d):
    return bm25(docs(s, d), "license* version*", stemmed=True)


@query("sm_watch", registry.oracle_sql()["sm_latest"])
def sm_watch(s, d):
    """The change stream through Structured Streaming, once; the same as sm_latest."""
    from lexiloom.streaming.watch import live, watch

    here = shared_dir(s)
    raw = s.read.parquet(f"{d}/events.parquet")
    stream = s.readStream.schema(raw.schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    rows = stream.selectExpr("user_id AS file", "ts", "event_id", "event_type = 'error' AS deleted", "substr(sha2(coalesce(props, ''), 256), 1, 16) AS payload")
    watch(rows, f"{here}/state", f"{here}/checkpoint", once=True).awaitTermination()
    return live(s, f"{here}/state")
