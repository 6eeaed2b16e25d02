import math
import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom import arrow
from lexiloom.engine import Engine, search as dispatch
from lexiloom.functions import text as T
from lexiloom.operators import extract, graph, search, structural, tables
from lexiloom.operators.embed import cut, embedded, hashing
from lexiloom.operators.grep import grep, line_matches
from lexiloom.plans import index, registry
from lexiloom.sources import files as sources
from lexiloom.streaming import watch as W

CHUNK = "id string, rel_path string, language string, start_line int, end_line int, content string"


def chunks(spark, *texts, language="go"):
    return spark.createDataFrame([(f"c{i}", f"f{i}.go", language, 1, 9, t) for i, t in enumerate(texts)], CHUNK)


@pytest.mark.parametrize("line, query, cs, want", [("getter", "get", False, False), ("get value", "get", False, True), ("call get", "get", False, True), ("get", "get", False, True), ("Get value", "get", True, False), ("Get value", "get", False, True)])
@pytest.mark.parametrize("compat", [False, True])
def test_whole_word(spark, line, query, cs, want, compat):
    assert spark.range(1).select(line_matches(F.lit(line), query, cs, True, compat)).first()[0] == want


def test_whole_word_later_in_the_line(spark):
    one = lambda compat: spark.range(1).select(line_matches(F.lit("getter get"), "get", False, True, compat)).first()[0]
    assert one(False) and not one(True)


def test_grep(spark):
    c = chunks(spark, "Hello World", "func hello() {\n hello\n}", "nothing", "échelle ÉCOLE")
    got = grep(c, "hello").collect()
    assert [(r["id"], r["score"]) for r in got] == [("c1", 1.0), ("c0", 0.25)] and [m["line"] for m in got[0]["matches"]] == [1, 2]
    assert [r["id"] for r in grep(c, "Hello", case_sensitive=True).collect()] == ["c0"]
    assert [r["id"] for r in grep(c, "func.*hello").collect()] == ["c1"] and [r["id"] for r in grep(c, "(é)cole").collect()] == ["c3"]
    assert grep(c, "").count() == 0 and grep(c, "hello", language="python").count() == 0 and grep(c, "hello", path="f0*").count() == 1
    assert grep(chunks(spark, *["hello"] * 30), "hello", 99).count() == 25
    assert dispatch(c, None, "hello", [], mode="grep").columns == CHUNK.replace(",", "").split()[::2] + ["score"]


def test_knn(spark):
    v = spark.createDataFrame([("c1", [0.9, 0.1, 0.0, 0.0]), ("c2", [0.1, 0.9, 0.0, 0.0]), ("c2", [0.9, 0.1, 0.0, 0.1]), ("odd", [1.0])], "chunk_id string, vector array<double>")
    got = search.knn(v, [0.9, 0.1, 0, 0], 5, repeated=True).collect()
    assert [(r["chunk_id"], r["distance"]) for r in got] == [("c1", 0.0), ("c2", 0.1)]


@pytest.mark.parametrize("rows, block", [(16384, 4096), (40, 7)])
def test_knn_many_against_brute_force(spark, rows, block):
    """Near ties, copies, a constant far from zero, another size and a null, in one cell and in many; a cell has all its work (the cross join took a task to each file)."""
    rng = random.Random(5)
    some = [[1000 + rng.randrange(3) / 1e6 * rng.random() for _ in range(4)] for _ in range(150)] + [[rng.random() for _ in range(4)] for _ in range(100)]
    some += [[0.5] * 4] * 60
    v = spark.createDataFrame([*enumerate(some), (900, [1.0]), (901, [None, 0.0, 0.0, 0.0]), (902, None)], "chunk_id long, vector array<double>")
    q = v.filter("chunk_id % 9 = 0").selectExpr("chunk_id AS query_id", "vector AS query")
    got = {}
    found = search.knn_many(v, q, 10, rows, block)
    assert "CartesianProduct" not in plan(found) and "Join" not in plan(found)
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["chunk_id"])
    near = search.l2(F.col("vector"), F.col("query"))
    want = {}
    for r in v.filter("chunk_id < 900").crossJoin(q.filter("query_id < 900")).select("query_id", "chunk_id", F.round(near, 6).alias("d")).collect():
        want.setdefault(r["query_id"], []).append((r["d"], r["chunk_id"]))
    want = {k: dict(enumerate(sorted(x)[:10], 1)) for k, x in want.items()}
    assert {k: x for k, x in got.items() if k < 900} == want and got.get(900) == {1: (0.0, 900)}


TEXTS = ["the running fox runs", "a lazy dog", "foo_bar baz", "the fox and the dog, the café", "running dogs bark", "Licensed under the Apache License", "", "no no no, no yes"]


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("expression", ["the*", "the* fox*", '"the fox"', "foo_bar*", "running*", "run*", '"fox" OR "dog"', "the* NOT dog*", "cafe*", "zzz*", "dog* bark* running*", '"no no"', '"no no n" *', '"the café"'])
def test_bm25_against_fts5(spark, expression, stemmed):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize='{'porter ' if stemmed else ''}unicode61')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(TEXTS)))
    want = {f"c{i}": s for i, s in db.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (expression,))}
    got = {r["id"]: r["score"] for r in search.bm25(chunks(spark, *TEXTS), expression, stemmed=stemmed).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    if not stemmed:
        index = search.postings(c := chunks(spark, *TEXTS)), search.document_lengths(c)
        assert {r["id"] for r in search.matching(c, expression).collect()} == set(want)
        got = {r["id"]: r["score"] for r in search.bm25_indexed(*index, expression).collect()}
        assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_emitted_gives_rows_on_as_they_are_made():
    """A batch used to hold the rows of all files of a batch that Spark had sent."""
    made = []
    rows = (made.append(i) or (i, "x" * 100) for i in range(1000))
    batches = arrow.emitted(rows, pa.schema([("n", pa.int32()), ("t", pa.string())]), 1000)
    first = next(batches)
    assert first.num_rows == len(made) < 10 and [*first["n"].to_pylist(), *(n for b in batches for n in b["n"].to_pylist())] == list(range(1000))
    assert list(arrow.emitted([], pa.schema([("n", pa.int32())]))) == []


@pytest.mark.parametrize("made", [lambda f: structural.structural_chunks(f, 5, 1), structural.structural_blocks, extract.extract_symbols, extract.extract_refs, lambda f: embedded(f, hashing(8), 3)])
def test_python_reads_small_batches(spark, made):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(64 << 20))
    files = spark.createDataFrame([(f"c{i}", f"f{i}.go", "go", f"h{i}", f"func f{i}() {{\n  g()\n}}\n" * 9) for i in range(10)], "id string, rel_path string, language string, hash string, content string")
    try:
        got = made(files)
        assert int(spark.conf.get(key)) <= arrow.ARROW_BYTES and got.count() >= 10
    finally:
        spark.conf.unset(key)


def test_embedded_in_batches(spark):
    rows = embedded(chunks(spark, *TEXTS), hashing(8), 3).collect()
    assert {r["chunk_id"]: r["vector"] for r in rows} == {f"c{i}": x.tolist() for i, x in enumerate(hashing(8)(TEXTS))} and len(rows) == len(TEXTS)


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_makes_words_once_a_scan(spark):
    """A filter of the counts used to make the words of a text anew for each of its terms."""
    assert plan(search.bm25(chunks(spark, *TEXTS), "th* an*")).count("regexp_replace(") == 2
    assert plan(search.matching(chunks(spark, *TEXTS), '"licensed under" OR scum')).count("regexp_replace(") == 1


def test_postings_make_words_once(spark):
    """The filter before the generator made the words of a text twice more, each word of an expression read the index anew, and all words were shuffled."""
    index = search.postings(c := chunks(spark, *TEXTS, None)), search.document_lengths(c)
    assert plan(index[0]).count("regexp_replace(") == 1 and "Aggregate" not in plan(index[0]) and plan(index[1]).count("regexp_replace(") == 0
    assert plan(search.bm25_indexed(*index, '"licensed under" OR scum OR the*')).count("regexp_replace(") == 2


@pytest.mark.parametrize("stemmed", [False, True])
def test_postings(spark, stemmed):
    got = {(r["term"], r["id"]): r["positions"] for r in search.postings(chunks(spark, *TEXTS, None, "..", "Ünï 日本 running runs"), stemmed).collect() if r["tf"] == len(r["positions"])}
    want = {}
    for i, t in enumerate([*TEXTS, "", "", "Ünï 日本 running runs"]):
        for pos, w in enumerate(T.split(t)):
            want.setdefault((T.porter(w) if stemmed else w, f"c{i}"), []).append(pos)
    assert got == want


def test_postings_of_repeated_documents(spark, tmp_path):
    rows = [(1, "a b a", "x", "en"), (1, "a c", "x", "en"), (2, "a", "x", "en"), (3, None, "x", "en"), (4, "a d", None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["term"]: (r["total"], r["files"]) for r in registry.queries()["ft_postings"](spark, str(tmp_path)).collect()}
    assert got["a"][0] == 5 and got["b"] == got["c"] == (1, 1) and got["d"][0] == 1


def test_an_index_read_once_gives_each_phrase_its_words(spark):
    """A term in several phrases, a phrase of one word twice, words next to each other in single and longer phrases."""
    index = search.postings(c := chunks(spark, *TEXTS, "fox fox fox the fox")), search.document_lengths(c)
    for e in ("fox OR fo* OR \"the fox\"", '"fox fox" fo*', '"the fox" NOT dog*', '"fox the" OR bark*', '"no no" OR "no yes" OR the'):
        want, got = ({r["id"]: round(r["score"], 9) for r in x.collect()} for x in (search.bm25(c, e), search.bm25_indexed(*index, e)))
        assert want == got and want


def test_stemmed_bm25_shuffles_no_words(spark):
    """It used to make postings of all words, and to join each with its stem."""
    rows = search.bm25(chunks(spark, *TEXTS), "licens* fox*", stemmed=True)
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_hybrid(spark):
    c = chunks(spark, "hello world", "goodbye world")
    v = spark.createDataFrame([("c0", [1.0, 0.0]), ("c1", [0.0, 1.0])], "chunk_id string, vector array<double>")
    got = search.hybrid(c, v, "hello", [1.0, 0.0]).orderBy(F.desc("score")).collect()
    assert got[0]["id"] == "c0" and math.isclose(got[0]["score"], 2 / 61) and math.isclose(got[1]["score"], 1 / 62)
    assert search.hybrid(c, v, "foo AND bar", [1.0, 0.0]).count() == 2 and search.hybrid(c, v, "hello", [1.0, 0.0], path="f1").count() == 1


SYMBOL = "id string, name string, kind int, rel_path string, start_line int, end_line int, signature string"
REF = "id string, source_id string, target_name string, kind int, rel_path string, line int"


def test_resolve_and_symbol_info(spark):
    s = spark.createDataFrame([("w1", "detect", 0, "a/w.go", 1, 9, ""), ("i1", "detect", 0, "b/i.go", 1, 9, ""), ("m", "(*H).Serve", 1, "b/h.go", 1, 5, "")], SYMBOL)
    r = spark.createDataFrame([("r1", "x", "detect", 0, "a/w.go", 20), ("r2", "y", "detect", 0, "b/i.go", 3), ("r3", "z", "detect", 0, "c/q.go", 3), ("r4", "z", "none", 0, "c/q.go", 3), ("u1", "z", "detect", 6, "a/other.go", 3), ("k", "q", "run", 0, "a/w.go", 4)], REF)
    done = graph.resolve(r, s)
    assert {x["id"]: x["target_id"] for x in done.collect()} == {"r1": "w1", "r2": "i1", "r3": "i1", "r4": None, "u1": "i1", "k": None}
    got = {(x["def_id"], x["role"], x["ref_id"]) for x in graph.symbol_info(s, done, "detect").collect()}
    assert {("w1", "caller", "r1"), ("i1", "caller", "r2"), ("i1", "caller", "r3"), ("w1", "usage", "u1"), ("w1", "callee", "k"), ("i1", "callee", "r2")} == got
    assert [x["id"] for x in graph.definitions(s, "Serve").collect()] == ["m"]
    assert graph.formatted(graph.symbol_info(s, done, "detect")).count() == 2


def test_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, x int")
    twice = tables.upsert(tables.upsert(old, new), new)
    assert sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert tables.same_multiset(old, old, ["id", "x"]).first()[0] and not tables.same_multiset(old, new, ["id", "x"]).first()[0]


def test_index_of_a_source_tree(spark, tmp_path):
    root, store = tmp_path / "src", f"file://{tmp_path}/index"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "main.go").write_text('package main\nimport "fmt"\nfunc main() {\n\tHelper()\n}\n')
    (root / "pkg" / "a.py").write_text("import os\ndef helper():\n    return os.getcwd()\n")
    (root / "node_modules" / "x.js").write_text("var a = 1\n")
    (root / "notes.xyz").write_text("unknown")
    embed = hashing(16)
    listing = sources.walk(spark, f"file://{root}")
    assert {(r["rel_path"], r["language"]) for r in listing.collect()} == {("main.go", "go"), ("pkg/a.py", "python")}
    index.index_all(listing, store, embed)
    e = Engine(spark, store, embed=embed)
    assert [r[0] for r in e.list_files().collect()] == ["main.go", "pkg/a.py"] and e.stats().first()["files"] == 2
    assert e.grep("helper").count() == 2 and e.search("helper").first()["score"] == 100 and e.find_imports("os").count() == 1
    assert e.symbol_info("helper").count() == 1
    (root / "main.go").write_text("package main\nfunc other() {\n}\n")
    (root / "pkg" / "a.py").unlink()
    diff = {r["rel_path"]: r["change"] for r in index.index_changed(spark, sources.walk(spark, f"file://{root}"), store, embed).collect()}
    assert diff == {"main.go": "modified", "pkg/a.py": "deleted"} and [r[0] for r in e.list_files().collect()] == ["main.go"]
    assert {r["name"] for r in e.table("symbols").collect()} == {"other"}


def test_cut_keeps_whole_characters():
    assert len(cut("é" * 1000).encode()) == 1200 and cut("a" + "é" * 1000).encode().__len__() == 1199
    assert hashing(8)(["", "a b"]).shape == (2, 8)


def test_stream_equals_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, registry.queries()["sm_latest"](spark, d).collect()))
    raw = spark.read.parquet(f"{d}/events.parquet")
    path, source = f"file://{tmp_path}/state", f"{tmp_path}/in"
    rows = lambda df: df.selectExpr("user_id AS file", "ts", "event_id", "event_type = 'error' AS deleted", "substr(sha2(coalesce(props, ''), 256), 1, 16) AS payload")
    for k in (1, 0, 1):  # late changes, and some twice
        raw.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw.schema).parquet(source)
        W.watch(rows(stream), path, f"{tmp_path}/checkpoint", once=True).awaitTermination()
    assert sorted(map(tuple, W.live(spark, path).collect())) == want


def test_a_run_that_stops_leaves_the_last_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert tables.read(spark, path, "x int").count() == 0
    tables.overwrite(spark.createDataFrame([(1,)], "x int"), path)
    for left in ([], ["part-0.parquet"]):  # a folder that was begun, with and without files
        (tmp_path / "t" / "v=1").mkdir(exist_ok=True)
        for f in left:
            (tmp_path / "t" / "v=1" / f).write_text("no Parquet")
        assert [r[0] for r in tables.read(spark, path).collect()] == [1]
    for k in (2, 3, 4):
        tables.overwrite(tables.read(spark, path).unionByName(spark.createDataFrame([(k,)], "x int")), path)
    assert sorted(r[0] for r in tables.read(spark, path).collect()) == [1, 2, 3, 4] and len(tables.versions(spark, path)) == 2


def test_parts_are_renewed_alone(spark, tmp_path):
    path, made = f"file://{tmp_path}/t", lambda rows: spark.createDataFrame(rows, "rel_path string, x int")
    rows = [(f"f{k}", k) for k in range(300)]
    shown = lambda: sorted(map(tuple, tables.read(spark, path).collect()))
    tables.overwrite_parts(made(rows), path)
    assert shown() == sorted(rows)
    part = made(rows[:1]).select(tables.part_of()).first()[0]
    own = {r["rel_path"] for r in tables.read(spark, path, parts=[part]).collect()}
    assert own == {r["rel_path"] for r in made(rows).filter(tables.part_of() == part).collect()} and "f0" in own
    (tmp_path / "t" / f"v=1-{1 << part:x}").mkdir()  # a run that stopped
    assert shown() == sorted(rows)
    before = set((tmp_path / "t").glob("v=0-*/part=*/*"))
    tables.renew(spark, path, [part], lambda old: old.filter("x > 0"))
    assert shown() == sorted(rows[1:]) and before == set((tmp_path / "t").glob("v=0-*/part=*/*"))
    assert {f.name for f in (tmp_path / "t").glob("v=1-*/part=*")} <= {f"part={part}"}
    for _ in range(3):  # a part that ends up empty, again and again; versions that nothing needs go
        tables.renew(spark, path, [part], lambda old: old.limit(0))
    assert shown() == [r for r in sorted(rows) if r[0] not in own] and tables.versions(spark, path) == [4, 3, 0]
    tables.overwrite(tables.read(spark, path).filter("x < 9"), path)
    tables.renew(spark, path, [part], lambda old: old.filter("x < 7"))  # not in parts before: all of it
    assert shown() == [r for r in sorted(rows) if r[1] < 7 and r[0] not in own]
    tables.overwrite_parts(made([]), path)
    assert shown() == [] and tables.read(spark, path).columns == ["rel_path", "x"]


def test_the_steps_of_a_start(spark, tmp_path):
    root, store = tmp_path / "src", f"file://{tmp_path}/index"
    root.mkdir()
    (root / "a.go").write_text("package a\nfunc one() {\n\ttwo()\n}\n")
    (root / "b.go").write_text("package a\nfunc two() {\n}\n")
    walk = lambda branch="main": sources.walk(spark, f"file://{root}", branch=branch)
    embed = hashing(8)
    assert index.start(spark, walk(), store, "s1", embed=embed) == "full" and index.start(spark, walk(), store, "s1", embed=embed) == "current"
    (root / "b.go").write_text("package a\nfunc three() {\n}\n")
    assert index.start(spark, walk(), store, "s2", embed=embed, cancelled=lambda: True) == "cancelled" and index.start(spark, walk(), store, "s2", embed=embed) == "incremental"
    e = Engine(spark, store, embed=embed)
    assert {r["name"] for r in e.table("symbols").collect()} == {"one", "three"} and e.search("three").first()["rel_path"] == "b.go"
    other = f"file://{tmp_path}/other"
    (root / "c.go").write_text("package a\nfunc four() {\n}\n")
    assert index.start(spark, walk("dev"), other, "s3", {"main": store, "none": f"file://{tmp_path}/none"}, embed) == "seeded"
    assert {r["name"] for r in Engine(spark, other, "dev", embed).table("symbols").collect()} == {"one", "three", "four"}
    for name in ("symbols", "refs"):
        tables.overwrite(tables.read(spark, f"{other}/{name}").filter("rel_path <> 'a.go'"), f"{other}/{name}")
    assert [r[0] for r in index.refs_missing(spark, walk("dev"), other).collect()] == ["a.go"] and index.refs_missing(spark, walk("dev"), other).count() == 0
    assert not index.ignore_changed(spark, other, (), ("c.go",)) and index.ignore_changed(spark, other, ("c.go",), ("b.go",))
    assert [r[0] for r in Engine(spark, other, "dev", embed).list_files().collect()] == ["a.go"]


def test_what_git_knows(tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-b", "main")
    (tmp_path / "a.go").write_text("package a\n")
    git("add", "."), git("commit", "-m", "one")
    first = sources.head_sha(str(tmp_path))
    git("checkout", "-b", "dev")
    (tmp_path / "b.go").write_text("package b\n")
    git("add", "."), git("commit", "-m", "two")
    (tmp_path / "a.go").write_text("package c\n")
    (tmp_path / "new.go").write_text("package d\n")
    root = str(tmp_path)
    assert len(first) == 40 and sources.branch_name(root) == "dev" and sources.branch_exists(root, "main") and not sources.branch_exists(root, "none") and set(sources.local_branches(root)) == {"main", "dev"}
    assert sources.merge_base(root, "main", "dev") == first and set(sources.changed_files(root, first)) == {"a.go", "b.go", "new.go"} and set(sources.changed_files(root)) == {"a.go", "new.go"}
    assert sources.worktree_name(root) == tmp_path.name and sources.head_sha(str(tmp_path.parent)) in ("", first)
