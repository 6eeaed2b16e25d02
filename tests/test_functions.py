import itertools
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import patterns as P
from lexiloom.functions import text as T
from lexiloom.operators import structural as S
from lexiloom.operators.extract import extract
from lexiloom.schema import REF_KINDS, SYMBOL_KINDS, branch_suffix


@pytest.mark.parametrize("query, want", [('"exact phrase"', '"exact phrase"'), ("", ""), ("hello world", "hello* world*"), ("a-b", ""), ("café", ""), ("foo_bar", "foo_bar*")])
def test_sanitize(query, want):
    assert T.sanitize(query) == want


def test_regex_marks():
    assert all(P.is_regex(c) for c in ".*+?|()[]{}^$\\") and not any(map(P.is_regex, ("hello", "foo bar", "a_b", "123")))


@pytest.mark.parametrize("path, pattern, want", [
    ("main.go", "*.go", True), ("main.go", "*.py", False), ("main_test.go", "*_test.go", True), ("pkg/main.go", "pkg/*.go", True), ("pkg/sub/main.go", "pkg/*.go", False),
    ("pkg/sub/main.go", "**/*_test.go", False), ("pkg/sub/main_test.go", "**/*_test.go", True), ("pkg/sub/main_test.go", "*_test.go", True),
])
def test_globs(path, pattern, want):
    assert bool(re.search(P.path_regex(pattern), path)) == want


@given(st.text("ab/.*?", max_size=8), st.text("ab/.", max_size=8))
def test_glob_without_marks_is_equality(pattern, path):
    if not P.has_glob(pattern):
        assert bool(re.search(P.glob_regex(pattern), path)) == (pattern == path)


def test_ignore():
    deep, flat = re.compile(P.ignore_regex()), re.compile(P.ignore_regex(compat=True))
    for path in (".git", "a/.git/config", "node_modules/x.js", "go.sum", "a/b.exe", "x.min.js"):
        assert deep.search(path)
    for path in ("main.go", "builder/a.go", "a/distance.py", "gitx/a"):
        assert not deep.search(path)
    assert deep.search("lib/x.min.js") and not flat.search("lib/x.min.js") and flat.search("x.min.js")


def test_java_regex():
    assert P.java_regex("a", True) == "a" and P.java_regex("a").startswith("(?iu)") and r"\b" not in P.java_regex(r"\bfoo\b")
    java = lambda p, t: bool(re.search(P.java_regex(p, True).replace(r"\p{Alpha}", "a-zA-Z").replace(r"\P{Digit}", r"\D"), t))
    assert java("(?P<n_1>ab)c", "abc") and java("(?<x>a)", "a") and java("[[:alpha:]]+1", "ab1") and not java("^[[:alpha:]]$", ":") and java("[[:^digit:]]", "x")
    assert java("[[a]", "[") and java("[]a]", "]") and P.java_regex(r"\p{Greek}\pL\p{Lu}\P{^Han}", True) == r"\p{IsGreek}\pL\p{Lu}\p{IsHan}" and java(r"\Qa.b\E", "a.b") and not java(r"\Qa.b\E", "axb")
    assert P.literal_factor(r"\x41bcd") is None and P.literal_factor(r"\pLetter") is None and P.literal_factor(r"\QabcE") is None and P.literal_factor(r"abc\.d") == "abc"
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "(?>a)", "(?U)a+"):
        with pytest.raises(ValueError):
            P.java_regex(bad)
    assert P.literal_factor("foo|bar") is None and P.literal_factor("abcd?x") == "abc" and P.literal_factor(r"licensed\s+under") == "licensed" and P.literal_factor("(abc)*d") is None


def test_queries_parse():
    a, b = T.Phrase(("a",), True), T.Phrase(("b",), False)
    assert T.parse("a* b") == ("and", a, b) and T.parse('"a b"') == T.Phrase(("a", "b"), False)
    assert T.parse("a* OR b") == ("or", a, b) and T.parse("a* NOT b") == ("not", a, b) and T.parse("foo_bar*") == T.Phrase(("foo", "bar"), True)
    assert T.parse("") is None and T.parse('""') is None
    for bad in ("foo* AND* bar*", '"', "a AND", "(a"):
        with pytest.raises(T.QuerySyntaxError):
            T.parse(bad)


WORDS = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubling sized hopping falling hissing fizzed failing filing happy sky relational conditional rational digitizer operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate effective bowdlerize probate rate cease controlling rolling running generalization oscillators".split()


def test_porter_against_fts5():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    for w in WORDS:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        assert T.porter(w) == db.execute("SELECT term FROM v").fetchone()[0], w


def rows(lang, text):
    return S.blocks(lang, text.split("\n"))


def test_blocks():
    assert rows("go", "package main\n\nfunc foo() {\n\tx()\n}\n\nfunc bar() {\n}\n") == [(3, 5, False), (7, 8, False)]
    assert rows("go", "func a()\n{\n  s := \"}\"\n}\n") == [(1, 4, False)]
    assert rows("python", "@d(\n  1)\n\ndef f():\n    return 1\n\nclass C:\n    pass") == [(1, 6, True), (7, 8, False)]
    assert rows("sql", "CREATE TABLE a (\n id INT\n);\n\n\nCREATE TABLE b (\n id INT\n);\n\n\n\nCREATE VIEW v AS\nSELECT 1;") == [(1, 3, False), (6, 8, False), (12, 13, False)]
    assert len(rows("sql", "CREATE FUNCTION f() AS $$\nBEGIN\n x;\n y;\nEND;\nCREATE TABLE t (a INT);")) == 2
    assert rows("ruby", "class A\n  def x\n  end\nend") == [(1, 4, False)]
    assert rows("toml", "[a]\nx = 1\n[b]\ny = 2") == [(1, 2, False), (3, 4, False)]
    assert rows("json", '{\n "a": {\n  "b": 1\n },\n "c": [\n  1\n ]\n}') == [(2, 4, False), (5, 7, False)]
    assert rows("rust", "#[derive(Debug)]\nstruct A {\n x: i32,\n}\n") == [(1, 4, True)]
    assert rows("cobol", "x") == [] and rows("go", "") == []


def test_every_language_has_a_start():
    lines = {"go": "func a() {", "python": "async def a():", "javascript": "export const f = (a) => {", "typescript": "namespace N {", "tsx": "function A() {", "rust": "pub fn a() {", "java": "public class A {", "c": "int main(void) {", "cpp": "class A {", "csharp": "public class A {", "ruby": "def a", "php": "function a() {", "swift": "func a() {", "kotlin": "fun a() {", "scala": "object A {", "sql": "create table a (", "zig": "pub fn a() void {", "bash": "f() {", "json": '"a": {', "yaml": "a:", "toml": "[a.b]", "markdown": "## A"}
    assert set(lines) == set(S.LANGUAGES) and all(S.is_start(k, v) for k, v in lines.items())
    assert not S.is_start("go", "x := 1")


@settings(max_examples=60)
@given(st.integers(0, 300), st.integers(1, 20), st.integers(0, 25), st.booleans())
def test_every_line_is_in_a_chunk(n, size, overlap, functions):
    lines = list(itertools.islice(itertools.cycle(["func a() {", " x", "}", ""] if functions else ["x"]), n))
    _, ranges = S.structural_ranges("go", lines, size, overlap)
    assert {i for a, b in ranges for i in range(a, b + 1)} == set(range(1, n + 1)) and all(b - a < size for a, b in ranges)


def names(lang, text):
    symbols, refs = extract(lang, "p/f", "h", text)
    return {(s[1], SYMBOL_KINDS[s[2]]) for s in symbols}, {(r[2], REF_KINDS[r[3]]) for r in refs}


def test_extraction():
    s, r = names("go", 'package a\nimport (\n\t"fmt"\n)\ntype Config struct {\n\tA int\n}\nfunc NewConfig() *Config {\n\treturn &Config{}\n}\nfunc (c *Config) Run() {\n\tfmt.Println(NewConfig())\n}\n')
    assert {("fmt", "import"), ("Config", "struct"), ("NewConfig", "function"), ("(*Config).Run", "method")} <= s and {("NewConfig", "calls"), ("Println", "calls"), ("Config", "instantiates")} <= r
    s, r = names("python", "import os, sys as t\nfrom a.b import c\nclass K:\n    def m(self):\n        return c(os.path.join('x'))\n")
    assert {("os", "import"), ("a.b.c", "import"), ("K", "class"), ("m", "function")} <= s and {("c", "calls"), ("join", "calls"), ("c", "imports")} <= r
    s, r = names("typescript", "import { A, B as C } from './x'\nexport class K {\n  go(a: number): void {\n    new A()\n  }\n}\nexport const f = (x) => g(x)\n")
    assert {("./x", "import"), ("K", "class"), ("go", "method"), ("f", "variable")} <= s and {("A", "imports"), ("A", "instantiates"), ("g", "calls")} <= r
    s, r = names("cpp", "#define N 3\nnamespace n {\nclass A {\n};\nvoid A::go(int x) {\n  call(x);\n}\n}\n")
    assert {("N", "constant"), ("n", "module"), ("A", "class"), ("(A).go", "method")} <= s and ("call", "calls") in r
    s, r = names("php", "<?php\nnamespace App;\nuse App\\Models\\{User, Post};\nclass A {\n  public function go() {\n    run();\n  }\n}\n")
    assert {("App\\Models\\User", "import"), ("A", "class"), ("go", "method")} <= s and {("run", "calls"), ("Post", "imports")} <= r
    s, r = names("rust", "pub struct A {\n}\nimpl A {\n  pub fn go(&self) {\n    println!(\"x\");\n    run();\n  }\n}\n")
    assert {("A", "struct"), ("go", "function")} <= s and {("println", "calls"), ("run", "calls")} <= r
    s, r = names("zig", 'const std = @import("std");\npub fn main() void {\n  go();\n}\n')
    assert ("main", "function") in s and {("std", "imports"), ("go", "calls")} <= r
    s, r = names("python", "import os\nclass A:\n    def f(self):\n        print 'x', g(1)\n")
    assert {("os", "import"), ("A", "class"), ("f", "function")} <= s and {("g", "calls"), ("os", "imports")} <= r
    assert extract("python", "p", "h", "def (") == ([], []) and extract("html", "p", "h", "x") == ([], []) and extract("go", "p", "h", None) == ([], [])


def test_go_groups_interfaces_and_types():
    s, r = names("go", "package a\n\ntype Foo struct {\n\tA, B Bar\n\tm map[Key]*pkg.Value `json:\"m\"`\n}\n\nvar (\n\tX, Y int = 1, 2\n\tz = make([]Item, 3)\n)\n\nconst (\n\tOne = iota\n\tTwo\n)\n\ntype Runner interface {\n\tRun(ctx Context, n int) (Result, error)\n\tStop()\n}\n\nfunc use(a, b Left, c *Right) Out {\n\tvar f Foo\n\t_ = f.(Other)\n\treturn Out{}\n}\n\nvar P, Q = 1, 2\n")
    assert {("X", "variable"), ("Y", "variable"), ("z", "variable"), ("One", "constant"), ("Two", "constant"), ("Runner", "interface"), ("Run", "method"), ("Stop", "method"), ("P", "variable"), ("Q", "variable"), ("Foo", "struct"), ("use", "function")} <= s
    assert {(t, "accessed") for t in ("Foo", "Bar", "Key", "Value", "Item", "Context", "Result", "error", "Left", "Right", "Out", "Other", "int")} <= r
    assert not {t for t, k in r if k == "calls"} & {"var", "const", "Run", "Stop", "use"} and ("Runner", "accessed") not in r and ("Out", "instantiates") in r
    s, _ = names("go", "package a\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB interface {\n\t\tGo()\n\t}\n\tC int\n)\n")
    assert {("A", "struct"), ("B", "interface"), ("C", "type"), ("Go", "method")} <= s


def test_types_of_other_languages():
    s, r = names("typescript", "class K extends Base implements Face {\n  go(a: Arg, n: number): Out<Inner> {\n    return new Made(a) as Cast\n  }\n}\n")
    assert {(t, "accessed") for t in ("K", "Base", "Face", "Arg", "Out", "Cast")} <= r and ("Made", "instantiates") in r and ("Made", "calls") not in r
    s, r = names("rust", "impl Shape for Circle {\n  fn area(&self, x: &Point, y: Vec<Item>) -> Result<Area, Error> {\n    helper(x)\n  }\n}\n")
    assert {(t, "accessed") for t in ("Shape", "Circle", "Point", "Vec", "Item", "Result", "Area", "Error")} <= r and ("helper", "calls") in r and not any(k == "class" for _, k in s)
    s, r = names("cpp", "struct Node {\n  Item *first;\n};\nOut make(const In &a, int n) {\n  std::vector<Part> parts;\n  return other(a);\n}\n")
    assert {(t, "accessed") for t in ("Node", "Item", "Out", "In", "Part")} <= r and ("int", "accessed") not in r and ("other", "calls") in r


def test_blocks_of_short_types_and_of_blank_lines():
    assert rows("go", "package main\n\ntype Foo int\n\nfunc bar() {}\n") == [(3, 3, False), (5, 5, False)]
    assert S.indent_end(["def foo", "  if cond", "    x", "  end", "end", "", "def bar", "end"], 0) == 4
    assert S.indent_end(["def f():", "    return 1", "", "", "x = 1"], 0) == 3
    assert rows("csharp", "class Foo : Bar\n{\n  int x;\n}") == [(1, 4, False)]
    assert [b[0] for b in rows("markdown", "# A\n\nText\n\n```go\nfunc H() {\n}\n```\n\n\n## B\n\n```python\ndef a():\n    pass\n```\n")] == [1, 5, 11, 13]
    assert rows("yaml", "server:\n  port: 1\n\ndb:\n  host: x\n")[0][0] == 1 and len(rows("yaml", "server:\n  port: 1\n\ndb:\n  host: x\n")) == 2
    assert rows("typescript", "@Comp({\n  a: 1\n})\nexport class A {\n}\n") == [(1, 5, True)]


def test_parsers_and_their_bounds():
    text = ("@d\ndef f():\n    s = \"\"\"\ndef no():\n\"\"\"\n    return s\n" + "x = 1\n" * 60).split("\n")
    assert S.ast_blocks("python", text) == [(1, 6, True)] and S.ast_blocks("go", text) == [] and S.ast_blocks("python", ["def ("]) == []
    parsed = S.structural_ranges("python", text, how=S.Cutting(skip_ast=False))[1]
    assert parsed[0] == (1, 6) and S.structural_ranges("python", text, how=S.Cutting(skip_ast=False, max_ast_lines=20))[1][0] == S.structural_ranges("python", text)[1][0] != parsed[0]
    assert not S.Cutting().parses(10) and not S.Cutting(skip_ast=False, min_ast_lines=20).parses(10) and S.Cutting(skip_ast=False).parses(2000) and not S.Cutting(skip_ast=False).parses(2001)


def test_branch_suffix():
    assert branch_suffix("w", "main") == "" and branch_suffix("w", "feature/a:b") == "-w-feature-a-b"


def test_a_stem_begins_as_its_word():
    ends = ("", "s", "es", "ies", "ed", "eed", "ing", "y", "ly", "e", "ll", "ion", "ness", "ful", "ational", "ization", "ement", "iviti", "sses", "ated", "izing")
    for n in (1, 2, 3, 4):
        for stem in itertools.product("abeiyzst", repeat=n):
            for end in ends:
                w = "".join(stem) + end
                assert T.porter(w)[0] == w[0]
    assert all(T.porter(e)[0] == e[0] for e in ends if e)


def test_word_count_is_that_of_tokens(spark):
    texts = ["", " ", "a", "İstanbul'da, ÀÉ x", "a\u0301b ǅ Ⅷ ½ ㍿ \ue000", "no.no  no", None]
    rows = spark.createDataFrame([(t,) for t in texts], "content string").select("content", T.word_count(F.col("content")).alias("n"), F.size(T.tokens(F.col("content"))).alias("tokens"))
    assert all(r["n"] == r["tokens"] for r in rows.collect() if r["content"] is not None)
