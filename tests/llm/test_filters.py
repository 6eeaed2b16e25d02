import datetime as dt
import random

from pyspark.sql import functions as F

from lexiloom.llm.decontaminate import budget, find_items, myers, normal, pieces_of
from lexiloom.llm.url_filter import filter_urls, host_of, intervals, keys_of


def slow(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(1)
    for _ in range(500):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(a, 70))) for a in (1, 0))
        assert myers(p, t) == slow(p, t)


def test_pieces():
    for n in (1, 5, 40):
        for k in (0, 3, 4):
            assert "".join(p for _, p in pieces_of("x" * n, k)) == "x" * n


def test_items_are_found_with_edits(spark, awkward, empty):
    r = random.Random(2)
    items = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(30))) for i in range(20)] + [(90, ""), (91, None), (None, "nothing")]
    docs = []
    for k in range(60):
        body = items[k % 20][1]
        for _ in range(k % 4 * 2):
            at = r.randrange(len(body))
            body = body[:at] + r.choice(["", "z", "zz"]) + body[at + 1 :]
        docs.append((k, "some words before  " + body.upper().replace(" ", "\n", 3) + " and behind"))
    docs.append((60, "nothing to be found here"))
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for cut in (2_000_000, 1500, 500):  # one block, some, and more than are searched at a time
        got = {x["doc_id"]: {h["item_id"]: h["distance"] for h in x["hits"]} for x in find_items(rows, table, cut=cut).collect()}
        for k, t in docs:
            want = {}
            for i, item in items:
                if i is not None and item:
                    n = normal(item)
                    if (e := slow(n, normal(t)) if k % 5 == 0 or i == k % 20 else 99) <= int(len(n) * 0.06):
                        want[i] = e
            assert got[k] == want
    assert find_items(awkward, table).count() == awkward.count() and find_items(empty, table).count() == 0
    assert find_items(awkward, table.limit(0)).filter(F.size("hits") > 0).count() == 0
    assert set(find_items(awkward, table).columns) == set(awkward.columns)


def test_benchmarks_that_differ_only_in_the_middle(spark):
    docs = spark.createDataFrame([(1, "the second of the long items is here in full")], "doc_id long, text string").coalesce(1)
    for middle, want in (("something else entirely that nobody has", []), ("second of the long items is here", [2])):
        items = spark.createDataFrame([(1, "first item of a benchmark"), (2, middle), (3, "last item of a benchmark")], "item_id long, text string")
        assert [h["item_id"] for h in find_items(docs, items).first()["hits"]] == want


def test_short_items_have_their_whole_budget():
    assert all(budget("x" * n, 0.06) == int(n * 0.06) for n in range(3000))


def test_urls(spark, empty):
    urls = {"https://User@WWW.Example.com.:80/a/b/c.html?q#f": "www.example.com", "http://x.org": "x.org", "no url": "", None: ""}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("h"), keys_of(F.col("url")).alias("k")).collect()
    assert {r["url"]: r["h"] for r in rows} == urls
    keys = {r["url"]: set(r["k"]) for r in rows}
    assert keys[list(urls)[0]] == {"www.example.com", "example.com", "www.example.com/", "www.example.com/a/", "www.example.com/a/b/"}
    assert keys[None] == set() == keys["no url"]


def test_a_url_of_very_many_parts(spark):
    url = "http://" + "a." * 100_000 + "c.org/" + "x/" * 100_000
    pages = spark.createDataFrame([(1, url, dt.date(2024, 2, 1)), (2, "http://a.c.org/x/x/x", dt.date(2024, 2, 1))], "page_id long, url string, day date")
    changes = spark.createDataFrame([(e, a, dt.date(2024, 1, 1)) for e, a in (("c.org", "add"), ("a.c.org/x/x/", "add"), ("a.c.org/x/", "other"))], "entry string, action string, day date")
    assert [(r["n_entries"], r["entry"]) for r in filter_urls(pages, changes, F.col("day")).orderBy("page_id").collect()] == [(1, "c.org"), (2, "a.c.org/x/x/")]


def test_as_of(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    r = random.Random(3)
    changes = [(r.choice(["a.com", "b.a.com", "c.org", "c.org/x/", None]), r.choice(["add", "remove"]), day(r.randrange(60)) if r.random() > 0.05 else None) for _ in range(80)]
    pages = [(k, r.choice(["http://a.com/", "http://b.a.com/q", "http://c.org/x/y", "http://d.org/", None, "http://"]), day(r.randrange(70)) if r.random() > 0.1 else None) for k in range(120)]
    pages += pages[:3]
    c = spark.createDataFrame(changes, "entry string, action string, day date")
    p = spark.createDataFrame(pages, "page_id long, url string, day date")
    match = {"http://a.com/": {"a.com"}, "http://b.a.com/q": {"a.com", "b.a.com"}, "http://c.org/x/y": {"c.org", "c.org/x/"}}
    want = []
    for k, u, d in pages:
        active = set()
        for e in match.get(u, ()):
            past = [x for x in changes if x[0] == e and x[2] and d and x[2] <= d]
            if past:
                last = max(x[2] for x in past)
                active |= {e} if max(x[1] for x in past if x[2] == last) == "add" else set()
        want.append((k, d, bool(active), len(active), min(active, default=None)))
    for limit in (200_000, 0):
        got = [tuple(x) for x in filter_urls(p, c, F.col("day"), broadcast_rows=limit).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert filter_urls(p.limit(0), c, F.col("day")).count() == 0
    assert intervals(c.limit(0)).count() == 0
