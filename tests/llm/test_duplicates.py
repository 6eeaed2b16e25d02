import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import simhash
from lexiloom.llm.common import stored
from lexiloom.llm.components import components
from lexiloom.llm.exact_dedup import exact_dedup, normal_text
from lexiloom.llm.simhash import fingerprints_of, links, near_duplicates, shingle_hashes, simhash_classes


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(awkward, empty):
    got = exact_dedup(awkward, carry={"sha": F.sha2(normal_text(F.col("text")), 256)}).collect()
    assert len(got) == awkward.count()
    rows = awkward.collect()
    groups = Counter(normal(r["text"]) for r in rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = sha[r["sha"]]
        ids = [x["doc_id"] for x in rows if normal(x["text"]) == t]
        assert r["group_size"] == groups[t]
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    kept = Counter(r["sha"] for r in got if r["kept"])
    assert set(kept) == set(sha) and set(kept.values()) == {1}
    assert exact_dedup(empty).count() == 0


def test_a_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = exact_dedup(docs)
    assert got.filter("kept").count() == 4001 and got.filter("group_size = 2000 and keep_id = 0").count() == 2000


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    g = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in g.integers(0, 300, (200, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == union_find({x for p in pairs for x in p}, pairs)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_lose_nothing(spark):
    g = np.random.default_rng(4)
    centres = g.integers(0, 1 << 63, 12, np.uint64)
    prints = set(int(c) for c in centres)
    for c in centres:
        for _ in range(25):
            x = int(c)
            for b in g.integers(0, 64, g.integers(1, 5)):
                x ^= 1 << int(b)
            prints.add(x)
    dense = [int(centres[0]) ^ x for x in range(0, 1 << 12, 3)]  # rows that are dealt again, and again
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints | set(dense))
    for radius in (0, 1, 2):
        want = union_find(prints, [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius])
        found = links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius).collect()
        assert all(bin((r["u"] ^ r["v"]) & (1 << 64) - 1).count("1") <= radius for r in found)
        assert union_find(prints, [(r["u"], r["v"]) for r in found]) == want


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_classes(spark, awkward, empty):
    rows = awkward.collect()
    got = simhash_classes(awkward).collect()
    key = lambda f: f"{f & (1 << 64) - 1:016x}"
    assert Counter((r["doc_id"], key(r["fp"])) for r in got) == Counter((r["doc_id"], key(slow_print(r["text"]))) for r in rows)
    prints = sorted({r["fp"] for r in got})
    top = union_find(prints, [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    least = {}
    for r in got:
        if r["doc_id"] is not None:
            least[top[r["fp"]]] = min(least.get(top[r["fp"]], r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(top[r["fp"]]) for r in got)
    assert simhash_classes(empty).count() == 0
    assert near_duplicates(empty).count() == 0


def test_long_texts_are_summed_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(210_000))
    h = np.array(shingle_hashes(text, 3), np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    got = fingerprints_of([shingle_hashes("a b c d", 3), h.tolist(), shingle_hashes("e f", 3), []]).view(np.uint32)
    assert int(got[1][0]) << 32 | int(got[1][1]) == want
    assert int(got[0][0]) << 32 | int(got[0][1]) == slow_print("a b c d") and not got[3].any()


def test_near_duplicates(spark):
    g = np.random.default_rng(5)
    word = lambda: "".join(g.choice(list("abcdefghij"), g.integers(2, 9)))
    texts, family = [], []
    for f in range(40):
        base = [word() for _ in range(int(g.integers(80, 300)))]
        for _ in range(30 if f == 0 else 1 + f % 3):
            own = list(base)
            for at in g.integers(0, len(own), 1 if len(texts) % 2 else 2):
                own[at] = word()
            texts.append(" ".join(own))
            family.append(f)
    sets = [set(shingle_hashes(t, 5)) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    want = union_find({x for p in near for x in p}, near)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)
    assert all(family[a] == family[b] for a, b in got.items())


def brute_classes(texts):
    """Components at a similarity of 0.8, by an inverted index over all shingles."""
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = []
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j < i)
        pairs += [(i, j) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9]
    return union_find({x for p in pairs for x in p}, pairs)


def found_classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}


def test_near_pairs_inside_a_template_family(spark):
    g = np.random.default_rng(6)
    template = [f"t{i}" for i in range(200)]
    texts = []
    for pair in range(1000):
        base = list(template)
        for at in g.choice(200, 10, replace=False):
            base[at] = f"p{pair}x{at}"
        for side in range(2):
            own = list(base)
            own[int(g.integers(0, 200))] = f"s{pair}y{side}"
            texts.append(" ".join(own))
    texts = [texts[i] for i in g.permutation(len(texts))]
    want = brute_classes(texts)
    assert len(want) > 1800 and found_classes(spark, texts) == want


def test_near_pairs_by_blocks_and_of_short_texts(spark):
    texts = []
    for n in (6, 12, 30, 100, 300, 1000):  # words, and a block of new ones up to a similarity of 0.8
        for k in range(40):
            base = [f"w{n}x{k}y{i}" for i in range(n)]
            new = [f"v{n}x{k}y{i}" for i in range(max(1, (n - 4) // 5 - k % 3))]
            at = (n, 0, n // 2)[k % 3]
            texts += [" ".join(base), " ".join(base[:at] + new + base[at:]), " ".join(base[len(new) :] if k % 2 else base[: n - len(new)])]
        texts += [" ".join(base), " ".join(base)]  # equal sets
    want = brute_classes(texts)
    assert len(want) > 500 and found_classes(spark, texts) == want


def test_a_large_group_costs_few_candidates_a_member(spark, monkeypatch):
    """One class of 600 texts, of which 33,267 pairs of 179,700 are similar: one text links few of the others."""
    g = np.random.default_rng(8)
    texts = []
    for k in range(600):
        own = [f"b{i}" for i in range(150)]
        for at in g.choice(150, 2, replace=False):
            own[at] = f"c{k}x{at}"
        texts.append(" ".join(own))
    seen, verified = [], simhash._verified

    def counted(pairs, *rest):
        pairs = stored(pairs)
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    want = brute_classes(texts)
    assert set(want.values()) == {0} and len(want) == 600 and found_classes(spark, texts) == want
    assert sum(seen) < 20 * len(texts)
