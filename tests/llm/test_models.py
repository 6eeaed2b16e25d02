import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import bloom_lm as L
from lexiloom.llm.language_id import fit_languages, predict_languages, windows_of
from lexiloom.llm.quality import STATISTICS, fit_quality, grow, quality_scores, statistics

DATA = "/root/testdata/sf0.001"


def test_windows_cover_whole_texts():
    texts = ["", "a", "b" * 255, "c" * 256, "d" * 257, "é" * 5000]
    windows, owner, weight = windows_of(texts)
    for i, t in enumerate(texts):
        assert weight[owner == i].sum() >= len(t.encode()) - 4
        seen = b"".join(bytes(w) for w in windows[owner == i])
        assert set(seen) - {0} == set(t.encode())


def test_languages_of_held_out_texts(spark, awkward, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = fit_languages(docs.filter(~held_out))
    got = predict_languages(docs.filter(held_out), net, keep={"lang": F.col("lang")}).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    odd = predict_languages(awkward, net).toPandas()
    texts = awkward.toPandas()
    assert len(odd) == len(texts)
    for text, lang in zip(texts.text, odd.lang_pred):
        assert (lang == "und") == (text is None or not re.search(r"[^\W\d_]", text))
    assert predict_languages(empty, net).count() == 0
    assert set(predict_languages(awkward, fit_languages(empty)).toPandas().lang_pred) == {"und"}


def slow_network(net, window):
    """The forward pass byte by byte."""
    n = len(net.bias)
    best = [-math.inf] * n
    x = [net.embedding[b] for b in window]
    for at in range(len(x) - 4):
        patch = np.concatenate(x[at : at + 5]).astype(float)
        for f in range(n):
            best[f] = max(best[f], float(patch @ net.filters[:, f]))
    z = [net.offset[c] + sum(max(b + o, 0) * w for b, o, w in zip(best, net.bias, net.weights[:, c])) for c in range(len(net.labels))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_network_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) < 900")
    net = fit_languages(docs, a_label=30)
    assert set(net.labels) == {r[0] for r in docs.filter("lang is not null").select("lang").distinct().collect()}
    rows = [r for r in docs.limit(12).collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    got = {r["text"]: r for r in predict_languages(docs.limit(12), net, keep={"text": F.col("text")}).collect()}
    for row in rows:
        windows, _, weight = windows_of([row["text"]])
        p = np.average([slow_network(net, w) for w in windows], axis=0, weights=weight)
        assert math.isclose(got[row["text"]]["score"], p.max(), rel_tol=1e-3) and got[row["text"]]["lang_pred"] == net.labels[int(p.argmax())]


def test_rare_labels_are_learnt(spark):
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 3} {chr(97 + i % 26)}{chr(97 + i // 26)} word", f"l{i % 80}") for i in range(800)] + [(None, "some text", None)], "doc_id long, text string, lang string")
    assert len(fit_languages(docs).labels) == 80


def test_trees_learn_and_repeat():
    g = np.random.default_rng(1)
    x = g.normal(size=(800, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    forest = grow(x[:600], y[:600])
    assert ((forest.scores(x[600:]) > 0.5) == y[600:]).mean() > 0.9
    assert (grow(x[:600], y[:600]).scores(x) == forest.scores(x)).all()

    def walk(row):
        total = forest.base
        for k in forest.roots:
            while forest.left[k] != k:
                k = forest.left[k] if row[forest.feature[k]] <= forest.limit[k] else forest.right[k]
            total += forest.value[k]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.scores(x[:50]), [walk(r) for r in x[:50]])


def test_quality(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    forest = fit_quality(docs, labels)
    got = quality_scores(docs, forest).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    odd = quality_scores(awkward, forest, keep={"extra": F.col("score")})
    assert odd.count() == awkward.count() and odd.filter("score between 0 and 1").count() == awkward.count()
    assert quality_scores(empty, fit_quality(empty, labels.limit(0))).count() == 0
    assert statistics([None, "", "a b"]).shape == (3, len(STATISTICS)) and not statistics([None, ""]).any()


def filled(grams, bits=L.BITS, buckets=4, lots=1, lot=0):
    """A filter of {kind: (keys, counts)}."""
    regions = {}
    for b in range(lot, buckets, lots):
        own = [(np.full((p := L.places(k, x, buckets) == b).sum(), k, np.uint8), x[p], L.level(n[p])) for k, (x, n) in grams.items()]
        regions[b] = L.region(*map(np.concatenate, zip(*own)), bits)
    return L.LogBloom(buckets, regions)


def test_filter_holds_levels():
    keys = np.arange(5000, dtype=np.int64) * 7919
    counts = np.random.default_rng(0).zipf(1.5, 5000).clip(1, 10**6)
    f = filled({L.WORD: (keys, counts)})
    assert (f.levels(L.WORD, keys) >= L.level(counts)).all() and (f.levels(L.WORD, keys) == L.level(counts)).mean() > 0.95
    assert (f.levels(L.PAIR, keys) > 0).mean() < 0.04
    assert (L.amount(L.level(counts)) <= counts + 1e-9).all() and (L.above(L.level(counts)) >= counts - 1e-9).all()
    parts = [filled({L.WORD: (keys, counts)}, lots=2, lot=k).levels(L.WORD, keys) for k in (0, 1)]
    assert (np.maximum(*parts) == f.levels(L.WORD, keys)).all() and not (np.minimum(*parts) > 0).any()


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def test_model_against_brute_force():
    training = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "the the the mat", "Über straße the cat"] * 3 + ["rare words only here"]
    words, pairs = Counter(), Counter()
    for t in training:
        w = split(t)
        words.update(w)
        pairs.update(zip(w, w[1:]))
    low = lambda n: 2.0 ** ((1 + math.floor(2 * math.log2(n) + 1e-9) - 1) / 2) if n else 0.0
    high = lambda n: 2.0 ** ((1 + math.floor(2 * math.log2(n) + 1e-9)) / 2) if n else 1.0
    key = lambda ws: L.keys_of([w.encode() for w in ws])
    pair_keys = L.pairs_of(key([w for p in pairs for w in p]), np.arange(2, 2 * len(pairs) + 1, 2))[1]
    number = lambda c: np.array(list(c.values()))
    f = filled({L.WORD: (key(words), number(words)), L.PAIR: (pair_keys, number(pairs))}, bits=400)
    total, v = sum(words.values()), len(words)
    model = L.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), total, v, np.random.default_rng(1).dirichlet(np.ones(4), L._SIDES))

    def probability(w, h):
        level = 1 + math.floor(2 * math.log2(words[h]) + 1e-9) if h and words[h] else 0
        side = 1 + min(level // 4, L._SIDES - 2) if level else 0
        parts = [low(words[w]) / total, 1 / (v + 1), float(not words[w]), min(low(pairs[h, w]) / high(words[h]), 1) if h else 0]
        return sum(a * b for a, b in zip(parts, model.weights[side]))

    texts = [*training[:6], "the unknown cat", "mat mat dog Über", None]
    keys, ends = L.tokens_of(texts)
    got = model.logs(L.looked_up(f, keys, ends))
    want = [math.log10(probability(w, h)) for t in texts for h, w in zip([None, *split(t)], split(t))]
    assert np.allclose(got, want, atol=1e-9)
    for h in (None, "the", "rare", "nowhere"):
        assert sum(probability(w, h) for w in [*words, "any that is unknown"]) <= 1 + 1e-9


def brute(texts, training):
    c = Counter(w for t in training for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t))) for t in texts]


def test_scores(spark, awkward, empty, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    training, scores = docs.filter("doc_id % 7 <> 2"), []
    for head in (1_000_000, 50):  # all words in the head, and most behind the join
        monkeypatch.setattr(L, "HEAD", head)
        got = L.score_texts(docs, training, filter_bits=1 << 29 if head > 50 else 1 << 20).orderBy("doc_id").collect()
        rows = docs.orderBy("doc_id").collect()
        for r, w in zip(got, brute([x["text"] for x in rows], [x["text"] for x in rows if x["doc_id"] % 7 != 2])):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and abs(r["base_score"] - w[3]) < 1e-6 * abs(w[3])
        scores.append({r["doc_id"]: r["score"] for r in got})
    assert all(math.isclose(scores[0][k], scores[1][k], rel_tol=1e-9) for k in scores[0])  # one lot of the filter or several
    held = [r for r in got if r["doc_id"] % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    odd = L.score_texts(awkward, awkward).collect()
    assert len(odd) == awkward.count() and all(math.isfinite(r["score"]) for r in odd)
    assert len(L.score_texts(awkward, empty).collect()) == awkward.count()
    assert L.score_texts(empty, awkward).count() == 0


def test_weights_are_fitted_on_every_training_text(spark):
    """Against expectation maximisation in plain Python over all tokens of 1,500 texts, by the filter's levels; training as a table or as a condition."""
    g = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in (g.zipf(1.3, 12) % 500 if i % 2 else g.integers(0, 3000, 30))) for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    training = docs.filter("doc_id % 4 <> 2")
    words = L.word_counts(training)
    n, distinct = words.selectExpr("sum(n)", "count(*)").first()
    buckets = 1 << max(0, -(-n // L.BUCKET) - 1).bit_length()
    lot = L.Lots(L.gathered(words, training, "text", buckets), buckets, 1 << 30).lot(0)
    start = np.array([[0.7, 0.2, 0.1, 0.0]] + [[0.4, 0.1, 0.1, 0.4]] * (L._SIDES - 1))
    model = L.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), n, distinct, start.copy())
    parts, side = model.parts(L.looked_up(lot, *L.tokens_of([t for i, t in enumerate(texts) if i % 4 != 2])), left_out=1)
    for k in range(L._SIDES):
        own, w = np.maximum(parts[side == k], 1e-30), start[k]
        for _ in range(30 if len(own) else 0):
            w = (own * w / (own * w).sum(axis=1, keepdims=True)).mean(axis=0)
        model.weights[k] = 0.999 * w + 0.001 * start[k]
    keys, ends = L.tokens_of(texts)
    want = np.add.reduceat(model.logs(L.looked_up(lot, keys, ends)), np.append(0, ends[:-1]))
    for learnt in (training, F.col("doc_id") % 4 != 2):
        got = {r["doc_id"]: r["score"] for r in L.score_texts(docs, learnt).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-9)
