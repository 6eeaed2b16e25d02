import corpus_pipeline as C
from lexiloom.llm.common import stored


def test_stages_survive_awkward_tables(spark, awkward, empty):
    for docs in (awkward, empty):
        rows = stored(docs)
        for k, (_, stage) in enumerate(C.STAGES):
            out = stored(stage(spark, rows, "/root/testdata/sf0.001"))
            if k < len(C.STAGES) - 1:
                assert out.columns == docs.columns
            else:
                assert {"doc_id", "start", "length", "tokens"} <= set(out.columns)
    assert stored(C.exact(spark, stored(awkward), "")).filter("doc_id = 5").count() == 2


def test_near_copies_go_and_one_stays(spark):
    words = [f"word{i}x{i * 7919 % 101}" for i in range(200)]
    copies = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(3, 180, 3)]
    docs = stored(spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(copies)] + [(7, " ".join(reversed(words)), "en", "s", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = [r["doc_id"] for r in C.near(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [100, 7, None]


def test_near_copies_by_fingerprints_go(spark):
    """Most of each text is one passage, and so is its fingerprint; as sets of shingles the texts are far apart."""
    passage = " ".join(f"p{i}x{i * 7919 % 101}" for i in range(31))
    texts = [" ".join([passage] * 40 + [f"t{k}y{i}" for i in range(24)]) for k in range(3)] + [" ".join(f"o{i}" for i in range(200))]
    docs = stored(spark.createDataFrame([(10 - i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r["doc_id"] for r in C.near(spark, docs, "").collect()) == [7, 8]


def test_run(spark):
    out = C.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.select("doc_id").distinct().count() < 200
