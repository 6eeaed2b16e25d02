import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import queries as Q
from lexiloom.llm.packing import write_buckets

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = Q.op1_packing(spark, D).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(texts) and len({r["sequence_id"] for r in rows}) == len(rows)
    for doc, own in by.items():
        ids = library.encode(texts[doc], add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["ids_crc32"], r["doc_tokens"], r["offset"], r["length"]) == (at, crc(ids[at : at + r["length"]]), len(ids), 0, 1 << r["bucket"])
            at += r["length"]
        assert at == len(ids)


def test_files(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(Q.op7_binary_ids(spark, D).collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_columns(spark, texts):
    want = {"op2_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op3_quality": {"doc_id", "held_out", "score", "predicted"}, "op4_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op8_simhash": {"doc_id", "fingerprint", "component_id"}}
    for name, columns in want.items():
        got = Q.queries()[name](spark, D).toPandas()
        assert columns <= set(got.columns) and sorted(got.doc_id) == sorted(texts)
        if "held_out" in columns:
            k, left = (4, 2) if name[2] == "2" else (5, 0)
            assert (got.held_out == [zlib.crc32(str(i).encode()) % k == left for i in got.doc_id]).all() and got.score.between(0, 1).all()
    assert got.fingerprint.str.fullmatch("[0-9a-f]{16}").all() and (got.component_id <= got.doc_id).all()


def test_buckets(spark, tmp_path):
    from lexiloom.llm.common import table
    from lexiloom.llm.packing import pack

    pieces = pack(table(spark, D, "documents").limit(20))
    write_buckets(pieces, f"file://{tmp_path}/b")
    back = spark.read.parquet(f"file://{tmp_path}/b")
    assert back.count() == pieces.count() and back.filter("length <> shiftleft(1L, bucket) or octet_length(tokens) <> 4 * length").count() == 0
