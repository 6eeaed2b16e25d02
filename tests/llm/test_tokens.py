import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import rans_store as R
from lexiloom.llm.common import shared_dir
from lexiloom.llm.fst_tokenizer import CompiledTokenizer
from lexiloom.llm.packing import pack, pieces_of
from lexiloom.llm.token_counts import token_counts

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return CompiledTokenizer(path), Tokenizer.from_file(path)


def cases(seed):
    r = random.Random(seed)
    letters = "ab ths  \n\t's're'll've'd'm'tE1234567890  !?.-_éßñçÀİ中文\x85\x1c\r\x0b👍 aeiouth"
    words = "don't we'll I'VE they're   and the\n\n <|endoftext|> <|startoftext|> it's's 're'foo 'll  ''s !'s \t x".split(" ")
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    out += [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(700)]
    return out + ["", " ", "\n", "a" * 3000, "abcdefgh" * 400, " " * 999, "é" * 500, "'" * 40]


def test_equals_the_library(both):
    machine, library = both
    texts = cases(1)
    ids, offsets = machine.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert machine.count(texts).tolist() == [len(w) for w in want]


def test_every_code_point(both):
    machine, library = both
    points = [c for c in (*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    for form in ("a{0}b {0}{0}", "{1}{0}x{0}{1}"):
        texts = [form.format(chr(c), chr(d)) for c, d in zip(points, points[1:] + points[:1])]
        ids, offsets = machine.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [hex(c) for c, a, b, w in zip(points, offsets, offsets[1:], want) if ids[a:b].tolist() != w] == []


def test_small_chunks_and_a_flushed_machine_change_nothing(both):
    machine, _ = both
    texts = cases(2)[:300]
    symbols, marks, _ = machine._stream([t for t in texts if "<|" not in t])
    want = machine.run(symbols, marks, chunk=10**9) & 63
    for chunk in (1, 2, 7):
        assert ((machine.run(symbols, marks, chunk=chunk) & 63) == want).all()
    before = machine.encode(texts)[0]
    machine._flush()
    assert (machine.encode(texts)[0] == before).all()


def test_null_is_empty(both):
    assert both[0].count([None, "", None]).tolist() == [0, 0, 0]
    assert both[0].count([]).tolist() == [] and len(both[0].encode([])[0]) == 0


def test_token_counts(awkward, empty):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    got = Counter(tuple(r) for r in token_counts(awkward, limit=100).collect())
    want = Counter()
    for r in awkward.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 100)] += 1
    assert got == want
    assert token_counts(empty).count() == 0


def test_pieces_are_powers_of_two_without_gaps():
    lengths = np.array([1, 2, 3, 2047, 2048, 2049, 6000, 4096])
    doc, start, size = pieces_of(lengths, 2048)
    for d, n in enumerate(lengths):
        own = [(s, k) for x, s, k in zip(doc, start, size) if x == d]
        assert [s for s, _ in own] == np.cumsum([0] + [k for _, k in own])[:-1].tolist() and sum(k for _, k in own) == n
        assert all(k & (k - 1) == 0 and k <= 2048 for _, k in own)


def test_pack(awkward, empty):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    rows = pack(awkward.filter("doc_id <> 5")).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    for doc in {r["doc_id"] for r in rows}:
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        assert b"".join(r["tokens"] for r in own) == np.array(ids, "<u4").tobytes() and own[0]["doc_tokens"] == len(ids)
        assert all(1 << r["bucket"] == r["length"] for r in own)
    assert pack(empty).count() == 0
    assert pack(awkward.filter("doc_id is null")).count() > 0


def test_rans_round_trip_and_damage():
    g = np.random.default_rng(0)
    blocks = [g.zipf(1.3, n).clip(1, 49_000).astype(np.uint32) for n in (1, 63, 64, 65, 5000, 65_536, 16_384, 16_385, 2 * 16_384)]
    t = R.table_of(np.bincount(np.concatenate(blocks), minlength=49_408))
    assert int(t.frequency.sum()) == 1 << R.SCALE
    coded = R.encode_blocks(blocks, t)
    assert all((a == b).all() for a, b in zip(blocks, R.decode_blocks([(len(b), *c) for b, c in zip(blocks, coded)], t)))
    payload = R.packed(blocks[4], np.zeros(0, R._DOC), coded[4])
    assert (R.decode_blocks([R.unpacked(payload)[0]], t)[0] == blocks[4]).all()
    with pytest.raises(ValueError):
        R.unpacked(payload[:-1] + bytes([payload[-1] ^ 1]))
    assert R.table_of(np.zeros(3, int)).frequency.sum() == 1 << R.SCALE
    assert R.table_of(np.array([5])).frequency.tolist() == [1 << R.SCALE]


def test_files_hold_every_document_in_order(spark, awkward, empty, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    path = shared_dir(spark)
    R.write_ids(awkward, path, part_bytes=30_000)
    got = sorted(R.read_ids(spark, path).collect(), key=lambda r: r["start"])
    want = Counter((r["doc_id"], zlib.crc32(np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in awkward.collect())
    assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    path = shared_dir(spark)
    R.write_ids(empty, path)
    assert R.read_ids(spark, path).count() == 0
