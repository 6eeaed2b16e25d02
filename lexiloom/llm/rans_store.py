"""Token ids in files of entropy-coded blocks: static range asymmetric numeral systems (rANS).

One frequency table over all ids is shared by all blocks. A block holds whole documents (only a
document longer than a block is cut), is coded by 64 interleaved lanes, and can be decoded by itself; within it,
checkpoints (the lanes' states and a place in the words) let parts be decoded side by side. Blocks are
rows of a Parquet table, so they are written and read through Spark on any file system, and a lost task is simply run again.

A block, little-endian: ``LXR1``; u32 tokens, u32 words, u32 checkpoints, u32 documents, u32 crc32 of the words,
u32 crc32 of the ids (as u32); for each checkpoint u32 words before it and 64 u64 states; for each document
i64 doc_id, u8 null, u32 ids before it in its document, u32 ids here, u8 last; then the words (u32).
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped, removed, stored
from .fst_tokenizer import compiled
from .packing import with_end

LANES, SCALE = 64, 20
#: Ids of a block at most, and steps of all lanes between checkpoints.
BLOCK, STEPS = 1 << 16, 256
_MAGIC, _HEAD = b"LXR1", struct.Struct("<4s6I")
_LOW = np.uint64(1 << 31)
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("before", "<u4"), ("here", "<u4"), ("last", "u1")])
#: Ids of blocks coded at a time.
_GROUP = 48


@dataclass
class Table:
    frequency: np.ndarray  # sums to 1 << SCALE
    start: np.ndarray
    symbol: np.ndarray  # of each slot
    common: int  # fills the last step of a block


def table_of(counts: np.ndarray) -> Table:
    """Frequencies in proportion, at least 1 for every id that occurs; what is over or missing is settled with the most frequent ones."""
    counts = np.asarray(counts, np.int64)
    if not counts.sum():
        counts = np.ones(1, np.int64)
    total = 1 << SCALE
    if (counts > 0).sum() > total:
        raise ValueError("more ids than the table has slots")
    f = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) / counts.sum() * total).astype(np.int64)), 0)
    order = np.argsort(-counts, kind="stable")
    k = 0
    while (gap := total - int(f.sum())) != 0:
        s = order[k % len(order)]
        f[s] += gap if gap > 0 else -min(-gap, max(0, int(f[s]) // 2))
        k += 1
    start = np.cumsum(f) - f
    return Table(f.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(f), dtype=np.uint32), f), int(order[0]))


def encode_blocks(blocks: list[np.ndarray], t: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block its words, and for each checkpoint the words before it and the states; all blocks in lockstep."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    steps = np.array([-(-len(blocks[i]) // LANES) for i in order])
    most = int(steps.max(initial=0))
    ids = np.full((most, len(order), LANES), t.common, np.uint32)
    for r, i in enumerate(order):
        full = np.full(steps[r] * LANES, t.common, np.uint32)
        full[: len(blocks[i])] = blocks[i]
        ids[: steps[r], r] = full.reshape(-1, LANES)
    state = np.full((len(order), LANES), _LOW)
    word, out = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
    marks: list[list] = [[] for _ in order]
    for k in range(most - 1, -1, -1):
        a = int(np.searchsorted(-steps, -k, side="left"))  # blocks with more than k steps
        x, s = state[:a], ids[k, :a]
        f = t.frequency[s]
        full = x >= f << np.uint64(63 - SCALE)
        word[k, :a], out[k, :a] = x & np.uint64(0xFFFFFFFF), full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:a] = (q << np.uint64(SCALE)) + (x - q * f) + t.start[s]
        if k % STEPS == 0:
            for r in range(a):
                marks[r].append(state[r].copy())
    done: list = [None] * len(blocks)
    for r, i in enumerate(order):
        own = out[: steps[r], r]
        before = np.append(0, np.cumsum(own.sum(axis=1)))[: steps[r] : STEPS]
        done[i] = word[: steps[r], r][own], before.astype(np.uint32), np.array(marks[r][::-1], np.uint64).reshape(-1, LANES)
    return done


def decode_blocks(blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], t: Table) -> list[np.ndarray]:
    """Ids of blocks given as (tokens, words, words before each checkpoint, states): all parts between checkpoints in lockstep."""
    parts = []  # steps, block, first step, place in the words
    flat, base = [np.zeros(1, np.uint32)], 1
    for i, (n, words, before, _) in enumerate(blocks):
        steps = -(-n // LANES)
        parts += [(min(STEPS, steps - c * STEPS), i, c, base + int(b)) for c, b in enumerate(before)]
        flat.append(words)
        base += len(words)
    parts.sort(key=lambda p: -p[0])
    flat = np.concatenate(flat)
    steps, place = np.array([p[0] for p in parts], int), np.array([p[3] for p in parts], np.int64)
    state = np.array([blocks[i][3][c] for _, i, c, _ in parts], np.uint64).reshape(-1, LANES)
    ids = np.zeros((len(parts), STEPS, LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for k in range(int(steps.max(initial=0))):
        a = int(np.searchsorted(-steps, -k, side="left"))
        x = state[:a]
        slot = x & mask
        s = t.symbol[slot.astype(np.int64)]
        ids[:a, k] = s
        x = t.frequency[s] * (x >> np.uint64(SCALE)) + slot - t.start[s]
        low = x < _LOW
        at = np.cumsum(low, axis=1)
        more = flat[np.where(low, place[:a, None] + at - 1, 0)]
        state[:a] = np.where(low, x << np.uint64(32) | more, x)
        place[:a] += at[:, -1]
    out = [np.empty(-(-n // LANES) * LANES, np.uint32) for n, *_ in blocks]
    for r, (n, i, c, _) in enumerate(parts):
        out[i][c * STEPS * LANES :][: n * LANES] = ids[r, :n].reshape(-1)
    return [o[:n] for o, (n, *_) in zip(out, blocks)]


def packed(ids: np.ndarray, docs: np.ndarray, coded: tuple) -> bytes:
    words, before, states = coded
    data = words.astype("<u4").tobytes()
    head = _HEAD.pack(_MAGIC, len(ids), len(words), len(before), len(docs), zlib.crc32(data), zlib.crc32(ids.astype("<u4").tobytes()))
    return b"".join([head, before.astype("<u4").tobytes(), states.astype("<u8").tobytes(), docs.tobytes(), data])


def unpacked(payload: bytes) -> tuple[tuple, np.ndarray, int]:
    """What decode_blocks takes, the documents, and the checksum of the ids."""
    magic, n, n_words, marks, n_docs, crc, ids_crc = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a block of ids")
    at = _HEAD.size
    before = np.frombuffer(payload, "<u4", marks, at)
    at += 4 * marks
    states = np.frombuffer(payload, "<u8", marks * LANES, at).reshape(-1, LANES)
    at += 8 * marks * LANES
    docs = np.frombuffer(payload, _DOC, n_docs, at)
    at += _DOC.itemsize * n_docs
    if zlib.crc32(payload[at:]) != crc or len(payload) - at != 4 * n_words:
        raise ValueError("a block's words are damaged")
    return (n, np.frombuffer(payload, "<u4", n_words, at), before, states), docs, ids_crc


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = 2, part_bytes: int = 8 << 20) -> None:
    """Encodes every whole text, appends end_id, and writes path/table and path/blocks in ascending doc_id order (null first, ties by ids).

    Null and empty texts are end_id alone. doc_id must be an integer. Each text is tokenised once, to
    a table in the shared folder that is deleted at the end; from it come the counts over all ids
    (summed by task, then by id) and, dealt by ranges of (doc_id, length, hash) so that even repeated ids are
    spread, the blocks. Ids come from the compiled form of the vocabulary (fst_tokenizer), equal to the tokenizers library's.
    """
    spark = docs.sparkSession

    def tokenised(batches):
        machine = compiled(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = with_end(*machine.encode(batch.column(1).to_pylist()), end_id)
            ends = np.append(0, np.cumsum(sizes)) * 2
            if ids.max() > 0xFFFF:
                raise ValueError("ids of more than 16 bits")
            data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
            yield pa.record_batch([batch.column(0), data], names=["doc_id", "ids"])

    def counted(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=1 << 16)
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own), pa.array(total[own])], names=["id", "n"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = stored(mapped(rows, tokenised, "doc_id long, ids binary"))
    counts = mapped(ids.select("ids"), counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.coalesce(1)
    counts.write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    size = ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = int(min(100_000, max(1, -(-size // part_bytes))))

    def coded(batches):
        t, part, number, before = shared.value, TaskContext.get().partitionId(), 0, 0
        waiting: list[tuple[np.ndarray, list]] = []
        now, now_docs, held = [], [], 0

        def close():
            nonlocal now, now_docs, held
            if held:
                waiting.append((np.concatenate(now), now_docs))
            now, now_docs, held = [], [], 0

        def flush():
            nonlocal number, before
            out = []
            for (x, listed), c in zip(waiting, encode_blocks([x for x, _ in waiting], t)):
                out.append((part, number, before, len(x), packed(x, np.array(listed, _DOC), c)))
                number, before = number + 1, before + len(x)
            waiting.clear()
            return pa.record_batch([pa.array(list(v), k) for v, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "block", "before", "tokens", "payload"])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(data.as_py(), "<u2").astype(np.uint32)
                if held + len(x) > BLOCK:
                    close()
                for a in range(0, len(x), BLOCK):
                    piece = x[a : a + BLOCK]
                    now.append(piece)
                    now_docs.append((key or 0, key is None, a, len(piece), a + len(piece) == len(x)))
                    held += len(piece)
                    if held >= BLOCK:
                        close()
                if len(waiting) >= _GROUP:
                    yield flush()
        close()
        if waiting:
            yield flush()

    order = ["doc_id", F.octet_length("ids"), F.xxhash64("ids")]
    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    mapped(dealt, coded, "part int, block int, before long, tokens long, payload binary").write.parquet(f"{path}/blocks")
    removed(ids)


def read_table(spark: SparkSession, path: str) -> Table:
    """The shared frequency table: a row for each id that occurs, so of the vocabulary's size at most."""
    rows = spark.read.schema("id long, n long").parquet(f"{path}/table").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(int)] = rows["n"].to_numpy(int)
    return table_of(counts)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian u32) of every document in the files.

    Blocks are decoded in any order, with both checksums held. Only documents longer than a block are put together by a shuffle.
    """
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.schema("part int, block int, before long, tokens long, payload binary").parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    offsets = totals.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("offset"))

    def decoded(batches):
        for batch in batches:
            before = batch.column(0).to_pylist()
            for a in range(0, batch.num_rows, _GROUP):
                opened = [unpacked(x.as_py()) for x in batch.column(1)[a : a + _GROUP]]
                for ids, (_, docs, crc), first in zip(decode_blocks([o[0] for o in opened], shared.value), opened, before[a : a + _GROUP]):
                    data = ids.astype("<u4").tobytes()
                    if zlib.crc32(data) != crc:
                        raise ValueError("a block's ids are not those that were written")
                    here = docs["here"].astype(np.int64)
                    ends = np.append(0, np.cumsum(here))
                    start = first + ends[:-1] - docs["before"]
                    binary = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])
                    yield pa.record_batch([pa.array(docs["doc_id"], mask=docs["null"] != 0), pa.array(start), pa.array(docs["before"].astype(np.int64)), pa.array(here), pa.array((docs["before"] == 0) & (docs["last"] != 0)), binary], names=["doc_id", "start", "first", "here", "whole", "ids"])

    placed = blocks.join(offsets, "part").select((F.col("before") + F.col("offset")).alias("before"), "payload")
    pieces = mapped(placed, decoded, "doc_id long, start long, first long, here long, whole boolean, ids binary")
    whole = pieces.filter("whole").select("doc_id", "start", F.col("here").alias("n_tokens"), "ids")
    cut = pieces.filter("not whole").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sum("here").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("first", "ids"))).alias("all"))
    cut = cut.select("doc_id", "start", "n_tokens", F.aggregate("all", F.lit(b""), lambda x, y: F.concat(x, y["ids"])).alias("ids"))
    return whole.unionByName(cut)
