"""Packing by power-of-two decomposition (as in dataset decomposition for variable-length training).

A document of L tokens is cut into pieces of ``limit`` tokens and then one piece for each set
bit of the rest, longest first. Every piece is a training sequence of its own, of a length that
is a power of two: no sequence crosses documents and nothing is padded. Batches are drawn from one bucket of equal lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices
from .fst_tokenizer import compiled

#: Bytes of text that a worker encodes at a time.
_SLICE = 1_000_000


def pieces_of(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, start and length of every piece, in order. limit: a power of two."""
    bits = limit.bit_length() - 1
    full = lengths >> bits
    doc = [np.repeat(np.arange(len(lengths)), full)]
    start = [(np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)) << bits]
    size = [np.full(len(doc[0]), limit, np.int64)]
    for b in range(bits - 1, -1, -1):
        own = np.flatnonzero(lengths >> b & 1)
        doc.append(own)
        start.append(lengths[own] >> b + 1 << b + 1)
        size.append(np.full(len(own), 1 << b, np.int64))
    doc, start, size = map(np.concatenate, (doc, start, size))
    order = np.lexsort((start, doc))
    return doc[order], start[order], size[order]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids and then end_id, as little-endian unsigned 32 bits, and the lengths."""
    lengths = np.diff(offsets) + 1
    out = np.full(lengths.sum(), end_id, "<u4")
    inside = np.ones(len(out), bool)
    inside[np.cumsum(lengths) - 1] = False
    out[inside] = ids
    return out, lengths


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, limit: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (binary, little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset (0), bucket (log2 of length).

    A null or empty text is the end id alone: one piece of one token. The ids are those of the
    tokenizers library (see fst_tokenizer). sequence_id is unique; it follows the rows of the
    input, so repeated rows and equal or null doc_ids get sequences of their own. A task holds a slice of a batch at a time;
    no shuffle. Write by bucket with ``write_buckets``.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches):
        machine = compiled(vocabulary)
        for batch in (s for b in batches for s in slices(b, 1, _SLICE)):
            ids, lengths = with_end(*machine.encode(batch.column(1).to_pylist()), end_id)
            doc, start, size = pieces_of(lengths, limit)
            ends = np.append(0, np.cumsum(size)) * 4
            for a in range(0, len(doc), 20_000):
                b = min(len(doc), a + 20_000)
                data = pa.py_buffer(ids[ends[a] // 4 : ends[b] // 4].tobytes())
                tokens = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends[a : b + 1] - ends[a]).astype(np.int32).tobytes()), data])
                yield pa.record_batch([batch.column(0).take(pa.array(doc[a:b])), pa.array(start[a:b]), pa.array(size[a:b]), tokens, pa.array(lengths[doc[a:b]])], names=["doc_id", "start", "length", "tokens", "doc_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = mapped(rows, run, f"doc_id {kind}, start long, length long, tokens binary, doc_tokens long")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
