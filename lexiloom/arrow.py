"""Python over Arrow batches: bounds on what a worker holds."""

from __future__ import annotations

import contextlib
import gc

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch at most (a single row may be larger); a worker and its executor hold a few of them.
ARROW_BYTES = 8 << 20


def mapped(rows: DataFrame, work, schema) -> DataFrame:
    """rows.mapInArrow(work, schema) over batches of at most ARROW_BYTES; a worker gives memory back when a task ends, as it lives on for others.

    The bound is the session's setting for Arrow batches, which is lowered if it is higher, since a plan reads it when it runs.
    """
    spark = rows.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def run(batches):
        try:
            yield from work(batches)
        finally:
            _trimmed()

    return rows.mapInArrow(run, schema)


def _trimmed() -> None:
    """Gives free memory back to the system, where its C library can."""
    import ctypes

    import pyarrow as pa

    gc.collect(1)  # what is young: a whole collection would walk all that a compiled tokenizer holds
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch, column: int, size: int = 3_000_000):
    """An Arrow batch in parts of about so many bytes of a text column, so that what a worker makes of them stays small."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield batch.slice(a, b - a)
        a = b


def emitted(rows, schema, size: int = 1 << 20):
    """Rows (tuples, in the order of a pyarrow schema) as Arrow batches of about so many bytes, each given on before the next is made."""
    import pyarrow as pa

    def batch():
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*some), schema)], schema=schema)

    some, held = [], 0
    for row in rows:
        some.append(row)
        held += 64 + sum(len(x) for x in row if isinstance(x, str))
        if held >= size:
            yield batch()
            some, held = [], 0
    if some:
        yield batch()
