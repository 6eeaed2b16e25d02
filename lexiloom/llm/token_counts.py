"""Token counts by a compiled finite-state tokenizer (fst_tokenizer)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .fst_tokenizer import compiled


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the vocabulary file (a name of a public file
    or a path that every worker has), special strings in texts included, nothing added. Null
    and empty texts have no tokens. One pass without a shuffle; repeated rows, ties and null ids
    pass through as they are, other columns are not read.
    """

    def run(batches):
        machine = compiled(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            n = machine.count(texts.to_pylist())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0), size, pa.array(n), pa.array(np.asarray(n) > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
