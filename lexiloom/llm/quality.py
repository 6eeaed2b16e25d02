"""A quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees are grown on binned statistics, then flattened into arrays; prediction walks all rows of
a batch down a tree at once, one vector operation a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

#: The statistics of a text, in order.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "spaces", "lines", "high_bytes",
    "commas", "stops", "exclamations", "pipes", "stars", "dollars", "hashes", "percents", "amps", "other_marks",
    "distinct_words", "top_word", "long_words", "words_with_marks", "distinct_lines", "top_line", "line_bytes", "short_lines", "upper_words", "repeated_pairs",
)
#: What the text is called on its way, so that kept columns of any name stand beside it.
_TEXT = "_the_text"
_MARKS = [ord(c) for c in ",.!|*$#%&"]
_ASCII_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each whole text; null and empty ones give zeros."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode()
        n = len(data)
        count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
        w = max(1, len(words))
        tally: dict[bytes, int] = {}
        for x in words:
            tally[x] = tally.get(x, 0) + 1
        seen: dict[bytes, int] = {}
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
        upper, lower, marks = count[65:91].sum(), count[97:123].sum(), count[_ASCII_MARKS].sum()
        k = max(1, len(lines))
        own = list(tally.items())
        out[i] = (
            np.log1p(n), np.log1p(len(words)), n / w, (upper + lower) / n, upper / max(1, upper + lower), count[48:58].sum() / n, count[[9, 10, 13, 32]].sum() / n, count[10] / n, count[128:].sum() / n,
            *(count[_MARKS] / n), (marks - count[_MARKS].sum()) / n,
            len(tally) / w, max(tally.values(), default=0) / w, sum(c for x, c in own if len(x) > 20) / w, sum(c for x, c in own if not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,") / w,
            len(seen) / k, max(seen.values(), default=0) / k, min(n / k, 1e6), sum(c for x, c in seen.items() if len(x) < 30) / k, sum(c for x, c in own if len(x) > 1 and x.isupper()) / w, len(set(zip(words, words[1:]))) / w,
        )
    return out


@dataclass
class Forest:
    """Flattened trees: nodes of all trees one behind another; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: float = 3.0, ridge: float = 1.0) -> Forest:
    """Boosts the logistic loss; splits are searched in histograms of gradients over at most ``bins`` quantile bins. Deterministic."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), int)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    feature, limit, left, right, value, roots = [], [], [], [], [], []
    f = np.full(n, base)

    def node(rows: np.ndarray, level: int) -> int:
        k = len(feature)
        feature.append(0), limit.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        g, h = grad[rows], hess[rows]
        best, choice = 1e-6, None
        if level < depth and len(rows) > 1:
            flat = (binned[rows] + np.arange(m) * bins).ravel()
            gs = np.bincount(flat, np.repeat(g, m), m * bins).reshape(m, bins).cumsum(axis=1)
            hs = np.bincount(flat, np.repeat(h, m), m * bins).reshape(m, bins).cumsum(axis=1)
            all_g, all_h = g.sum(), h.sum()
            gain = gs**2 / (hs + ridge) + (all_g - gs) ** 2 / (all_h - hs + ridge) - all_g**2 / (all_h + ridge)
            gain[(hs < least) | (all_h - hs < least)] = -1
            for j, c in enumerate(cuts):
                gain[j, len(c) :] = -1
            at = int(gain.argmax())
            if gain.flat[at] > best:
                choice = divmod(at, bins)
        if choice is None:
            value[k] = -rate * g.sum() / (h.sum() + ridge)
            f[rows] += value[k]
        else:
            j, c = choice
            feature[k], limit[k] = j, float(cuts[j][c])
            goes = binned[rows, j] <= c
            left[k] = node(rows[goes], level + 1)
            right[k] = node(rows[~goes], level + 1)
        return k

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-f))
        grad, hess = p - y, p * (1 - p)
        roots.append(node(np.arange(n), 0))
    return Forest(*(np.array(v, t) for v, t in ((roots, int), (feature, int), (limit, np.float32), (left, int), (right, int), (value, float))), base, depth)


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 8000) -> Forest:
    """Fits on at most ``sample`` labelled documents: those with the smallest hash of the id. Null labels, ids and unmatched labels are left out. Of an id's repeated labels, one row each counts."""
    order = F.xxhash64("id")
    picked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).orderBy(order, "label").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "id").select("label", "text")

    def work(batches):
        for batch in batches:
            x = statistics(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["label", "x"])

    got = mapped(rows, work, "label int, x array<float>").toPandas()
    if not len(got):
        return grow(np.zeros((0, len(STATISTICS)), np.float32), np.zeros(0))
    x, y = np.stack(got["x"].to_list()).astype(np.float32), got["label"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows come in
    return grow(x[order], y[order].astype(float))


def rated(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns of docs, then score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on); columns of docs so named are replaced.

    text may be a field of a struct column (``doc.text``), so that a whole row passes with one copy of its text. Null and empty
    texts have statistics of zero and a score like any other; a text of any length is read whole. Repeated rows stay as they are, an empty table gives an
    empty one. One pass without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    top, *inner = [text] if text in names else text.split(".")
    at = names.index(top)

    def work(batches):
        for batch in batches:
            column = batch.column(at)
            for name in inner:
                column = pc.struct_field(column, name)
            s = shared.value.scores(statistics(column.to_pylist()))
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    return mapped(rows, work, T.StructType([*rows.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def quality_scores(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, the keep expressions, score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on) of every row.

    Cases are those of ``rated``, which does the work; null ids pass through.
    """
    more = keep or {}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias(_TEXT), *[c.alias(k) for k, c in more.items()])
    return rated(rows, forest, _TEXT, threshold).select("doc_id", *[f"`{k}`" for k in more], "score", "predicted")
