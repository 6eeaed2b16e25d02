"""Language identification by a byte convolutional network, trained and applied in numpy.

One-hot bytes, filters of several widths, a ReLU, max pooling over a window and a softmax.
Texts are cut into windows of a fixed number of bytes that cover them whole; windows go through the
network in batches, and a text's prediction is the mean of its windows' probabilities weighted by their bytes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, slices

#: Bytes of a window, and of the largest filter less one: neighbours share so many bytes.
WINDOW, WIDTHS, FILTERS, EMBEDDED = 256, (2, 3, 4, 5), (8, 12, 12, 12), 8
_LAP = max(WIDTHS) - 1
_LETTER = regex.compile(r"\p{L}")
#: Windows that go through the network at a time.
_BATCH = 128


@dataclass
class ByteNetwork:
    labels: list[str]
    embedding: np.ndarray  # 256 x EMBEDDED; byte 0 pads
    filters: np.ndarray  # max(WIDTHS) * EMBEDDED x sum(FILTERS); narrower ones are zero behind their width
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maxima over each window, and where they are."""
        n, width = len(windows), max(WIDTHS)
        x = self.embedding[windows]
        places = windows.shape[1] - width + 1
        view = np.lib.stride_tricks.as_strided(x, (n, places, width * EMBEDDED), (x.strides[0], x.strides[1], x.strides[2]))
        y = np.ascontiguousarray(view).reshape(n * places, -1) @ self.filters
        y = y.reshape(n, places, -1)
        at = y.argmax(axis=1) if self._train else None
        return np.maximum(y.max(axis=1) + self.bias, 0), at

    _train = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(windows), _BATCH):
            z = self.pooled(windows[a : a + _BATCH])[0] @ self.weights + self.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (padded with 0), the text of each, and the bytes it adds."""
    step = WINDOW - _LAP
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    counts = np.maximum(1, -(-np.maximum(sizes - _LAP, 1) // step))
    owner = np.repeat(np.arange(len(data)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((len(owner), WINDOW), np.uint8)
    for i, (d, n, first) in enumerate(zip(data, counts, np.cumsum(counts) - counts)):
        flat = np.zeros((n - 1) * step + WINDOW, np.uint8)
        flat[: len(d)] = np.frombuffer(d, np.uint8)
        out[first : first + n] = np.lib.stride_tricks.as_strided(flat, (n, WINDOW), (step, 1))
    return out, owner, np.minimum(sizes[owner] - k * step, step).clip(1)


def train(windows: np.ndarray, labels: list[str], epochs: int = 6, rate: float = 4e-3, seed: int = 7) -> ByteNetwork:
    """Adam on the cross entropy of single windows. Deterministic; windows of a rarer label weigh more."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    width, total = max(WIDTHS), sum(FILTERS)
    mask = np.zeros((width, EMBEDDED, total), np.float32)
    for w, a, n in zip(WIDTHS, np.cumsum((0, *FILTERS)), FILTERS):
        mask[:w, :, a : a + n] = 1
    mask = mask.reshape(width * EMBEDDED, total)
    net = ByteNetwork(names, rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    net.embedding[0] = 0
    target = np.array([names.index(x) for x in labels])
    share = np.bincount(target, minlength=len(names)) / max(1, len(target))
    weight = (1 / (len(names) * np.maximum(share, 1e-9)))[target].clip(0.2, 5).astype(np.float32)
    params = ["embedding", "filters", "bias", "weights", "offset"]
    first, second, step = {p: 0.0 for p in params}, {p: 0.0 for p in params}, 0
    net._train = True
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), 64):
            own = order[a : a + 64]
            x, y = windows[own], target[own]
            pooled, at = net.pooled(x)
            z = pooled @ net.weights + net.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(y)), y] -= 1
            d *= weight[own][:, None] / len(y)
            back = d @ net.weights.T * (pooled > 0)
            emb = net.embedding[x]
            cells = (at[:, :, None] + np.arange(width)).reshape(len(x), -1)  # the bytes under each maximum
            seen = emb[np.arange(len(x))[:, None], cells].reshape(len(x), total, width * EMBEDDED)
            grad = {"weights": pooled.T @ d, "offset": d.sum(0), "bias": back.sum(0), "filters": np.einsum("nfk,nf->kf", seen, back) * mask}
            to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDED)
            g = np.zeros_like(net.embedding)
            np.add.at(g, x[np.arange(len(x))[:, None], cells].reshape(-1), to_bytes)
            g[0] = 0
            grad["embedding"] = g
            step += 1
            for p in params:
                first[p] = 0.9 * first[p] + 0.1 * grad[p]
                second[p] = 0.999 * second[p] + 0.001 * grad[p] ** 2
                getattr(net, p)[...] -= rate * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)
    net._train = False
    return net


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", a_label: int = 400, windows_a_text: int = 4) -> ByteNetwork:
    """Fits on about a_label texts of each label and windows_a_text windows of each, drawn from the whole text.

    Which texts and windows is settled by hashes of key and text, so the choice is the same in every run. One scan counts the labels, one picks the texts:
    a label's texts are those whose hash lies below a threshold that its count gives; only the windows (256 bytes each) come to the driver. All labels are learnt. Null
    labels, and texts that are null or have no letter, are left out; repeated rows count as often as they occur; with an empty table nothing is learnt.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    known = counts.collect()  # a row a label
    counts = labelled.sparkSession.createDataFrame(known, "lang string, n long")
    counts = F.broadcast(counts) if len(known) <= 100_000 else counts
    spot = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.join(counts, "lang").filter(spot * F.col("n") < a_label).select("lang", "text")

    def cut(batches):
        for batch in (s for b in batches for s in slices(b, 1)):
            labels, out = [], []
            for label, t in zip(*(c.to_pylist() for c in batch.columns)):
                own = windows_of([t])[0]
                at = np.random.default_rng(zlib.crc32(t.encode())).permutation(len(own))[:windows_a_text]
                labels += [label] * len(at)
                out += [own[i].tobytes() for i in at]
            yield pa.record_batch([pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])

    got = mapped(picked, cut, "lang string, window binary").toPandas().sort_values(["lang", "window"])
    if not len(got):
        return ByteNetwork([], *[np.zeros(0)] * 5)
    return train(np.frombuffer(b"".join(got["window"]), np.uint8).reshape(len(got), WINDOW), got["lang"].tolist())


def predict_languages(docs: DataFrame, net: ByteNetwork, doc_id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the keep expressions, lang_pred and score (its probability, 0 to 1) of every row.

    A text that is null or has no letter is ``und`` with score 1; if nothing was learnt, every other text is ``und`` with score 0.
    The network (some KB) is broadcast; one pass without a shuffle; a text of any length is read whole, some 2 MB at a time. Repeated rows and null ids
    pass through, an empty table gives an empty one; keep may have any names but those of the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    more = keep or {}
    names = ["doc_id", *more]

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.ones(len(texts))
            real = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            if not own.labels:
                score[real] = 0
                real = []
            a = 0
            while a < len(real):
                b, size = a, 0
                while b < len(real) and (b == a or size < 2_000_000):
                    size += len(texts[real[b]])
                    b += 1
                windows, owner, weight = windows_of([texts[i] for i in real[a:b]])
                p = own.probabilities(windows) * weight[:, None]
                total = np.stack([np.bincount(owner, p[:, c], b - a) for c in range(p.shape[1])], axis=1)
                total /= total.sum(axis=1, keepdims=True)
                for i, best in zip(real[a:b], total.argmax(axis=1)):
                    lang[i] = own.labels[best]
                score[real[a:b]] = total.max(axis=1)
                a = b
            yield pa.record_batch([batch.column(0), *batch.columns[2:], pa.array(lang), pa.array(score)], names=[*names, "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_the_text"), *[c.alias(k) for k, c in more.items()])
    schema = T.StructType([f for f in rows.schema if f.name != "_the_text"])
    for name, kind in [("lang_pred", "string"), ("score", "double")]:
        schema.add(name, kind)
    return mapped(rows, run, schema)
