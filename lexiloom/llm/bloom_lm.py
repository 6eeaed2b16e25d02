"""Language-model scores from a log-frequency Bloom filter.

Quantised counts of n-grams lie in bit arrays: a gram whose count has level q is entered as
(gram, 1) to (gram, q). A look-up asks for (gram, 1), (gram, 2), ... until one is missing. Every gram of the training texts enters: words and pairs of
neighbours. Grams are dealt to buckets by hash; a task counts a bucket's grams and makes its region of the filter,
so nothing is gathered but the bits. The filter grows with the corpus: what is beyond ``FILTER_BITS`` goes to further lots, and texts are
looked up in one lot after the other, so that what is broadcast at a time is bounded.

The model, of whole words and one end a text, mixes for a word w after h
count(w) / all, 1 / (V + 1) for each known word and one for all others, 1 for these others, and count(h w) / count(h). All unknown words are one
outcome, as in add-one smoothing with V + 1 slots; numerators are rounded down and denominators up, so the outcomes sum to one at most.
The weights depend on how frequent h is; they are fitted by expectation maximisation on every token of the training texts, each left out of its own counts.
A token's part in both the fit and the score is told by three levels (of it, its pair, the word before), so texts are looked up once and the fit needs only how often each such triple occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, stored

#: Words whose exact counts are broadcast, at most; all others are counted through a join.
HEAD = 1_000_000
#: Bits of a lot of the filter at most (128 MB), bits and probes of an entry.
FILTER_BITS, BITS, PROBES = 1 << 30, 8, 5
#: Tokens for each bucket of grams, buckets at most, and pairs that a task counts at a time.
BUCKET, BUCKETS, _HELD = 200_000, 1 << 20, 2_000_000
#: Levels are below 2**7, as 127 is that of a count of 2**63. Triples of levels, as one number each.
_LEVEL_BITS = 7
TRIPLES = 1 << 3 * _LEVEL_BITS
WORD, PAIR = range(2)
#: An end of a text counts as this word, which no text has.
END_WORD = b"\n"
#: Classes of the word before: none, and by its level.
_SIDES = 6


def keys_of(words: list[bytes]) -> np.ndarray:
    """XXH64 (seed 42), as Spark's xxhash64 has it. Among 10^9 words one pair agrees with a chance of 3 %."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)


END = int(keys_of([END_WORD])[0])


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of some texts, A-Z lower-cased, with each text's end; where each text's keys end."""
    split = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(s) + 1 for s in split], np.int64)
    ends = np.cumsum(sizes)
    keys = np.full(int(sizes.sum()), END, np.int64)
    inside = np.ones(len(keys), bool)
    inside[ends - 1] = False
    keys[inside] = keys_of([w for s in split for w in s])
    return keys, ends


def find(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 where missing."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.searchsorted(among, keys).clip(max=len(among) - 1)
    return np.where(among[at] == keys, at, -1)


def level(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and 2 more for each doubling."""
    return 1 + np.floor(2 * np.log2(count) + 1e-9).astype(np.int64)


def amount(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for 0."""
    return np.where(levels > 0, 2.0 ** ((levels - 1) / 2), 0.0)


def above(levels: np.ndarray) -> np.ndarray:
    """What no count of a level exceeds."""
    return np.maximum(2.0 ** (levels / 2), 1.0)


def pairs_of(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token but the first of a text: its place, and a key of it and the one before."""
    first = np.zeros(len(keys), bool)
    first[np.append(0, ends[:-1])] = True
    at = np.flatnonzero(~first)
    before, now = keys[at - 1].view(np.uint64), keys[at].view(np.uint64)
    return at, _mixed(before * np.uint64(0x9E3779B97F4A7C15) ^ now >> np.uint64(29) ^ now).view(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    own, of = np.unique(keys, return_inverse=True)
    return own, np.bincount(of, counts, len(own)).astype(np.int64)


def places(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram. buckets: a power of two."""
    h = _mixed(keys.view(np.uint64) + np.uint64(kind + 0x632BE59BD9B4E019))
    return (h & np.uint64(buckets - 1)).astype(np.int64)


def _probed(kind: int, keys: np.ndarray, q: int, size: np.ndarray):
    """The places of (gram, q) in a region of so many bits, one array a probe."""
    h = _mixed(keys.view(np.uint64) + np.uint64((kind * 1000 + q) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    step = h >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)).astype(np.int64)


def region(kinds: np.ndarray, keys: np.ndarray, levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bits (packed, the lowest first) of a bucket: so many for each entry."""
    size = np.uint64(max(64, -(-int(levels.sum()) * bits // 64) * 64))
    out = np.zeros(int(size), bool)
    for kind in np.unique(kinds):
        for q in range(1, int(levels.max(initial=0)) + 1):
            for at in _probed(int(kind), keys[(kinds == kind) & (levels >= q)], q, size):
                out[at] = True
    return np.packbits(out, bitorder="little")


class LogBloom:
    """One lot: the regions of some buckets one behind another."""

    def __init__(self, buckets: int, regions: dict[int, np.ndarray]):
        self.buckets = buckets
        sizes = np.zeros(buckets, np.int64)
        for b, data in regions.items():
            sizes[b] = len(data) * 8
        self.sizes, self.starts = sizes.astype(np.uint64), np.cumsum(sizes) - sizes
        self.data = np.concatenate([regions[b] for b in sorted(regions)]) if regions else np.zeros(1, np.uint8)

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The level of each gram, 0 for those of other lots: asked upwards until one is missing. About 2 % of the grams that were never entered are thought to be there."""
        out = np.zeros(len(keys), np.int64)
        own = places(kind, keys, self.buckets)
        size, start = self.sizes[own], self.starts[own]
        on, q = np.flatnonzero(size), 0
        while len(on):
            q += 1
            near, bits, first = keys[on], size[on], start[on]
            hit = np.ones(len(on), bool)
            for at in _probed(kind, near, q, bits):
                at += first
                hit &= self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            on = on[hit]
            out[on] = q
        return out


@dataclass
class Model:
    head: np.ndarray  # sorted keys
    head_counts: np.ndarray
    tokens: int
    distinct: int
    weights: np.ndarray  # of the four parts, for each class of the word before

    def parts(self, seen: dict[str, np.ndarray], left_out: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The four probabilities of each token, and the class of the word before. seen: see looked_up."""
        words = np.maximum(amount(seen["word"]) - left_out, 0)
        out = np.zeros((len(words), 4))
        out[:, 0] = words / max(self.tokens, 1)
        out[:, 1] = 1 / (self.distinct + 1)
        out[:, 2] = words == 0
        out[:, 3] = np.minimum(np.maximum(amount(seen["pair"]) - left_out, 0) / above(seen["before"]), 1.0)
        return out, np.where(seen["before"] > 0, 1 + np.minimum(seen["before"] // 4, _SIDES - 2), 0)

    def logs(self, seen: dict[str, np.ndarray]) -> np.ndarray:
        """log10 P of each token."""
        parts, side = self.parts(seen)
        return np.log10(np.maximum((parts * self.weights[side]).sum(axis=1), 1e-300))


def coded(seen: np.ndarray) -> np.ndarray:
    """One number for each row of three levels."""
    levels = seen.astype(np.int32)
    return levels[:, 0] << 2 * _LEVEL_BITS | levels[:, 1] << _LEVEL_BITS | levels[:, 2]


def decoded(codes: np.ndarray) -> dict[str, np.ndarray]:
    """The levels (see looked_up) of numbers made by coded."""
    last = (1 << _LEVEL_BITS) - 1
    return {"word": codes >> 2 * _LEVEL_BITS, "pair": codes >> _LEVEL_BITS & last, "before": codes & last}


def looked_up(lot: LogBloom, keys: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """What one lot knows of each token: the levels of it, of its pair with the word before, and of the word before."""
    own, back = np.unique(keys, return_inverse=True)
    level_of = lot.levels(WORD, own)[back]
    at, pair = pairs_of(keys, ends)
    distinct, pair_back = np.unique(pair, return_inverse=True)
    pairs, before = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    pairs[at] = lot.levels(PAIR, distinct)[pair_back]
    before[at] = level_of[at - 1]
    return {"word": level_of, "pair": pairs, "before": before}


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that has some of the grams."""
    own = places(kind, keys, buckets)
    order = np.argsort(own, kind="stable")
    bucket, first = np.unique(own[order], return_index=True)
    ends = (np.append(first, len(keys)) * 8).astype(np.int32)
    column = lambda x: pa.Array.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x[order].astype("<i8").tobytes())])
    return pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), kind, np.int32)), column(keys), column(counts)], names=["bucket", "kind", "keys", "counts"])


_PAYLOAD = "bucket int, kind int, keys binary, counts binary"


def gathered(words: DataFrame, docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """bucket, kinds, keys, levels (binary arrays) and entries: all grams with the levels of their counts, a row a bucket.

    Tasks count what they read, then send each bucket its part; a bucket's parts are summed in one task, which holds about BUCKET grams.
    """

    def of_words(batches):
        for batch in batches:
            yield _rows(WORD, batch.column(0).to_numpy(), batch.column(1).to_numpy(), buckets)

    def of_pairs(batches):
        held, size = [], 0
        for batch in (s for b in batches for s in slices(b, 0)):
            held.append(pairs_of(*tokens_of(batch.column(0).to_pylist()))[1])
            size += len(held[-1])
            if size >= _HELD:
                yield _rows(PAIR, *_counted(np.concatenate(held)), buckets)
                held, size = [], 0
        if size:
            yield _rows(PAIR, *_counted(np.concatenate(held)), buckets)

    def summed(parts: dict[int, list]) -> list:
        kinds, keys, levels = [], [], []
        for kind, own in sorted(parts.items()):
            key, n = _counted(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))
            kinds.append(np.full(len(key), kind, np.uint8)), keys.append(key), levels.append(level(n))
        kinds, keys, levels = map(np.concatenate, (kinds, keys, levels))
        return [kinds.tobytes(), keys.astype("<i8").tobytes(), levels.astype(np.uint8).tobytes(), int(levels.sum())]

    def merged(batches):
        now, parts = None, {}
        one = lambda: pa.record_batch([pa.array([x], t) for x, t in zip([now, *summed(parts)], (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["bucket", "kinds", "keys", "levels", "entries"])
        for batch in batches:
            for bucket, kind, k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if bucket != now:
                    if parts:
                        yield one()
                    now, parts = bucket, {}
                parts.setdefault(kind, []).append((np.frombuffer(k.as_buffer(), "<i8"), np.frombuffer(n.as_buffer(), "<i8")))
        if parts:
            yield one()

    own = mapped(words.select("key", "n"), of_words, _PAYLOAD)
    pairs = mapped(docs.select(F.col(text).cast("string").alias("text")), of_pairs, _PAYLOAD)
    dealt = own.unionByName(pairs).repartition("bucket").sortWithinPartitions("bucket")
    return stored(mapped(dealt, merged, "bucket int, kinds binary, keys binary, levels binary, entries long"))


class Lots:
    """The lots of a filter, one broadcast at a time: lot k has the regions of each bucket b with b % lots = k."""

    def __init__(self, grams: DataFrame, buckets: int, filter_bits: int):
        entries = grams.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
        self.grams, self.buckets = grams, buckets
        self.number = max(1, min(buckets, -(-entries * BITS // filter_bits)))
        self._now, self._shared = -1, None

    def shared(self, k: int):
        if k != self._now:
            self.close()
            self._now, self._shared = k, self.grams.sparkSession.sparkContext.broadcast(self.lot(k))
        return self._shared

    def close(self) -> None:
        if self._shared is not None:
            self._shared.destroy()
        self._now, self._shared = -1, None

    def lot(self, k: int) -> LogBloom:
        def made(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    data = region(np.frombuffer(row["kinds"], np.uint8), np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["levels"], np.uint8).astype(np.int64))
                    yield pa.record_batch([pa.array([row["bucket"]], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["bucket", "bits"])

        own = self.grams.filter(F.col("bucket") % self.number == k).select("bucket", "kinds", "keys", "levels")
        rows = mapped(own, made, "bucket int, bits binary").toArrow()
        return LogBloom(self.buckets, {b: np.frombuffer(x.as_buffer(), np.uint8) for b, x in zip(rows.column(0).to_pylist(), rows.column(1))})


def head_of(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and counts of the most frequent words: all from a power of two on that leaves at most HEAD."""
    by_size = {r["q"]: r["count"] for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("q")).count().collect()}
    kept, cut = 0, max(by_size, default=0) + 1
    for q in sorted(by_size, reverse=True):
        if kept + by_size[q] > HEAD:
            break
        kept, cut = kept + by_size[q], q
    got = words.filter(F.col("n") >= 2**cut).select("key", "n").toArrow()
    keys, counts = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(keys)
    return keys[order], counts[order]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """key and n of every token: counted a batch at a time, then summed by key."""

    def work(batches):
        for batch in batches:
            parts = [_counted(tokens_of(s.column(0).to_pylist())[0]) for s in slices(batch, 0)]
            if parts:
                key, n = _counted(*map(np.concatenate, zip(*parts)))
                yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    rows = mapped(docs.select(F.col(text).cast("string").alias("text")), work, "key long, n long")
    return stored(rows.groupBy("key").agg(F.sum("n").alias("n")))


def _binary(seen: dict[str, np.ndarray], ends: np.ndarray) -> pa.Array:
    """The levels of each text's tokens, three bytes a token."""
    data = np.stack(list(seen.values()), axis=1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.append(0, ends) * 3).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _levels_of(column: pa.Array) -> np.ndarray:
    """The three levels of each token of a column made by _binary."""
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in column)]).reshape(-1, 3)


def _looked_up(rows: DataFrame, shared, at: int, last, schema: str | None = None) -> DataFrame:
    """Looks the texts (column at) up in a lot. Levels of earlier lots come in a last column ``seen``, three bytes a token; with last, what it makes of a slice is returned, else rows with seen."""
    names = rows.columns
    has = names[-1] == "seen"

    def work(batches):
        for batch in (s for b in batches for s in slices(b, at)):
            keys, ends = tokens_of(batch.column(at).to_pylist())
            seen = looked_up(shared.value, keys, ends)
            if has:  # a gram is in one lot, so the larger of two levels is its own
                flat = _levels_of(batch.column(len(names) - 1))
                seen = {k: np.maximum(v, flat[:, i]) for i, (k, v) in enumerate(seen.items())}
            if last is not None:
                yield last(batch, keys, ends, seen)
            else:
                yield pa.record_batch([*(batch.column(i) for i in range(len(names) - has)), _binary(seen, ends)], names=[*names[: len(names) - has], "seen"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "seen"]
    return mapped(rows, work, schema or ", ".join([*kinds, "seen binary"]))


def through(rows: DataFrame, lots: Lots, last, schema: str, at: int = 1) -> DataFrame:
    """Looks the texts up in all lots, one after the other, and stores what last makes of them."""
    for k in range(lots.number):
        end = k == lots.number - 1
        rows = stored(_looked_up(rows, lots.shared(k), at, last if end else None, schema if end else None))
    return rows


def triples_of(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which triples of levels (as numbers, see coded) occur in a column ``seen`` of texts, and how often: summed by tasks, at most TRIPLES rows each."""

    def work(batches):
        total = np.zeros(TRIPLES, np.int64)
        for batch in batches:
            total += np.bincount(coded(_levels_of(batch.column(0))), minlength=TRIPLES)
        codes = np.flatnonzero(total)
        yield pa.record_batch([pa.array(codes.astype(np.int32)), pa.array(total[codes])], names=["code", "n"])

    got = mapped(seen.select("seen"), work, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, n = got.column("code").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def tuned(model: Model, codes: np.ndarray, n: np.ndarray, rounds: int = 30) -> None:
    """Fits the weights on all tokens of the training texts: n of each triple of levels."""
    parts, sides = model.parts(decoded(codes), left_out=1)
    parts = np.maximum(parts, 1e-30)
    for side in range(_SIDES):
        on = sides == side
        own, times = parts[on], n[on].astype(float)
        w = model.weights[side]
        for _ in range(rounds if len(own) else 0):
            mine = own * w
            w = ((mine / mine.sum(axis=1, keepdims=True)) * times[:, None]).sum(axis=0) / times.sum()
        model.weights[side] = 0.999 * w + 0.001 * model.weights[side]


def score_texts(docs: DataFrame, training: DataFrame | Column, doc_id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, the keep expressions, n_tokens, n_known, train_tokens, base_score and score of every whole text of docs, learnt from training: a table, or a condition that tells which rows
    of docs it is. With a condition texts are looked up once, for the fit of the weights and for the scores.

    base_score is add-one over exact counts. The counts of at most HEAD frequent words are
    broadcast; tokens of other words, none of which is frequent, are joined with the table of all counts, a row a token. Null counts
    as empty: its end is scored. Texts of any length are read whole, in slices; repeated rows stay apart, null ids pass through, an empty table gives an empty
    one. With an empty training table every token is the one unknown outcome. A null doc_id is a row like any other. filter_bits: of a lot of the filter at most.
    """
    learnt = training if isinstance(training, Column) else None
    if learnt is not None:
        training = docs.filter(learnt)
    words = word_counts(training, text)
    n, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = 1 << max(0, min(BUCKETS, -(-n // BUCKET)) - 1).bit_length()
    lots = Lots(gathered(words, training, text, buckets), buckets, filter_bits)
    head, head_counts = head_of(words)
    shared = docs.sparkSession.sparkContext.broadcast((head, head_counts))
    more = keep or {}
    names = ["doc_id", "_row", *more, "_learnt"]

    def last(batch, keys, ends, seen):
        head, counts = shared.value
        at = find(keys, head)
        begins = np.append(0, ends[:-1])
        sums = lambda x: np.add.reduceat(x, begins)
        base = sums(np.where(at >= 0, np.log10(counts[at] + 1.0) if len(head) else 0.0, 0.0))
        tail = np.append(0, np.cumsum(at < 0))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, tail[ends]).astype(np.int32)), pa.array(keys[at < 0]))
        cols = [pa.array(ends - begins), pa.array(sums((at >= 0).astype(np.int64))), pa.array(base), lists, _binary(seen, ends)]
        return pa.record_batch([batch.column(0), *(batch.column(i) for i in range(2, 2 + len(names) - 1)), *cols], names=[*names, "n_tokens", "known", "base", "tail", "seen"])

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_the_text"), F.monotonically_increasing_id().alias("_row"), *[c.alias(k) for k, c in more.items()],
        (F.lit(False) if learnt is None else F.coalesce(learnt, F.lit(False))).alias("_learnt"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in names], "n_tokens long, known long, base double, tail array<long>, seen binary"])
    met = through(rows, lots, last, schema)
    if learnt is not None:
        seen = met.filter("_learnt")
    else:
        seen = through(training.select(F.lit(0).alias("none"), F.col(text).cast("string").alias("text")), lots, lambda batch, keys, ends, seen: pa.record_batch([_binary(seen, ends)], names=["seen"]), "seen binary")
    shared.destroy()  # all is looked up: neither counts nor filter are held any longer
    lots.close()

    model = Model(head, head_counts, int(n), int(distinct), np.array([[0.7, 0.2, 0.1, 0.0]] + [[0.4, 0.1, 0.1, 0.4]] * (_SIDES - 1)))
    tuned(model, *triples_of(seen))
    logs = docs.sparkSession.sparkContext.broadcast(np.concatenate([model.logs(decoded(c)) for c in np.split(np.arange(TRIPLES), 1 << _LEVEL_BITS)]))
    kept = ["doc_id", "_row", *more, "n_tokens", "known", "base"]

    def scores(batches):
        for batch in (b for b in batches if b.num_rows):
            levels = _levels_of(batch.column(len(kept)))
            begins = np.append(0, np.cumsum(batch.column(kept.index("n_tokens")).to_numpy())[:-1])
            score = np.add.reduceat(logs.value[coded(levels)], begins)
            yield pa.record_batch([*(batch.column(i) for i in range(len(kept))), pa.array(score)], names=[*kept, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    scored = stored(mapped(met.select(*kept, "seen"), scores, ", ".join([*[f"`{k}` {kinds[k]}" for k in kept], "score double"])))
    logs.destroy()
    tail = met.select("_row", F.explode("tail").alias("key")).join(words, "key")
    rest = tail.groupBy("_row").agg(F.count("*").alias("_more"), F.sum(F.log10(F.col("n") + 1.0)).alias("_logs"))
    out = scored.join(rest, "_row", "left")
    below = np.log10(n + distinct + 1)
    return out.select(
        "doc_id", *more, "n_tokens", (F.col("known") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(below))).alias("base_score"), "score",
    )
