"""SimHash near-duplicates through multi-index hashing.

A fingerprint is cut into segments, each with a table of its own. Small balls about the segments are
looked up in the tables, and complete distances of what is met there are verified. Near duplicates by the similarity of their shingles take the first shingles of each
set instead (prefix filtering), which loses no pair. ``near_copies`` links by both.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, filter_of, mapped, removed, slices, stored, with_hit, without
from .components import components

#: Shingles whose bits are summed at a time.
_BLOCK = 200_000
#: Bytes of text whose shingles a worker holds at a time.
_SLICE = 1_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of so many words, A-Z lower-cased, repeats included; of the whole if it has fewer; none of no word."""
    joined, digest = b" ".join((text or "").encode().lower().split()), xxhash.xxh64_intdigest
    if not joined:
        return np.zeros(0, np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    begins, ends = np.append(0, ends[: max(len(ends) - words, 0)] + 1), ends[min(words, len(ends)) - 1 :]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(memoryview(begins), memoryview(ends))), np.uint64, len(ends))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits of a hash; the first are the hash itself."""
    if k:
        h = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


def fingerprints_of(hashes: list[np.ndarray], bits: int = 64) -> np.ndarray:
    """A row of bits / 32 segments (int32) for each list: a bit is 1 if set in over half of the hashes; of no hash, 0."""
    n = np.array([len(h) for h in hashes])
    out = np.zeros((len(hashes), bits), np.uint8)
    k = 0
    while k < len(hashes):
        e = k + 1
        while e < len(hashes) and n[k : e + 1].sum() <= _BLOCK:
            e += 1
        own = [i for i in range(k, e) if n[i]]
        if own:
            flat = np.concatenate([np.array(hashes[i], np.uint64) for i in own])
            starts = np.append(0, np.cumsum(n[own])[:-1])
            for word in range(bits // 64):
                total = np.zeros((len(own), 64), np.int64)
                for a in range(0, len(flat), _BLOCK):  # one long text may be more than a block
                    part = np.unpackbits(_mixed(flat[a : a + _BLOCK], word).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    inside = np.searchsorted(starts, [a, a + len(part)], side="right")
                    first = inside[0] - 1
                    cut = np.maximum(starts[first : max(inside[1], first + 1)] - a, 0)
                    cut = cut[cut < len(part)]
                    total[first : first + len(cut)] += np.add.reduceat(part, cut, axis=0, dtype=np.int64)
                out[own, word * 64 : word * 64 + 64] = total * 2 > n[own][:, None]
        k = e
    return np.packbits(out, axis=1).view(">i4").astype(np.int32).reshape(len(hashes), bits // 32)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """doc_id and segments (array of 32-bit integers, the most significant first) of each row; distinct: each shingle counts once."""

    def run(batches):
        for batch in (s for b in batches for s in slices(b, 1, _SLICE)):
            hashes = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            if distinct:
                hashes = [np.unique(h) for h in hashes]
            prints = fingerprints_of(hashes, bits)
            flat = pa.array(prints.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * (bits // 32)), flat)
            yield pa.record_batch([batch.column(0), lists], names=["doc_id", "segments"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, segments array<int>")


def distance(a: str, b: str, segments: int) -> Column:
    """Differing bits of two columns of segments."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]).cast("long").bitwiseAND(0xFFFFFFFF)) for i in range(segments)])


#: Members of a table row that are compared with each other; longer rows are dealt again by the segments of what is left of a fingerprint.
ROW = 256


def _dealt(rows: DataFrame, width: int, radius: int) -> DataFrame:
    """The rows (fp, key, rest) of two tables, one for each half (segment) of the ``width`` bits of rest, key telling them apart.

    Of two values within ``radius`` bits either the first halves are within radius - 1 or the second ones are equal. So the first table is asked with
    the ball of radius 1 about the first half, the second with the half itself. Of two halves that differ in one bit, one has it set: it is enough that
    each asks with its set bits cleared, one at a time.
    """
    half = width // 2
    low = F.col("rest").bitwiseAND((1 << half) - 1)
    high = F.shiftrightunsigned("rest", half)
    ball = F.array(high)
    if radius > 1:
        bits = F.array(*[F.lit(1 << i).cast("long") for i in range(half)])
        ball = F.concat(ball, F.transform(F.filter(bits, lambda b: high.bitwiseAND(b) != 0), lambda b: high.bitwiseXOR(b)))
    first = rows.select("fp", "key", low.alias("open"), F.explode(ball).alias("value")).select("fp", F.xxhash64("key", F.lit(0), "value").alias("key"), F.col("open").alias("rest"))
    return first.unionByName(rows.select("fp", F.xxhash64("key", F.lit(1), low).alias("key"), high.alias("rest")))


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indices) between some distinct 64-bit values that reach what all their links of at most radius bits reach: complete distances, one value against all behind it at a time."""
    up = list(range(len(prints)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a in range(len(prints) - 1):
        for b in np.flatnonzero(np.bitwise_count(prints[a + 1 :] ^ prints[a]) <= radius) + a + 1:
            x, y = top(a), top(int(b))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(b), a))
    return out


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links u, v between distinct 64-bit fingerprints (column fp, long) that keep its classes: fingerprints are reachable from each other through these links as through all links of at most radius bits. radius: up to 2.

    Multi-index hashing: a table a segment of 32 bits, asked with small balls about the segment (see _dealt); whatever meets in a table row is
    verified by its complete distance, and of a row's links a spanning forest is returned. No group grows with the data: a row of more than ROW members is
    dealt again by the segments of the half that it leaves open, and at last by those of 8 bits, where rows have what 8 bits and three balls allow.
    Only rows of two members or more are shuffled beyond their count.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    rows, found = prints.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), [prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)]

    def verified(batches):
        for batch in batches:
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            u, v = [], []
            for a, b in zip(ends, ends[1:]):
                own = np.unique(flat[a:b])  # a collision of keys may bring a fingerprint twice
                near = forest(own.view(np.uint64), radius)
                u += [own[x] for x, _ in near]
                v += [own[y] for _, y in near]
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for width in (64, 32, 16) if radius else ():
        met = _dealt(rows, width, radius)
        sizes = stored(met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        members = stored(with_hit(met, filter_of(sizes, "key"), "key").filter("_hit").drop("_hit").join(sizes, "key"))
        short = members if width == 16 else members.filter(F.col("n") <= ROW)
        found.append(stored(mapped(short.groupBy("key").agg(F.collect_list("fp").alias("all")).select("all"), verified, "u long, v long")))
        rows = members.filter(F.col("n") > ROW).select("fp", "key", "rest")
        if (sizes.agg(F.max("n")).first()[0] or 0) <= ROW:
            break
    return reduce(DataFrame.unionByName, found).distinct()


def simhash_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fp (64-bit fingerprint, long), component_id: the smallest doc_id reachable through links.

    Null, empty and blank texts have the fingerprint 0 and are linked like any other. Null
    doc_ids are rows, but no component_id; a component of nothing else has none. Repeated rows are kept, an empty table gives an empty one, texts of any length are read whole. Only distinct
    fingerprints are linked; sums and joins over one fingerprint's rows are spread over SALTS.
    """
    prints = fingerprints(docs, doc_id, text, words)
    fp = F.shiftleft(F.col("segments")[0].cast("long"), 32).bitwiseOR(F.col("segments")[1].cast("long").bitwiseAND(0xFFFFFFFF))
    rows = stored(prints.select("doc_id", fp.alias("fp")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    each = stored(parts.groupBy("fp").agg(F.min("least").alias("least")))
    classes = components(links(each, radius)).select(F.col("node").alias("fp"), "component")
    linked = each.join(classes, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component_id")
    all_prints = each.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    spread = parts.select("fp", "salt").join(all_prints, "fp")
    return rows.join(spread, ["fp", "salt"], "left").select("doc_id", "fp", "component_id")


#: Cells in which shingles are counted; a task's share of a cell counts from SEEN on. Both only order the shingles: what is found does not depend on them.
CELLS, SEEN = 1 << 22, 3
#: Bits of a set's sketch, and members of a block of a long row: two blocks are compared at a time.
SKETCH, BLOCK = 1024, 256
#: While rows of more members than this are of several classes, each of their members is verified against its nearest before all pairs are.
CROWD = 16
#: Parts of the candidate pairs, verified one after the other: what one shuffles is given back before the next.
PARTS = 4


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64)


def _levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each cell how common its shingles are, as a power of two (a byte each, 4 MB whatever the input)."""

    def run(batches):
        seen = np.zeros(CELLS, np.int32)
        for batch in (s for b in batches for s in slices(b, 0, _SLICE)):
            for t in batch.column(0).to_pylist():
                cells, n = np.unique(_cell(np.unique(shingle_hashes(t, words))), return_counts=True)
                seen[cells] += n.astype(np.int32)
        cells = np.flatnonzero(seen >= SEEN)
        for a in range(0, len(cells), _BLOCK):
            own = cells[a : a + _BLOCK]
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(seen[own].astype(np.int64))], names=["cell", "n"])

    met = mapped(docs.select("text"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = met.select("cell", F.log2("n").cast("int").alias("level")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[got.column("cell").to_numpy()] = got.column("level").to_numpy()
    return out


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """For each text with words: doc_id, size (of its set of shingles), whole (a hash of the set), segments (for each of
    SKETCH classes of shingles, whether their number is odd) and keys: its first shingles, the rarest first.

    Sets with a similarity of at least ``similarity`` share so many shingles that the first one they share, in any
    order that is the same for all, is among the first size - ceil(similarity * size) + 1 of either.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_levels(docs, words))

    def run(batches):
        level = shared.value
        for batch in (s for b in batches for s in slices(b, 1, _SLICE)):
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            places = [i for i, x in enumerate(sets) if len(x)]
            if not places:
                continue
            sets = [sets[i] for i in places]
            sketch, keys = np.zeros((len(sets), SKETCH), np.uint8), []
            for i, x in enumerate(sets):
                sketch[i] = np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
                first = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
                keys.append(x[np.argsort(level[_cell(x)], kind="stable")[:first]].view(np.int64))
            bits = np.packbits(sketch, axis=1).view(">i4").astype(np.int32)
            lists = lambda flat, ends: pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(places)), pa.array([len(x) for x in sets], pa.int32()), pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64).view(np.int64)),
                 lists(bits.reshape(-1), np.arange(1, len(sets) + 1) * (SKETCH // 32)), lists(np.concatenate(keys), np.cumsum([len(k) for k in keys]))],
                names=["doc_id", "size", "whole", "segments", "keys"],
            )

    rows = docs.select(F.col("id").alias("doc_id"), "text")
    out = stored(mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, size int, whole long, segments array<int>, keys array<long>"))
    shared.destroy()
    return out


def _stars(members: DataFrame, order: Column, similarity: float) -> DataFrame:
    """Each member of a row with the first of the row by some order, if of another class, and if sizes and the key's places allow the similarity."""
    least = members.groupBy("key").agg(F.min(F.struct(order.alias("order"), "doc_id", "class", "size", "pos")).alias("least"))
    fits = F.least(F.col("size") - F.col("pos"), F.expr("least.size - least.pos")) >= similarity / (1 + similarity) * (F.col("size") + F.col("least.size")) - 1e-9
    return members.join(least, "key").filter(F.col("class") != F.col("least.class")).filter(fits).select(F.col("doc_id").alias("u"), F.col("least.doc_id").alias("v")).distinct()


def _classes(rows: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, size and segments of rows, and the smallest doc_id that is reachable (class)."""
    classes = components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("class"))
    return stored(rows.join(classes, "doc_id", "left").select("doc_id", "size", "segments", F.coalesce("class", "doc_id").alias("class")))


def _compared(groups: DataFrame, kind: str, similarity: float, nearest: bool) -> DataFrame:
    """Pairs u > v of different classes (and of different blocks, if i and j of a group differ) of its members (all), but those whose sizes, places of
    the key or sketches rule the similarity out; nearest: for each document of a batch only the one that is likeliest by the sketches (apart: differing bits a shingle)."""
    need = similarity / (1 + similarity)

    def run(batches):
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            for k in range(batch.num_rows):
                rows = batch.column(2).values.slice(ends[k], ends[k + 1] - ends[k])
                size, pos, block = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "pos", "block"))
                of = rows.field("class").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                prints = rows.field("segments").flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1).view(np.uint64)
                left, right, apart = [], [], []
                for a in range(len(size) - 1):
                    ok = of[a + 1 :] != of[a]
                    if batch.column(0)[k].as_py() != batch.column(1)[k].as_py():
                        ok &= block[a + 1 :] != block[a]
                    total = size[a + 1 :] + size[a]
                    ok &= np.minimum(size[a + 1 :] - pos[a + 1 :], size[a] - pos[a]) >= need * total - 1e-9
                    b = np.flatnonzero(ok)
                    if len(b):
                        bits = np.bitwise_count(prints[b + a + 1] ^ prints[a]).sum(axis=1, dtype=np.int64)
                        close = bits <= (1 - 2 * need) * total[b] + 1e-9
                        b = b[close]
                        left.append(np.full(len(b), a))
                        right.append(b + a + 1)
                        apart.append(bits[close] / total[b])
                if left:
                    left, right, apart = (np.concatenate(x) for x in (left, right, apart))
                    if nearest:
                        left, right, apart = np.append(left, right), np.append(right, left), np.append(apart, apart)
                        order = np.lexsort((apart, left))
                        order = order[np.append(True, left[order][1:] != left[order][:-1])[: len(order)]]
                        left, right, apart = left[order], right[order], apart[order]
                    doc = rows.field("doc_id")
                    yield pa.record_batch([doc.take(pa.array(left)), doc.take(pa.array(right)), pa.array(apart, pa.float64())], names=["a", "b", "apart"])

    pairs = mapped(groups.select("i", "j", "all"), run, f"a {kind}, b {kind}, apart double")
    if nearest:
        pairs = pairs.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _nearest(members: DataFrame, known: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs u > v of different classes, one a document at most: each with the nearest it meets in its rows.

    A row is cut into blocks by a hash that is another one each turn, and a block's members meet each other, so this grows with the members and not with their square.
    """
    rows = members.join(known.select("doc_id", "class"), "doc_id").groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = members.drop("size").join(rows, "key").join(known, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id", "key", F.lit(turn)), F.col("blocks")).cast("int"))
    groups = dealt.groupBy("key", F.col("block").alias("i"), F.col("block").alias("j")).agg(F.collect_list(F.struct("doc_id", "class", "size", "pos", "block", "segments")).alias("all"))
    return _compared(groups, known.schema["doc_id"].dataType.simpleString(), similarity, True)


def _other_candidates(members: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """All pairs u > v of different classes that share a key, but those whose sizes, places of the key or sketches rule the similarity out.

    A row of n members is cut into blocks by hash, and each two blocks are compared in a task's memory, so no row is too long.
    """
    met = members.drop("size").join(known, "doc_id")
    rows = met.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = met.join(rows, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("doc_id", "class", "size", "pos", "block", "segments")).alias("all"))
    return _compared(groups, known.schema["doc_id"].dataType.simpleString(), similarity, False)


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of pairs u, v whose sets of shingles are similar; sketches, which differ in at most as many bits as the sets in shingles, rule most others out."""
    side = lambda doc, bits, size: rows.select(F.col("doc_id").alias(doc), F.col("segments").alias(bits), F.col("size").alias(size))
    most = (1 - similarity) / (1 + similarity) * (F.col("m") + F.col("n")) + 1e-9
    close = stored(pairs.join(side("u", "a", "m"), "u").join(side("v", "b", "n"), "v").filter(distance("a", "b", SKETCH // 32) <= most).select("u", "v"))
    ends = close.select(F.explode(F.array("u", "v")).alias("id"))
    met = with_hit(docs, filter_of(ends, "id"), "id").filter("_hit").select("id", "text")

    def shingled(batches):
        for batch in (s for b in batches for s in slices(b, 1, _SLICE)):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "set"])

    sets = stored(mapped(met, shingled, f"id {met.schema['id'].dataType.simpleString()}, set array<long>"))
    near = []
    for part in range(PARTS):
        own = close.filter(F.pmod(F.xxhash64("u"), F.lit(PARTS)) == part)
        both = own.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
        shared = both.withColumn("shared", F.size(F.array_intersect("a", "b")))
        near.append(stored(shared.filter(F.col("shared") >= similarity * (F.size("a") + F.size("b") - F.col("shared")) - 1e-9).select("u", "v")))
    removed(sets)
    removed(close)
    return reduce(DataFrame.unionByName, near)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of every document that has a near duplicate; doc_id must be unique and not null.

    Two texts are near duplicates if their sets of five-word shingles have a Jaccard similarity
    of at least ``similarity``. Every such pair ends in one component: candidates are all that share one of the first
    shingles (see _prefixes), and each is verified by the complete sets. First every document is verified against the
    smallest of each of its rows, and against the smallest with an equal set, which stands for them from then on;
    then against a member of another class that differs from row to row, then, as long as that links a tenth of many, against the nearest of another class that it meets in its rows of more than CROWD members (see _nearest), and
    at last all pairs that are still of different classes. So a large group of near copies costs a few candidates a member; only pairs that are just below the similarity, in classes that nothing
    links, are all verified. As the rarest shingles come first, what a family of texts shares is a key only if it is most of them. A text without words has no near duplicate.
    """
    bare = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    prefixes = _prefixes(bare, words, similarity)
    rows = stored(prefixes.drop("keys"))
    equal = rows.groupBy("whole", "size").agg(F.count("*").alias("n"), F.min("doc_id").alias("v")).filter("n > 1").drop("n")
    copies = stored(rows.join(equal, ["whole", "size"]).filter("doc_id <> v").select(F.col("doc_id").alias("u"), "v"))
    dealt = without(prefixes, copies.select(F.col("u").alias("doc_id")), "doc_id").select("doc_id", "size", F.posexplode("keys").alias("pos", "key"))
    again = stored(dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = stored(with_hit(dealt, filter_of(again, "key"), "key").filter("_hit").drop("_hit").join(again.select("key"), "key"))
    removed(prefixes)
    crowd = stored(members.join(again.filter(F.col("n") > CROWD).select("key"), "key"))
    removed(again)

    first = _verified(_stars(members.withColumn("class", F.col("doc_id")), F.col("doc_id"), similarity).unionByName(copies), rows, bare, words, similarity)
    second = _verified(_stars(members.join(_classes(rows, first).select("doc_id", "class"), "doc_id"), F.xxhash64("key", "doc_id"), similarity), rows, bare, words, similarity)
    near, turn = stored(first.unionByName(second)), 0
    while (most := (pairs := stored(_nearest(crowd, _classes(rows, near), similarity, turn))).count()) >= BLOCK:
        found = _verified(pairs, rows, bare, words, similarity)
        near, turn = stored(near.unionByName(found)), turn + 1
        if found.count() * 10 < most:
            break
    others = _verified(stored(_other_candidates(members, _classes(rows, near), similarity)), rows, bare, words, similarity)
    near = near.unionByName(others)
    return components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id of every document that has a near copy; doc_id must be unique and not null.

    Two texts are near copies if their SimHash fingerprints differ in 2 bits at most (see simhash_classes). Fingerprints lose
    pairs whose sets of shingles are similar all the same, so links of near_duplicates, which loses none, join them. Both go over all
    documents, not over what stands for a class, so no link of either is lost.
    """
    found = [simhash_classes(docs, doc_id, text), near_duplicates(docs, doc_id, text)]
    near = reduce(DataFrame.unionByName, [f.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")) for f in found])
    return components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
