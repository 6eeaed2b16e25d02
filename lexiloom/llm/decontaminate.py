"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may occur in a document with up to k = n * error_rate edits. Cut into
k + 1 pieces, one of them must be there unchanged: exact hits of all pieces are found in one pass (Aho-Corasick),
and where a piece is found the whole item is verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict, defaultdict
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, stored

#: Characters of item text in a block at most; a block's pieces are one automaton.
BLOCK_CHARS = 2_000_000
#: Blocks that are searched at a time.
TOGETHER = 4
#: An item has so many characters a piece at least.
LEAST_PIECE = 8


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of about equal length with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def budget(item: str, error_rate: float, least_piece: int = LEAST_PIECE) -> int:
    return max(0, min(int(len(item) * error_rate), len(item) // least_piece - 1))


def myers(pattern: str, text: str) -> int:
    """The least edit distance between the pattern and any part of the text."""
    m = len(pattern)
    if not m:
        return 0
    where = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, now = full, 0, m
    best = m
    for c in text:
        same = where.get(c, 0)
        vertical = same | minus
        diagonal = (((same & plus) + plus) ^ plus) | same
        rises = minus | ~(diagonal | plus) & full
        falls = plus & diagonal
        if rises & top:
            now += 1
        elif falls & top:
            now -= 1
            best = min(best, now)
        rises, falls = rises << 1 & full, falls << 1 & full
        plus, minus = falls | ~(vertical | rises) & full, rises & vertical
    return best


class Matcher:
    """The automaton of a block of items: (item_id, normalised text, errors)."""

    def __init__(self, items: list[tuple[int, str, int]]):
        self.items = items
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, errors) in enumerate(items):
            for at, piece in pieces_of(text, errors):
                places[piece].append((k, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of the items in a normalised text."""
        if not self.items:
            return []
        begins: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                begins.setdefault(k, []).append(end + 1 - size - at)
        out = []
        for k, found in begins.items():
            item_id, item, errors = self.items[k]
            best, done = errors + 1, None
            for begin in sorted(found):
                if done is not None and begin <= done:
                    continue
                if text.startswith(item, max(begin, 0)) and begin >= 0:
                    best = 0
                    break
                if errors:
                    # one window for all beginnings within the budget of this one
                    last = begin + errors
                    best = min(best, myers(item, text[max(0, begin - errors) : last + len(item) + errors]))
                    done = last
            if best <= errors:
                out.append((item_id, best))
        return sorted(out)


def find_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.06, cut: int = BLOCK_CHARS, least_piece: int = LEAST_PIECE
) -> DataFrame:
    """The columns of docs with hits (array of item_id and distance) beside them, sorted by item_id.

    Texts are compared in lower case with runs of white space as one space. text may be a field of a struct column (``doc.text``). Items that are empty
    or null never match, nor do null and empty documents; documents of any length are read whole, repeated rows stay as they are, an empty table gives an
    empty one. A column of docs named hits is replaced.

    The items are a query set: they come to the driver block by block (by hash of the id, about ``cut`` characters each) and are
    broadcast, TOGETHER blocks at a time, which is all that a worker holds. If there are no more, each document is read once and nothing is shuffled;
    else the documents are written once, each lot of blocks makes a pass over them and leaves its hits, and the hits (few) are joined at the end.
    Budgets are ``error_rate`` of an item's characters, less only where a piece would be shorter than ``least_piece``, which no item meets at the default rate.
    """
    clean = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).filter("item_id is not null and item_text is not null")
    total = clean.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-total // cut))

    def shared(b: int):
        own = clean.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        listed = [(i, t, budget(t, error_rate, least_piece)) for i, t in sorted({(r["item_id"], normal(r["item_text"])) for r in own}) if t]
        return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(listed).encode()).digest(), listed))

    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "hits"])
    if blocks <= TOGETHER:
        return _searched(plain, text, [shared(b) for b in range(blocks)])
    whole = F.struct(*[F.col(f"`{c}`") for c in plain.columns])
    rows = stored(plain.select(F.monotonically_increasing_id().alias("row"), whole.alias("doc")))
    texts, parts = rows.select("row", F.col(f"doc.{text}").cast("string").alias("text")), []
    for a in range(0, blocks, TOGETHER):
        lot = [shared(b) for b in range(a, min(blocks, a + TOGETHER))]
        parts.append(stored(_searched(texts, "text", lot).select("row", "hits").filter(F.size("hits") > 0)))
        for x in lot:
            x.destroy()
    hits = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return rows.join(hits, "row", "left").select("doc.*", F.coalesce("hits", F.array().cast(_HITS)).alias("hits"))


_HITS = T.ArrayType(T.StructType().add("item_id", "long").add("distance", "integer"))


def _searched(docs: DataFrame, text: str, shared: list) -> DataFrame:
    """docs with the hits of some blocks."""
    names = docs.columns
    top, *inner = [text] if text in names else text.split(".")
    at = names.index(top)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def run(batches):
        matchers = [_matcher(block) for block in shared]
        for batch in batches:
            column = batch.column(at)
            for name in inner:
                column = pc.struct_field(column, name)
            hits = []
            for t in map(normal, column.to_pylist()):
                found = [h for m in matchers for h in m.hits(t)] if t else []
                hits.append([{"item_id": i, "distance": n} for i, n in sorted(found)])
            yield pa.record_batch([*batch.columns, pa.array(hits, kind)], names=[*names, "hits"])

    return mapped(docs, run, T.StructType([*docs.schema, T.StructField("hits", _HITS)]))


_kept: OrderedDict = OrderedDict()


def _matcher(block) -> Matcher:
    """A worker keeps the automata of the last TOGETHER blocks, by a hash of all that is in a block."""
    mark, items = block.value
    if mark not in _kept:
        while len(_kept) >= TOGETHER:
            _kept.popitem(last=False)
        _kept[mark] = Matcher(items)
    _kept.move_to_end(mark)
    return _kept[mark]
