"""BPE vocabularies compiled to deterministic finite-state transducers.

A byte-pair vocabulary file is read as a rewriting system and compiled, lazily, to a
transducer over bytes. After a prefix of a word its state holds

* the longest suffix of the prefix that begins some vocabulary entry, and
* for every place inside that suffix where a later entry may begin: the last token of the
  tokenisation up to there, and how many tokens that tokenisation has less than the whole.

Tokens that allow the same continuations count as one. All this is finite; equal contents are one state. Reading a byte, exactly one entry that
ends there may follow the token before it (two neighbours are legal if merging their bytes
anew gives the same two), hence the machine is deterministic. Each transition carries the
change in the number of tokens; each state the id and length of its last token, from which
the ids are read backwards.

Running it: the pre-tokeniser (a definite machine with one character of look-ahead) marks
where words begin, and at such a mark the state is reset. A stream of bytes is cut into
equal chunks that run in lockstep, one vector operation a byte column. What a chunk does to
an entering state is a map: constant behind its first mark, pending before it. Maps compose
associatively; a prefix scan finds for each chunk the nearest constant map to its left, and
only the pending bytes are run again.

Memory is bounded: a machine of more than ``max_states`` states is thrown away and grows
anew from the texts that follow.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Bits of a table entry for the change in the token count, and what is added to it.
_SHIFT, _BIAS = 6, 48
_LETTER, _NUMBER, _SPACE, _OTHER, _EDGE, _UNSEEN = 1, 2, 3, 0, 9, 8
#: Characters of a stream at most, and bytes of a chunk at least.
_STREAM, _CHUNK = 1_500_000, 192


def _byte_chars() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class CompiledTokenizer:
    """One vocabulary file; ``encode`` gives ids, ``count`` only their number."""

    def __init__(self, path: str, max_states: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.word_style = bool(self.suffix)  # lower case, white space dropped
        self.max_states = max_states
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

        def symbols(token: str) -> str:
            end = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
            out = [chars[c] for c in (token[: -len(self.suffix)] if end else token)]
            if end:
                out[-1] += 256
            return "".join(map(chr, out))

        self.vocab = {symbols(t): i for t, i in model["vocab"].items() if all(c in chars for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(symbols(a), symbols(b)): k for k, (a, b) in reversed(list(enumerate(pairs)))}
        library = Tokenizer.from_file(path)
        self._library, self._normalizer = library.pre_tokenizer, library.normalizer
        self._kinds = np.full(0x110000, _UNSEEN, np.uint8)
        self._arrange()
        self._flush()

    # -- the machine ---------------------------------------------------------------

    def _flush(self) -> None:
        self.wide = 64
        self.known: dict = {}
        self.states: list = []
        self.token, self.length = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.table = np.full((1024, self.wide), -1, np.int32)
        self.symbol_class = np.full(512, -1, np.int32)
        self.class_symbol: list[int] = []
        self._intern("", (("", 0),), "")

    def _intern(self, suffix: str, history: tuple, last: str) -> int:
        key = (suffix, history)
        if (k := self.known.get(key)) is None:
            k = self.known[key] = len(self.states)
            self.states.append(key)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.token, self.length = np.resize(self.token, 2 * k), np.resize(self.length, 2 * k)
            self.token[k], self.length[k] = self.vocab.get(last, -1), len(last)
        return k

    # -- which token may follow which --------------------------------------------------
    #
    # Put two tokens together side by side: at their border stand, one after the other, the
    # right edges of the first and the left edges of the second. They are not neighbours in any
    # tokenisation if two edges that stand there at once can merge before either goes on.
    # Left edges form a forest (a token below the left half it is made of). With children
    # in falling rank, all tokens that one such pair of edges rules out stand together in preorder.

    def _arrange(self) -> None:
        rank_of, half = {}, {}
        for (a, b), k in self.rank.items():
            if rank_of.get(a + b, 1 << 30) > k:
                rank_of[a + b], half[a + b] = k, (a, b)
        self.half, self.rank_of = half, rank_of
        below: dict[str, list[str]] = {}
        for t in sorted(half, key=rank_of.__getitem__, reverse=True):
            below.setdefault(half[t][0], []).append(t)
        self.spot, self.stop, self.below = {}, {}, below  # preorder: own place, place behind the last below
        stack = [(t, False) for t in sorted(self.vocab) if t not in half]
        while stack:
            t, done = stack.pop()
            if done:
                self.stop[t] = len(self.spot)
            else:
                self.spot[t] = len(self.spot)
                stack.append((t, True))
                stack += [(c, False) for c in reversed(below.get(t, ()))]
        self.after: dict[str, list[str]] = {}
        for a, b in self.rank:
            self.after.setdefault(a, []).append(b)
        self.sorted = sorted(self.spot)
        self.place = {t: i for i, t in enumerate(self.sorted)}
        self.spots = np.array([self.spot[t] for t in self.sorted])
        self.begins: dict[str, tuple[int, int]] = {}
        for i, t in enumerate(self.sorted):
            for k in range(1, len(t) + 1):
                lo, _ = self.begins.get(t[:k], (i + (k == len(t)), 0))
                self.begins[t[:k]] = lo, i + 1  # entries that begin so and go on
        self._ruled, self._rows, self._class, self._first = {}, {}, {}, {}

    def _rules_out(self, edge: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a right edge: when it must be gone for a range of tokens to be legal, and the ranges in preorder."""
        if (out := self._ruled.get(edge)) is None:
            when, start, stop, since = [], [], [], self.rank_of.get(edge, -1)
            for y in self.after.get(edge, ()):
                rank = self.rank[edge, y]
                end = self.spot[y] + 1
                for c in self.below.get(y, ()):
                    if self.rank_of[c] < max(rank, since):
                        break
                    end = self.stop[c]
                when.append(max(rank, self.rank_of.get(y, -1)))
                start.append(self.spot[y])
                stop.append(end)
            order = np.argsort(when, kind="stable")
            out = self._ruled[edge] = tuple(np.array(x, np.int64)[order] for x in (when, start, stop))
        return out

    def _row(self, before: str) -> np.ndarray:
        """Bits by sorted entry: may it follow?"""
        if (out := self._rows.get(before)) is None:
            if len(self._rows) >= 4000:
                self._rows.clear()
            change = np.zeros(len(self.spot) + 1, np.int32)
            edge, ends = before, 1 << 40
            while edge:
                when, start, stop = self._rules_out(edge)
                n = int(np.searchsorted(when, ends))
                np.add.at(change, start[:n], 1)
                np.add.at(change, stop[:n], -1)
                ends = self.rank_of.get(edge, -1)
                edge = self.half[edge][1] if edge in self.half else ""
            out = self._rows[before] = np.packbits((np.cumsum(change[:-1]) == 0)[self.spots])
        return out

    def _may_follow(self, before: str, token: str) -> bool:
        if not before:
            return True
        i = self.place[token]
        return bool(self._row(before)[i >> 3] >> (7 - (i & 7)) & 1)

    def _like(self, before: str, begun: str) -> str | None:
        """The first token met that allows the same continuations of what has begun; none if there are none."""
        key = (before, begun)
        if key not in self._class:
            if len(self._class) > 300_000:
                self._class.clear()
            lo, hi = self.begins[begun]
            bits = np.ones(hi - lo, np.uint8) if not before else np.unpackbits(self._row(before)[lo >> 3 : (hi + 7) >> 3])[lo & 7 :][: hi - lo]
            digest = hashlib.blake2b(bits.tobytes(), digest_size=12).digest()
            self._class[key] = self._first.setdefault((begun, digest), before) if bits.any() else None
        return self._class[key]

    def _build(self, state: int, klass: int) -> int:
        """Adds one transition; its table entry."""
        suffix, history = self.states[state]
        now = suffix + chr(self.class_symbol[klass])
        while now not in self.begins:
            now = now[1:]
        for size in range(len(now), 0, -1):
            token = now[-size:]
            if token in self.place and (place := history[size - 1]) is not None and self._may_follow(place[0], token):
                break
        else:
            raise ValueError("this vocabulary has no single bytes")
        more = place[1] + 1
        if not -_BIAS <= more < (1 << _SHIFT) - _BIAS:
            raise OverflowError("a token count changed by too much at once")
        past = []
        for k in range(1, len(now) + 1):
            at, like = history[k - 1], None
            if at is not None and now[-k:] in self.begins:
                like = self._like(at[0], now[-k:])
            past.append(None if like is None else (like, at[1] - more))
        while past and past[-1] is None:
            past.pop()
        entry = self._intern(now[len(now) - len(past) :], ((token, 0), *past), token) << _SHIFT | more + _BIAS
        self.table[state, klass] = entry
        return entry

    def _fill(self, states: np.ndarray, classes: np.ndarray, entries: np.ndarray) -> np.ndarray:
        for pair in np.unique(states[entries < 0].astype(np.int64) << 10 | classes[entries < 0]):
            self._build(int(pair >> 10), int(pair & 1023))
        return self.table[states, classes]

    def _classed(self, symbols: np.ndarray) -> np.ndarray:
        out = self.symbol_class[symbols]
        if out.size and out.min() < 0:
            for s in np.unique(symbols[out < 0]):
                self.symbol_class[s] = len(self.class_symbol)
                self.class_symbol.append(int(s))
            while len(self.class_symbol) > self.wide:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                self.wide *= 2
            out = self.symbol_class[symbols]
        return out

    def run(self, symbols: np.ndarray, marks: np.ndarray, chunk: int = _CHUNK) -> np.ndarray:
        """Table entry after each symbol. marks: where a word begins; the first is one."""
        if len(self.states) > self.max_states:
            self._flush()
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int32)
        lanes = max(1, min(8192, n // chunk))
        long = -(-n // lanes)
        classes = np.zeros(lanes * long, np.int32)
        classes[:n] = self._classed(symbols)
        going = np.zeros(lanes * long, np.int32)
        going[:n] = ~marks
        by_lane = going.reshape(lanes, long)
        first = np.where(by_lane.all(axis=1), long, by_lane.argmin(axis=1))  # of each chunk's marks
        classes, going = np.ascontiguousarray(classes.reshape(lanes, long).T), np.ascontiguousarray(by_lane.T)
        out = np.empty((long, lanes), np.int32)
        s = np.zeros(lanes, np.int32)
        for i in range(long):
            s *= going[i]
            e = self.table.ravel().take(s * self.wide + classes[i])
            if e.min() < 0:
                e = self._fill(s, classes[i], e)
            out[i] = e
            s = e >> _SHIFT
        leaves = s.copy()
        for lane in np.flatnonzero(first == long):  # pending throughout: in order
            k = int(leaves[lane - 1])
            for i in range(long):
                c = int(classes[i, lane])
                e = int(self.table[k, c])
                e = e if e >= 0 else self._build(k, c)
                out[i, lane] = e
                k = e >> _SHIFT
            leaves[lane] = k
        lane = np.flatnonzero((first > 0) & (first < long))
        s, i = leaves[lane - 1], 0
        while lane.size:
            e = self.table[s, classes[i, lane]]
            if e.min() < 0:
                e = self._fill(s, classes[i, lane], e)
            out[i, lane] = e
            i += 1
            on = first[lane] > i
            lane, s = lane[on], (e >> _SHIFT)[on]
        return np.ascontiguousarray(out.T).reshape(-1)[:n]

    # -- the pre-tokeniser ------------------------------------------------------------

    def _kind_of(self, point: int) -> int:
        """Letter, number, white space or other: what the library's pre-tokeniser joins it with."""
        joins = lambda c: any(b - a == 2 for _, (a, b) in self._library.pre_tokenize_str(c + chr(point)))
        if joins("a"):
            return _LETTER
        if joins("!"):
            return _OTHER
        if self.word_style:
            return _NUMBER if self._library.pre_tokenize_str(chr(point)) else _SPACE
        return _NUMBER if joins("1") else _SPACE

    def _words(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin among the code points of joined texts, and which are white space. starts: of the texts."""
        kind = self._kinds[points]
        if kind.size and (new := np.unique(points[kind == _UNSEEN])).size:
            self._kinds[new] = [self._kind_of(int(p)) for p in new]
            kind = self._kinds[points]
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[starts] = _EDGE
        marks = kind != before
        space = kind == _SPACE
        text_start = np.zeros(len(points) + 1, bool)
        text_start[starts] = True
        text_start[-1] = True
        if self.word_style:
            marks |= kind == _NUMBER
        else:
            after = np.empty_like(kind)
            after[:-1] = kind[1:]
            after[text_start[1:]] = _EDGE
            last = space & (after != _SPACE) & (after != _EDGE)
            marks |= last
            marks[1:][(last & (points == 32))[:-1]] = False
        apostrophe = np.flatnonzero((points == 39) & marks)
        if apostrophe.size:
            padded = np.concatenate([points, np.zeros(3, points.dtype)])
            edge = np.concatenate([text_start, np.ones(3, bool)])
            one = np.where(edge[apostrophe + 1], 0, padded[apostrophe + 1])
            two = np.where(edge[apostrophe + 1] | edge[apostrophe + 2], 0, padded[apostrophe + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for hit, size in ((short, 2), (long, 3)):
                at = apostrophe[hit]
                for k in range(1, size):
                    marks[at + k] = False
                end = at + size
                end = end[~edge[end]]
                marks[end[kind[end] == _LETTER]] = True
        return marks, space

    def _normal(self, text: str) -> str:
        if not self.word_style:
            return text
        if not text.isascii():
            # Versions of Unicode differ in what has a lower case and in what NFC moves or composes: such texts are left to the file's own normaliser.
            if not unicodedata.is_normalized("NFC", text) or _unassigned(text):
                return self._normalizer.normalize_str(text)
            text = text.replace("Σ", "σ")
        return text.lower()

    def _stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, marks and each text's end, of some texts without special strings."""
        texts = [self._normal(t) for t in texts]
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.unique(np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]).astype(np.int64)
        raw = np.frombuffer(joined.encode(), np.uint8)
        if len(raw) == len(joined):
            marks, space = self._words(raw, starts)
            first = None
        else:
            marks, space = self._words(np.frombuffer(joined.encode("utf-32-le"), np.uint32), starts)
            first = np.flatnonzero((raw & 0xC0) != 0x80)
            ends = np.append(first, len(raw))[ends]
            of = np.zeros(len(raw), bool)
            of[first] = marks
            if self.word_style:
                space = np.repeat(space, np.diff(np.append(first, len(raw))))
            marks = of
        if not self.word_style:
            return raw, marks, ends
        keep = ~space
        ends = np.append(0, np.cumsum(keep))[ends]
        symbols, marks = raw[keep].astype(np.int32), marks[keep]
        if symbols.size:
            symbols[np.append(np.flatnonzero(marks)[1:] - 1, len(symbols) - 1)] += 256
        return symbols, marks, ends

    def _ids(self, entries: np.ndarray, marks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and where each text's ids end: tokens are read backwards from the end of each word."""
        state = entries >> _SHIFT
        if not len(state):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        length = self.length[state]
        is_end = np.zeros(len(state), bool)
        at = np.append(np.flatnonzero(marks)[1:] - 1, len(state) - 1)
        while at.size:
            is_end[at] = True
            begin = at - length[at] + 1
            at = begin[~marks[begin]] - 1
        return self.token[state[is_end]], np.append(0, np.cumsum(is_end))[ends]

    def _groups(self, texts: list) -> list[tuple[int, int]]:
        """Ranges of texts of about _STREAM characters."""
        out, a, size = [], 0, 0
        for b, t in enumerate(texts):
            size += len(t or "")
            if size >= _STREAM:
                out.append((a, b + 1))
                a, size = b + 1, 0
        return out + [(a, len(texts))] * (a < len(texts))

    def _pieces(self, texts: list) -> tuple[list[str], list[int] | None, list[list[int]] | None]:
        """Texts between special strings; how many each text has and the ids between them, if any text has one."""
        plain = [t or "" for t in texts]
        if not self._special or not any("<|" in t for t in plain):
            return plain, None, None
        parts = [self._special.split(t) for t in plain]
        return [p for ps in parts for p in ps], [len(p) for p in parts], [[self.specials[x] for x in self._special.findall(t)] for t in plain]

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, and len(texts) + 1 offsets. Null is the empty text."""
        ids, sizes = [], []
        for a, b in self._groups(texts):
            pieces, owners, between = self._pieces(texts[a:b])
            symbols, marks, ends = self._stream(pieces)
            out, stops = self._ids(self.run(symbols, marks), marks, ends)
            if owners is None:
                ids.append(out)
                sizes.append(np.diff(stops, prepend=0))
                continue
            split, k = np.split(out, stops[:-1]), 0
            for n, special in zip(owners, between):
                own = [split[k]]
                for j, s in enumerate(special, 1):
                    own += [np.array([s], np.int32), split[k + j]]
                k += n
                ids.append(np.concatenate(own))
                sizes.append(np.array([len(ids[-1])]))
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)

    def count(self, texts: list) -> np.ndarray:
        """The number of tokens of each text: sums of what the transitions carry."""
        out = []
        for a, b in self._groups(texts):
            pieces, owners, between = self._pieces(texts[a:b])
            symbols, marks, ends = self._stream(pieces)
            sums = np.append(0, np.cumsum((self.run(symbols, marks) & (1 << _SHIFT) - 1) - _BIAS, dtype=np.int64))
            n = np.diff(sums[ends], prepend=0)
            if owners is not None:
                n = np.add.reduceat(n, np.append(0, np.cumsum(owners)[:-1])) + [len(s) for s in between]
            out.append(n)
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@functools.lru_cache(1)
def _perhaps() -> re.Pattern:
    """Code points without a category in Python's Unicode version, and any beyond the first plane: a class of that plane is one look-up a character."""
    none = [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for c, before in zip(none, [-1, *none]) if c != before + 1]
    ends = [c for c, after in zip(none, [*none[1:], -1]) if c + 1 != after]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "\U00010000-\U0010ffff]")


def _unassigned(text: str) -> bool:
    """Whether a text has a code point that Python does not know."""
    return bool(_perhaps().search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


@functools.lru_cache(4)
def compiled(name: str, max_states: int = 150_000) -> CompiledTokenizer:
    """One machine a worker process and vocabulary."""
    return CompiledTokenizer(vocabulary_path(name), max_states)


def vocabulary_path(name: str) -> str:
    """A file's place on this machine: a path as it is, else one of the installed public files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
