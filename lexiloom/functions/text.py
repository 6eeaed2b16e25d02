"""Words of the full-text index: folding, tokens, stems, and the query language."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.arrow import mapped, slices

#: Latin letters with marks and what is left without them, by decomposition.
_MARKED = {chr(c): b[0] for c in range(0xC0, 0x250) if len(b := unicodedata.normalize("NFD", chr(c))) > 1 and b[0].isascii()}
SEPARATOR = r"[^\p{L}\p{N}\p{Co}]+"


def folded(text: Column) -> Column:
    """Text of single bytes has no marks, and is not looked up letter by letter."""
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, "".join(_MARKED), "".join(_MARKED.values()))))


def tokens(text: Column) -> Column:
    """Words in order: lower case, Latin marks stripped, split at anything but letters and digits."""
    return F.filter(F.split(folded(text), SEPARATOR), lambda t: t != "")


def spaced(text: Column) -> Column:
    """The words of tokens as one string, each with a space of its own before and behind it."""
    return F.concat(F.lit(" "), F.regexp_replace(folded(text), SEPARATOR, "  "), F.lit(" "))


def word_count(text: Column) -> Column:
    """How many words tokens has; folding makes no letter of what is none and none of a letter, so it is left out."""
    return F.regexp_count(text, F.lit(SEPARATOR.replace("^", "")))


def fold(text: str) -> str:
    return "".join(_MARKED.get(c, c) for c in text).lower()


def split(text: str) -> list[str]:
    import regex

    return [t for t in regex.split(SEPARATOR, fold(text)) if t]


# -- stems -----------------------------------------------------------------------------


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by a consonant."""
    return len(re.findall("vc", re.sub("v+", "v", re.sub("c+", "c", _shape(stem)))))


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _short_end(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# Suffixes of the published Porter algorithm and what replaces them.
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replaced(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The published Porter stemmer; words of one or two letters, or of other than a to z, stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2), _STEP_3)
    for suffix in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(word: str) -> Column:
    """Of a column of words. Meant for a distinct vocabulary, not for every token."""

    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(porter)

    return F.pandas_udf(stemmed, "string")(word)


@functools.lru_cache(1 << 17)
def stem_of(word: str) -> str:
    return porter(word)


def stemmed(rows: DataFrame, column: str, firsts: set[str], whole: bool) -> DataFrame:
    """Stems in place of words in a column made by spaced, for words that begin with some characters (a stem begins as its word does). The other words stay if whole is asked for, and are left out if not."""
    some = re.compile("(?<= )[" + "".join(map(re.escape, sorted(firsts))) + "][^ ]*")
    at = rows.columns.index(column)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                if whole:
                    texts = [None if t is None else some.sub(lambda m: stem_of(m[0]), t) for t in texts]
                else:
                    texts = [None if t is None else f" {'  '.join(map(stem_of, some.findall(t)))} " for t in texts]
                yield part.set_column(at, column, pa.array(texts, pa.string()))

    return mapped(rows, run, rows.schema)


# -- queries ---------------------------------------------------------------------------


def sanitize(query: str) -> str:
    """What a user types, as an expression: quoted text as it is; else every token a prefix, all of them required; empty if any
    character is beyond ASCII letters, digits, _ and quotes."""
    query = query.strip()
    if not query or len(query) > 1 and query[0] == query[-1] == '"':
        return query
    parts = query.replace('"', '""').split()
    if any(re.search(r'[^A-Za-z0-9_"]', p) for p in parts):
        return ""
    return " ".join(p + "*" for p in parts)


def sanitized(query: Column) -> Column:
    """The same of a column."""
    space = r"[ \t\n\r\f\x0B]+"
    q = F.regexp_replace(query, f"^{space}|{space}$", "")
    parts = F.filter(F.split(F.replace(q, F.lit('"'), F.lit('""')), space), lambda w: w != "")
    typed = F.array_join(F.transform(parts, lambda w: F.concat(w, F.lit("*"))), " ")
    quoted = (F.length(q) > 1) & q.startswith('"') & q.endswith('"')
    return F.when((q == "") | quoted, q).when(q.rlike(r'[^A-Za-z0-9_" \t\n\r\f\x0B]'), "").otherwise(typed)


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool  # of the last word


def parse(expression: str, stemmed: bool = False):
    """A tree of Phrase, ("and", a, b), ("or", a, b) and ("not", a, b); none of an expression without words."""
    lexed, i = [], 0
    while i < len(expression):
        c = expression[i]
        if c.isspace():
            i += 1
        elif c in "()*":
            lexed.append(c)
            i += 1
        elif c == '"':
            text, i = "", i + 1
            while True:
                if i >= len(expression):
                    raise QuerySyntaxError("unterminated string")
                if expression[i] == '"':
                    if expression[i + 1 : i + 2] != '"':
                        break
                    i += 1
                text, i = text + expression[i], i + 1
            lexed.append(("string", text))
            i += 1
        else:
            m = re.match(r"[0-9A-Za-z_\x80-\U0010ffff]+", expression[i:])
            if not m:
                raise QuerySyntaxError(f"unexpected {c}")
            lexed.append(m[0] if m[0] in ("AND", "OR", "NOT") else ("string", m[0]))
            i += m.end()
    at = 0

    def peek():
        return lexed[at] if at < len(lexed) else None

    def phrase():
        nonlocal at
        token = peek()
        if token == "(":
            at += 1
            out = either()
            if peek() != ")":
                raise QuerySyntaxError("missing )")
            at += 1
            return out
        if not isinstance(token, tuple):
            raise QuerySyntaxError(f"unexpected {token}")
        at += 1
        prefix = peek() == "*"
        at += prefix
        words = split(token[1])
        return Phrase(tuple(porter(w) for w in words) if stemmed else tuple(words), prefix)

    def chain(inner, word, name):
        nonlocal at
        out = inner()
        while peek() == word:
            at += 1
            out = (name, out, inner())
        return out

    def both():
        nonlocal at
        out = chain(phrase, "NOT", "not")
        while peek() is not None and peek() not in ("OR", ")"):
            if peek() == "AND":
                at += 1
            elif not isinstance(peek(), tuple) and peek() != "(":
                raise QuerySyntaxError(f"unexpected {peek()}")
            out = ("and", out, chain(phrase, "NOT", "not"))
        return out

    def either():
        return chain(both, "OR", "or")

    if not lexed:
        return None
    tree = either()
    if at < len(lexed):
        raise QuerySyntaxError(f"unexpected {lexed[at]}")
    return _without_empty(tree)


def _without_empty(tree):
    if isinstance(tree, Phrase):
        return tree if tree.words else None
    kind, a, b = tree[0], _without_empty(tree[1]), _without_empty(tree[2])
    if a is None or b is None:
        return a if b is None else (None if kind == "not" else b)
    return kind, a, b


def phrases(tree) -> list[Phrase]:
    """Those that count for the score, in order."""
    if tree is None:
        return []
    if isinstance(tree, Phrase):
        return [tree]
    return phrases(tree[1]) + ([] if tree[0] == "not" else phrases(tree[2]))
