"""Search for a literal or a regular expression, line by line, inside chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.patterns import DEFINITION_LINE, is_regex, java_regex, literal_factor, path_matches, quoted


def clamp(limit: int | None) -> int:
    return limit if limit and 0 < limit <= 50 else 25


def line_matches(line: Column, query: str, case_sensitive: bool = False, whole_word: bool = False, compat: bool = False) -> Column:
    """Whether a line matches. whole_word: some occurrence stands between other than word characters (compat: the first one does)."""
    if is_regex(query) and not (whole_word and not compat):
        hit = line.rlike(java_regex(query, case_sensitive))
    elif is_regex(query):
        hit = line.rlike(java_regex(rf"\b(?:{query})\b", case_sensitive))
    else:
        text, q = (line, query) if case_sensitive else (F.lower(line), query.lower())
        hit = F.contains(text, F.lit(q))
        if whole_word and not compat:
            hit &= text.rlike(f"(?<![0-9A-Za-z_]){quoted(q)}(?![0-9A-Za-z_])")
    if whole_word and compat:
        text, q = (line, query) if case_sensitive else (F.lower(line), query.lower())
        at = F.locate(q, text)
        word = "^[0-9A-Za-z_]$"
        before = F.when(at > 1, F.substr(text, at - 1, F.lit(1))).otherwise(F.lit(""))
        after = F.substr(text, at + len(q), F.lit(1))
        hit &= (at > 0) & ~before.rlike(word) & ~after.rlike(word)
    return hit


def matched(chunks: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False, language: str | None = None, path: str = "", compat: bool = False) -> DataFrame:
    """Chunks with matches (array of line and content) and score: the number of matching lines, twice that if one of them is a definition.

    Filters on language and path and a literal that every match holds go first, so they reach the scan.
    """
    rows = chunks.filter(F.col("language") == language) if language else chunks
    rows = rows.filter(path_matches(F.col("rel_path"), path)) if path and not compat else rows
    literal = query.lower() if not is_regex(query) else (literal_factor(query) or "").lower()
    if literal:
        rows = rows.filter(F.contains(F.lower(F.col("content")), F.lit(literal)))
    lines = F.transform(F.split("content", "\n", -1), lambda x, i: F.struct((F.col("start_line") + i).cast("int").alias("line"), x.alias("content")))
    found = F.filter(lines, lambda m: line_matches(m["content"], query, case_sensitive, whole_word, compat))
    rows = rows.withColumn("matches", found).filter(F.size("matches") > 0)
    boost = F.when(F.exists("matches", lambda m: m["content"].rlike(DEFINITION_LINE)), 2).otherwise(1)
    return rows.withColumn("score", (F.size("matches") * boost).cast("double"))


def grep(chunks: DataFrame, query: str, limit: int | None = 25, case_sensitive: bool = False, whole_word: bool = False, language: str | None = None, path: str = "", compat: bool = False) -> DataFrame:
    """The best chunks, with scores from 0 to 1 of the best. Ties go by id. compat applies the path filter behind the limit. An empty query finds nothing."""
    if not query:
        return chunks.limit(0).withColumn("matches", F.array().cast("array<struct<line:int,content:string>>")).withColumn("score", F.lit(0.0))
    top = matched(chunks, query, case_sensitive, whole_word, language, path, compat).orderBy(F.desc("score"), "id").limit(clamp(limit))
    top = top.withColumn("score", F.col("score") / F.max("score").over(W.partitionBy()))
    return top.filter(path_matches(F.col("rel_path"), path)) if compat and path else top
