"""Nearest vectors, BM25, and their fusion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.arrow import mapped, slices
from lexiloom.functions import text as words
from lexiloom.functions.text import Phrase

RRF_K = 60
# Fixed values of the ranking formula.
K1, B = 1.2, 0.75


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def literal_vector(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def knn(vectors: DataFrame, query: list[float], k: int = 25, metric=l2, repeated: bool = False) -> DataFrame:
    """chunk_id, distance, score (1 - distance) of the k nearest; distances count to six places, ties go by id.
    One scan and a top-k, nothing is shuffled but each task's k rows; what is not the query's size is left out. repeated: ids may occur more than once, and an id's nearest row counts."""
    near = vectors.filter(F.size("vector") == len(query)).select("chunk_id", F.round(metric(F.col("vector"), literal_vector(query)), 6).alias("distance"))
    near = near.groupBy("chunk_id").agg(F.min("distance").alias("distance")) if repeated else near
    near = near.orderBy("distance", "chunk_id").limit(k)
    return near.withColumn("score", 1 - F.col("distance"))


#: Rows and queries of a cell of knn_many at most, about; a cell is what a worker holds.
CELL_ROWS, CELL_QUERIES = 16384, 4096
#: Distances that a worker has at a time.
_TILE = 1 << 20


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, rows: int = CELL_ROWS, block: int = CELL_QUERIES) -> DataFrame:
    """query_id, chunk_id, distance, rank for each of a stated set of queries (query_id, query): all rows against all queries, in cells of about so many rows and queries each, dealt by hash.
    Each cell is a group of its own, whatever the sizes; products of matrices leave the rows that may be among the k nearest, whose distances are then taken as l2 takes them. Rows of another size than the query's, or with nulls, are left out."""
    full = lambda c: ~F.exists(c, lambda x: x.isNull())
    vectors, queries = vectors.filter(full("vector")), queries.filter(full("query"))
    # a vector of each size has cells of its own, so that none is compared with another size
    across, down = max(1, -(-vectors.count() // rows)), max(1, -(-queries.count() // block))
    left = vectors.select(F.size("vector").alias("_size"), F.pmod(F.xxhash64("chunk_id"), F.lit(across)).alias("_row"), F.explode(F.expr(f"sequence(0L, {down - 1}L)")).alias("_query"), "chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    right = queries.select(F.size("query").alias("_size"), F.explode(F.expr(f"sequence(0L, {across - 1}L)")).alias("_row"), F.pmod(F.xxhash64("query_id"), F.lit(down)).alias("_query"), "query_id", F.col("query").cast("array<double>").alias("query"))
    schema = T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("distance", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = left["chunk_id"].combine_chunks(), right["query_id"].combine_chunks()
        found = _near(_matrix(left["vector"]), ids, _matrix(right["query"]), k) if len(ids) and len(asked) else ([], [], [])
        q, c, distance = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        return pa.table({"query_id": asked.take(pa.array(q)), "chunk_id": ids.take(pa.array(c)), "distance": pa.array(distance, pa.float64())})

    key = ("_size", "_row", "_query")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema).withColumn("distance", F.round("distance", 6))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _near(x: np.ndarray, ids: pa.Array, y: np.ndarray, k: int) -> tuple[list, list, list]:
    """Places in y, places in x and distances: for each row of y all that may be among its k nearest of x by distance to six places and id. Of rows at one distance, the k first by id are enough."""
    order = pc.sort_indices(ids).to_numpy()
    x, out = x[order], ([], [], [])  # from here the place is the order of ids
    xx, k = (x * x).sum(1), min(k, len(x))
    step = max(1, _TILE // len(x))
    for a in range(0, len(y), step):
        some = y[a : a + step]
        yy = (some * some).sum(1)
        far = np.sqrt(np.maximum(xx + yy[:, None] - 2 * (some @ x.T), 0))
        # what products of matrices may be wrong by: a share of the squares, of which the root is taken
        slack = 2e-6 + 2 * np.sqrt(1e-14 * x.shape[1] * (xx.max() + yy))
        q, c = np.nonzero(~(far > (np.partition(far, k - 1, axis=1)[:, k - 1] + slack)[:, None]))
        for b in range(0, len(q), _TILE // 16):
            qs, cs = q[b : b + _TILE // 16], c[b : b + _TILE // 16]
            total = np.zeros(len(qs))
            for j in range(x.shape[1]):  # in the order in which l2 adds
                d = x[cs, j] - some[qs, j]
                total += d * d
            distance = np.sqrt(total)
            by = np.lexsort((cs, distance, qs))
            qs, cs, distance = qs[by], cs[by], distance[by]
            first = np.r_[True, (qs[1:] != qs[:-1]) | (distance[1:] != distance[:-1])]
            at = np.arange(len(qs))
            kept = at - np.maximum.accumulate(np.where(first, at, 0)) < k
            out[0].append(qs[kept] + a), out[1].append(order[cs[kept]]), out[2].append(distance[kept])
    return out


# -- full text -------------------------------------------------------------------------


def postings(chunks: DataFrame, stemmed: bool = False) -> DataFrame:
    """term, id, tf, positions: the inverted index of chunks, each with an id of its own. A chunk's postings are made where it lies, nothing is shuffled; stems are made once for each distinct word of some texts."""
    rows = chunks.select("id", words.spaced(F.col("content")).alias("_spaced"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield _posted(part.column(0), part.column(1), stemmed)

    kinds = (("term", T.StringType()), ("id", chunks.schema["id"].dataType), ("tf", T.LongType()), ("positions", T.ArrayType(T.IntegerType())))
    return mapped(rows, run, T.StructType([T.StructField(*k) for k in kinds]))


def _posted(ids: pa.Array, spaced: pa.Array, stemmed: bool) -> pa.RecordBatch:
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), "  ")
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    coded = lists.flatten().dictionary_encode()
    code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if stemmed:
        coded = pa.array(map(words.stem_of, terms.to_pylist()), pa.string()).dictionary_encode()
        code, terms = coded.indices.to_numpy().astype(np.int64)[code], coded.dictionary
    blank = pc.index(terms, pa.scalar("", terms.type)).as_py()  # of texts without words
    if blank >= 0:
        owner, pos, code = (x[code != blank] for x in (owner, pos, code))
    key = owner * max(1, len(terms)) + code
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
    ends, met = np.r_[starts, len(key)], order[starts]
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order], pa.int32()))
    return pa.record_batch([terms.take(pa.array(code[met])), ids.take(pa.array(owner[met])), pa.array(np.diff(ends), pa.int64()), positions], names=["term", "id", "tf", "positions"])


def document_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", words.word_count(F.col("content")).alias("dl"))


def occurrences(spaced: Column, phrase: Phrase) -> Column:
    """How often a phrase occurs in words that stand between spaces of their own (see text.spaced); plain string functions, linear in the text."""
    last = phrase.words[-1] + ("" if phrase.prefix else " ")
    if len(phrase.words) == 1:
        return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" " + last)))) / (len(last) + 1)).cast("int")
    # what follows the first word is only looked at, so occurrences may overlap
    return F.regexp_count(spaced, F.lit("(?<= )" + phrase.words[0] + "(?=  " + "  ".join((*phrase.words[1:-1], last)) + ")"))


def _holds(tree, of: dict[Phrase, str]) -> Column:
    if isinstance(tree, Phrase):
        return F.col(of[tree]) > 0
    kind, a, b = tree[0], _holds(tree[1], of), _holds(tree[2], of)
    return a & b if kind == "and" else a | b if kind == "or" else a & ~b


def _all(tree) -> list[Phrase]:
    return [] if tree is None else [tree] if isinstance(tree, Phrase) else _all(tree[1]) + _all(tree[2])


def _scored(counted: DataFrame, tree, of: dict[Phrase, str], limit: int | None) -> DataFrame:
    """From id, dl, the phrases' counts, N, total and each n_ (in how many chunks a phrase occurs)."""
    score = F.lit(0.0)
    for p in words.phrases(tree):
        f, n = F.col(of[p]), F.col(f"n_{of[p]}")
        idf = F.log((F.col("N") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") * F.col("N") / F.col("total")))
    hits = counted.filter(_holds(tree, of)).select("id", score.alias("score"))
    return hits if limit is None else hits.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def _counted(rows: DataFrame, of: dict[Phrase, str]) -> DataFrame:
    """Adds how often each phrase occurs in the column _spaced, which goes. All are made once a row: a filter of them is not pushed below the generator, where it would make the words anew for each of its terms."""
    made = F.struct(*[occurrences(F.col("_spaced"), p).alias(c) for p, c in of.items()])
    return rows.select(*[c for c in rows.columns if c != "_spaced"], F.explode(F.array(made)).alias("_made")).select("*", "_made.*").drop("_made")


def bm25(chunks: DataFrame, expression: str, limit: int | None = None, stemmed: bool = False) -> DataFrame:
    """id and score of the chunks that an expression matches, the best first. Two scans: one sums what the formula needs of the
    whole corpus to a single row, one scores; no chunk is shuffled. Where an index of postings is kept, bm25_indexed reads only the terms that are asked for. stemmed replaces the words that may match by their stems on the way."""
    tree = words.parse(expression, stemmed)
    if tree is None:
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    of = {p: f"f{i}" for i, p in enumerate(dict.fromkeys(_all(tree)))}
    rows = chunks.select("id", words.word_count(F.col("content")).alias("dl"), words.spaced(F.col("content")).alias("_spaced"))
    if stemmed:
        rows = words.stemmed(rows, "_spaced", {w[0] for p in of for w in p.words}, any(len(p.words) > 1 for p in of))
    counted = _counted(rows, of)
    whole = counted.agg(F.count("*").alias("N"), F.sum("dl").alias("total"), *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in of.values()])
    return _scored(counted.filter(_holds(tree, of)).crossJoin(F.broadcast(whole)), tree, of, limit)  # one row


def matching(chunks: DataFrame, expression: str) -> DataFrame:
    """The chunks that an expression matches, in one scan and without scores."""
    tree = words.parse(expression)
    if tree is None:
        return chunks.limit(0)
    of = {p: f"_f{i}" for i, p in enumerate(dict.fromkeys(_all(tree)))}
    rows = chunks.withColumn("_spaced", words.spaced(F.col("content")))
    return _counted(rows, of).filter(_holds(tree, of)).drop(*of.values())


def bm25_indexed(index: DataFrame, lengths: DataFrame, expression: str, limit: int | None = None, stemmed: bool = False) -> DataFrame:
    """The same from stored postings (term, id, tf, positions) and lengths (id, dl): no text is read, and of postings that are sorted by
    term only those that are asked for. A phrase is found where the positions of its words, each less its place, agree."""
    tree = words.parse(expression, stemmed)
    if tree is None:
        return lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    of, tags = {p: f"f{i}" for i, p in enumerate(dict.fromkeys(_all(tree)))}, []
    for k, p in enumerate(of):
        for place, w in enumerate(p.words):
            own = F.col("term").startswith(w) if p.prefix and place == len(p.words) - 1 else F.col("term") == w
            tags.append((own, F.struct(F.lit(k).alias("k"), F.lit(place).alias("place"), F.lit(len(p.words)).alias("words"))))
    # one read of the index, in which a term may stand for words of several phrases
    own = index.filter(reduce(lambda a, b: a | b, [c for c, _ in tags]))
    met = own.withColumn("tag", F.explode(F.array_compact(F.array(*[F.when(c, t) for c, t in tags])))).select("id", "positions", F.col("tf").alias("f"), "tag.*")
    if any(len(p.words) > 1 for p in of):
        at = F.when(F.col("words") > 1, F.transform("positions", lambda x: (x - F.col("place")).cast("int"))).otherwise(F.array(F.lit(None).cast("int")))
        met = met.select("id", "k", "place", "words", "f", F.explode(at).alias("pos")).groupBy("id", "k", "words", "pos").agg(F.count_distinct("place").alias("n"), F.sum("f").alias("f"))
        met = met.filter(F.col("n") == F.col("words")).withColumn("f", F.when(F.col("words") > 1, 1).otherwise(F.col("f")))
    counted = met.groupBy("id").agg(*[F.sum(F.when(F.col("k") == k, F.col("f")).otherwise(0)).alias(c) for k, c in enumerate(of.values())])
    found = counted.agg(*[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in of.values()])
    whole = lengths.agg(F.count("*").alias("N"), F.sum("dl").alias("total")).crossJoin(found)
    return _scored(counted.filter(_holds(tree, of)).join(lengths.select("id", "dl"), "id").crossJoin(F.broadcast(whole)), tree, of, limit)  # one row


def ranks(scored: DataFrame, name: str) -> DataFrame:
    """1, 2, ... by falling score, ties by id; meant for what a top-k left."""
    return scored.select("id", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "id")).alias(name))


def fuse(vector: DataFrame, text: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two short lists (id, score)."""
    both = ranks(vector, "vector_rank").join(ranks(text, "text_rank"), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = both.withColumn("score", part("vector_rank") + part("text_rank"))
    return fused.orderBy(F.desc(F.round("score", 12)), "id").limit(limit)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int = 25, path: str = "", compat: bool = False, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Both searches at twice the limit, fused; then the rows of the winners. Text that is no expression has no BM25 half. index: stored postings and lengths, which save reading the texts."""
    from lexiloom.functions.patterns import path_matches

    if path and not compat:
        chunks = chunks.filter(path_matches(F.col("rel_path"), path))
        vectors = vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        index = tuple(x.join(chunks.select("id"), "id", "left_semi") for x in index) if index else None
    near = knn(vectors, query_vector, 2 * limit).select(F.col("chunk_id").alias("id"), "score")
    ask = (lambda q: bm25_indexed(*index, q, 2 * limit)) if index else (lambda q: bm25(chunks, q, 2 * limit))
    try:
        text = ask(words.sanitize(query))
    except words.QuerySyntaxError:
        text = ask("")
    top = fuse(near, text, limit)
    out = chunks.join(F.broadcast(top), "id").orderBy(F.desc("score"), "id")  # at most limit rows
    return out.filter(path_matches(F.col("rel_path"), path)) if compat and path else out
