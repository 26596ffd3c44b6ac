"""Retrievers: queries (query_id, query) and chunks to hits (query_id, chunk_id, score, rank).

Ties are broken by chunk_id; scores are rounded to 9 digits before they are
ranked, so that the order does not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.chunking import hashed_bag

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query vectors of up to so many bytes are broadcast; more are cross-joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Scores that a task of dense() holds at once.
TILE = 2 << 20
#: Up to so many queries are matched in one scan, with so many chunks at once; more are joined with the postings.
MATRIX_QUERIES, MATRIX_CHUNKS = 2_000, 512
HITS = ["query_id", "chunk_id", "score", "rank"]


def top_k(scored: DataFrame, k: int, *tie: Column | str) -> DataFrame:
    """The k best of each query; planned as a partial and a final WindowGroupLimit."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(tie or ("chunk_id",)))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(HITS)


def tokens(chunks: DataFrame) -> DataFrame:
    """(chunk_id, w): the words of each chunk; the texts stay where they are read."""
    return chunks.select("chunk_id", T.lexical_tokens("text").alias("w"))


def postings(words: DataFrame) -> DataFrame:
    """(chunk_id, dl, term, tf) from tokens(); counted within each task before anything is exchanged."""
    return words.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def idf_table(words: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, idf): negative values become EPSILON times the mean over the whole vocabulary."""
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total.select("n")))
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def corpus_size(words: DataFrame) -> DataFrame:
    """One row: n chunks, avgdl."""
    return words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))


class LexicalIndex:
    """Words and statistics of a chunk set; persist() keeps them for several queries."""

    def __init__(self, chunks: DataFrame):
        self.words = tokens(chunks)
        self.kept: DataFrame | None = None
        self._derive()

    def _derive(self) -> None:
        self.total = corpus_size(self.words)
        self.idf = idf_table(self.words, self.total)

    def persist(self) -> LexicalIndex:
        # as one string, which takes a third of the room of an array; words have no blanks
        self.kept = self.words.select("chunk_id", F.array_join("w", " ").alias("s")).persist()
        none = F.array().cast("array<string>")
        self.words = self.kept.select("chunk_id", F.when(F.col("s") == "", none).otherwise(F.split("s", " ")).alias("w"))
        self._derive()
        self.total = self.total.persist()
        self.idf = self.idf.persist()
        return self

    def unpersist(self) -> None:
        for x in (self.kept, self.total, self.idf):
            if x is not None:
                x.unpersist()


def query_weights(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, w) of the known terms; repeated ones count each time."""
    terms = queries.select("query_id", F.explode(T.lexical_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return terms.join(index.idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w"))


def bm25_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs that share a term."""
    # the words are cut to the queries' terms before they are counted; Spark broadcasts the terms if they are few
    weighted = query_weights(index, queries)
    known = index.words.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(weighted.select("term").distinct(), "term", "left_semi")
    post = known.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    matched = post.join(weighted, "term").crossJoin(F.broadcast(index.total.select("avgdl")))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return matched.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))


def bm25(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """Top k; chunks that share no term score 0 and fill up where fewer than k match or outrank negative scores.

    Up to MATRIX_QUERIES queries go as a matrix of term weights to every task; more are
    joined with the postings.  Both give the same scores."""
    return (bm25_matrix if queries.count() <= MATRIX_QUERIES else bm25_join)(index, queries, k)


def bm25_join(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    scores = bm25_scores(index, queries)
    best = top_k(scores, k)
    have = best.where("score > 0").groupBy("query_id").agg(F.count("*").alias("have"))
    lacking = queries.join(have, "query_id", "left").where(F.coalesce("have", F.lit(0)) < k).drop("have")
    # of a query's unmatched chunks, the first k are among the k + m lowest of all, m being its matches
    matched = bm25_scores(index, lacking).select("query_id", "chunk_id").persist()
    many = lacking.select("query_id").distinct().join(matched.groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").fillna(0)
    most = many.agg(F.max("m")).first()[0] or 0
    low = index.words.select("chunk_id").orderBy("chunk_id").limit(k + most).withColumn("place", F.row_number().over(Window.orderBy("chunk_id")))
    zeros = many.select("query_id", F.explode(F.sequence(F.lit(1), (F.col("m") + k).cast("int"))).alias("place")).join(low, "place").join(matched, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.select("query_id", "chunk_id", "score").unionByName(top_k(zeros, k).select("query_id", "chunk_id", "score")), k)


def bm25_matrix(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """The terms of a batch of chunks, each added to the scores of the queries that have it; each task sends its own best k of a query."""
    kind = dict(queries.dtypes)["query_id"], dict(index.words.dtypes)["chunk_id"]
    schema = f"query_id {kind[0]}, chunk_id {kind[1]}, score double"
    rows = queries.select("query_id").distinct().toPandas()["query_id"].to_numpy()
    if not len(rows):
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    weights, average = query_weights(index, queries).toPandas(), index.total.first()["avgdl"] or 1.0
    order, every = {q: i for i, q in enumerate(rows)}, {t: i for i, t in enumerate(dict.fromkeys(weights["term"]))}
    column, at = weights["term"].map(every).to_numpy(np.int64), weights["query_id"].map(order).to_numpy(np.int64)
    by = np.argsort(column, kind="stable")
    # of each term the queries that have it, one after the other, and its weights in them
    uses = np.bincount(column, minlength=len(every))
    known = queries.sparkSession.sparkContext.broadcast((rows, list(every), at[by], weights["w"].to_numpy(np.float64)[by], uses))

    def local(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
        ids, terms, users, weight, uses = known.value
        found, begin, best = pa.array(terms, pa.string()), np.cumsum(uses) - uses, Best(len(ids), k)
        for big in batches:
            for b in (big.slice(i, MATRIX_CHUNKS) for i in range(0, big.num_rows, MATRIX_CHUNKS)):
                w = b["w"]
                place = pc.index_in(w.flatten(), found)
                size = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False)
                hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
                flat, tf = np.unique(np.repeat(np.arange(len(size)), size)[hit] * len(terms) + place.drop_null().to_numpy().astype(np.int64), return_counts=True)
                chunk, term = np.divmod(flat, max(1, len(terms)))
                tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[chunk] / average))
                # a term of a chunk counts for each query that has it
                n = uses[term]
                pair = np.repeat(begin[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                score = np.bincount(users[pair] * len(size) + np.repeat(chunk, n), np.repeat(tf, n) * weight[pair], len(ids) * len(size))
                best.merge(score.reshape(len(ids), len(size)), np.array(b["chunk_id"].to_pylist(), object))
        if best.score is not None:
            n = best.score.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best.names.ravel().tolist()), pa.array(best.score.ravel() + 0.0)], names=["query_id", "chunk_id", "score"])

    return top_k(index.words.select("chunk_id", "w").mapInArrow(local, schema), k)


class Best:
    """The k best vectors of each query so far, by score rounded to 9 digits, then name; kept with arrays of TILE scores at most."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.score: np.ndarray | None = None
        self.names: np.ndarray | None = None

    def add(self, matrix: np.ndarray, own: np.ndarray, names: np.ndarray) -> None:
        at = 0
        while at < len(own):
            # few at first, so that few of the others need more than a comparison
            n = max(8 * self.k, 512) if self.score is None else 4096
            score, best = [], []
            for a in range(0, self.queries, step := max(1, TILE // n)):
                rows = slice(a, min(self.queries, a + step))
                x, y = self._merged(rows, matrix[rows] @ own[at : at + n].T, names[at : at + n])
                score.append(x)
                best.append(y)
            self.score, self.names = np.concatenate(score), np.concatenate(best)
            at += n

    def merge(self, score: np.ndarray, names: np.ndarray) -> None:
        """Scores of all queries by the vectors named."""
        if len(names):
            self.score, self.names = self._merged(slice(0, self.queries), score, names)

    def _merged(self, rows: slice, score: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, own = 0 if self.score is None else self.score.shape[1], len(names)
        n, keep = len(score), min(self.k, held + own)
        if held == self.k:
            limit = self.score[rows].min(1)
        elif own > self.k:
            limit = np.partition(score, own - self.k, axis=1)[:, own - self.k]
        else:
            limit = np.full(n, -np.inf)
        # one that is rounded up to the limit is among these
        hit = np.flatnonzero(score >= (limit - 2e-9)[:, None])
        r, c = np.divmod(hit, own)
        value, name = np.round(score.ravel()[hit], 9), names[c]
        if held:
            some = np.unique(r) if held == self.k else np.arange(n)
            value, name = np.concatenate([self.score[rows][some].ravel(), value]), np.concatenate([self.names[rows][some].ravel(), name])
            r = np.concatenate([np.repeat(some, held), r])
        else:
            some = np.arange(n)
        order = np.lexsort((name, -value, r))
        first = np.searchsorted(r[order], some)
        order = order[(first[:, None] + np.arange(keep)).ravel()].reshape(-1, keep)
        if len(some) == n:
            return value[order], name[order]
        out = self.score[rows].copy(), self.names[rows].copy()
        out[0][some], out[1][some] = value[order], name[order]
        return out


def dense(chunks: DataFrame, queries: DataFrame, k: int, small: bool | None = None) -> DataFrame:
    """Exact inner product of chunks (chunk_id, vector) and queries (query_id, vector).

    Few queries go as one matrix to every task, which keeps its own best k of each
    query, so only k rows a query and task are shuffled.  Beyond BROADCAST_BYTES the
    queries are taken in slices of that size.  A task's scores are made in tiles."""
    width = 8
    first = queries.select(F.size("vector").alias("d")).first()
    if first is None:
        return queries.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double, rank int")
    per = max(1, first[0]) * width
    count = queries.count()
    slices = max(1, -(-count * per // BROADCAST_BYTES))
    kind = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    schema = f"query_id {kind[0]}, chunk_id {kind[1]}, score double"
    parts = []
    for s in range(slices):
        # by Arrow, as rows of lists would take the driver longer than the tasks take
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s).select("query_id", "vector").toArrow()
        if not len(rows):
            continue
        ids, matrix = rows["query_id"].to_numpy(), rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)
        known = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def local(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            ids, matrix = known.value
            best = Best(len(ids), k)
            for b in batches:
                if len(b):
                    best.add(matrix, np.stack(b["vector"].map(np.asarray)).astype(np.float64), b["chunk_id"].to_numpy())
            for a in range(0, len(ids), step := max(1, 200_000 // k)):
                if best.score is not None:
                    n = best.score.shape[1]
                    yield pd.DataFrame({"query_id": np.repeat(ids[a : a + step], n), "chunk_id": best.names[a : a + step].ravel(), "score": best.score[a : a + step].ravel()})

        parts.append(chunks.select("chunk_id", "vector").mapInPandas(local, schema))
    return top_k(reduce(DataFrame.unionByName, parts), k)


def encode(rows: DataFrame, column: str, encoder: Callable[[Column], Column] = hashed_bag) -> DataFrame:
    return rows.withColumn("vector", encoder(F.col(column)))


def fuse(lists: list[tuple[DataFrame, float]], rrf_k: float = 60.0) -> DataFrame:
    """Weighted reciprocal rank fusion; (query_id, chunk_id, score, list_no, list_rank), the last two where it was first seen."""
    rows = [hits.select("query_id", "chunk_id", "rank", F.lit(i).alias("list_no"), F.lit(float(w)).alias("w")) for i, (hits, w) in enumerate(lists)]
    every = reduce(DataFrame.unionByName, rows)
    fused = every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    return fused.select("query_id", "chunk_id", "score", F.col("first.list_no").alias("list_no"), F.col("first.rank").alias("list_rank"))


def weighted_rrf(lists: list[DataFrame], weights: list[float], rrf_k: float, k: int) -> DataFrame:
    if len(lists) != len(weights):
        raise ValueError("as many weights as lists are needed")
    return top_k(fuse(list(zip(lists, weights, strict=True)), rrf_k), k, "list_no", "list_rank")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Offline stand-in for a cross-encoder: share of distinct query words in the text, plus half the share of text words that are the query's."""
    q, t = F.array_distinct(T.lexical_tokens(query)), F.array_distinct(T.lexical_tokens(text))
    n = F.size(F.array_intersect(q, t))
    return F.round(n / F.greatest(F.size(q), F.lit(1)) + 0.5 * n / F.greatest(F.size(t), F.lit(1)), 9)


def rerank(base: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """New scores for the candidates replace the old ones; text is joined only for candidates."""
    pairs = base.select("query_id", "chunk_id").join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return top_k(pairs.select("query_id", "chunk_id", scorer(F.col("query"), F.col("text")).alias("score")), k)


def multi_query(hits: DataFrame, k: int, rrf_k: float = 60.0) -> DataFrame:
    """hits of several queries of each question (question_id, query_no, query, chunk_id, score, rank) to evidence.

    raw_score is the best score, 0 if all are negative; ties go to the chunk seen first."""
    grouped = hits.groupBy("question_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 12).alias("score"), F.greatest(F.lit(0.0), F.max("score")).alias("raw_score"),
        F.array_sort(F.collect_set("query")).alias("matched_queries"), F.min(F.struct("query_no", "rank")).alias("first"),
    )
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("raw_score"), "first")
    return grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


class Retrievers:
    """Makes retrievers by spec over one chunk set; the lexical index and the vectors are made once and shared."""

    def __init__(self, chunks: DataFrame, top: int = 4, encoder: Callable[[Column], Column] = hashed_bag, scorer: Callable[[Column, Column], Column] = lexical_overlap):
        self.chunks, self.top, self.encoder, self.scorer = chunks, top, encoder, scorer
        self._lexical: LexicalIndex | None = None
        self._vectors: DataFrame | None = None

    @property
    def lexical(self) -> LexicalIndex:
        if self._lexical is None:
            self._lexical = LexicalIndex(self.chunks).persist()
        return self._lexical

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            self._vectors = encode(self.chunks.select("chunk_id", "text"), "text", self.encoder).select("chunk_id", "vector").persist()
        return self._vectors

    def create(self, spec: dict) -> Callable[[DataFrame, int], DataFrame]:
        kind = spec.get("type", "dense")
        if kind == "dense":
            return lambda q, k: dense(self.vectors, encode(q, "query", self.encoder), k)
        if kind == "bm25":
            return lambda q, k: bm25(self.lexical, q, k)
        if kind == "hybrid":
            weights = [spec.get("dense_weight", 0.5), spec.get("sparse_weight", 0.5)]
            one, two, rrf_k = self.create({"type": "dense"}), self.create({"type": "bm25"}), spec.get("rrf_k", 60.0)

            def hybrid(q: DataFrame, k: int) -> DataFrame:
                pool = max(k, spec.get("candidate_pool_size", max(5 * self.top, 20)))
                return weighted_rrf([one(q, pool), two(q, pool)], weights, rrf_k, k)

            return hybrid
        if kind == "rerank":
            base = self.create(spec.get("base_retriever", {"type": "dense"}))

            def reranked(q: DataFrame, k: int) -> DataFrame:
                return rerank(base(q, max(k, spec.get("candidate_pool_size", max(5 * self.top, 20)))), q, self.chunks, k, self.scorer)

            return reranked
        raise ValueError(f"unknown retriever type: {kind}")

    def release(self) -> None:
        if self._lexical is not None:
            self._lexical.unpersist()
        if self._vectors is not None:
            self._vectors.unpersist()


def live_spec(name: str, top: int) -> dict:
    """Retriever specs of the live mode."""
    hybrid = {"type": "hybrid", "candidate_pool_size": max(4 * top, 12), "dense_weight": 0.55, "sparse_weight": 0.45, "rrf_k": 60.0}
    known = {"dense": {"type": "dense"}, "bm25": {"type": "bm25"}, "hybrid": hybrid, "hybrid_rerank": {"type": "rerank", "candidate_pool_size": max(4 * top, 12), "base_retriever": hybrid}}
    if name not in known:
        raise ValueError(f"unknown retriever: {name}")
    return {"name": name, **known[name]}
