"""Operator 7, benchmark decontamination by MinHash containment search.

Items and documents are sets of hashed SHINGLE-word shingles (lower case, ASCII
punctuation as blanks).  Wanted are all pairs in which a document holds at least
THRESHOLD of an item's shingles, wherever in the document they are.

Items are partitioned by size: a partition holds sizes of (u/2, u].  An item's
sketch is made of its least shingles under a hash, as in bottom-k MinHash.  Of n
shingles a document that qualifies lacks at most g = n - ceil(THRESHOLD * n), so of a
sketch of g + s it holds at least s: no pair is missed, at whatever length of the document
and however scattered the item.  s grows with the size, so that longer items need more
agreement before they are compared.  The sketches of a partition are one sorted table,
which the shingles of a document that are items' at all are looked up in; a document
with fewer of these than the partition's smallest item needs is passed over.  The
candidates are verified by exact containment in the whole document.

An item of fewer than SHINGLE words has one shingle, all of its words, and is held by a
document in which they follow each other.

The items are broadcast in slices of at most SLICE_ITEMS, each with its own
scan of the documents, so that a large benchmark needs no more memory.

Defined cases: items without a word are never found, nor anything in null or empty
texts; very long texts are taken whole; a containment that ties with THRESHOLD counts;
equal (item_id, text) rows of the benchmark count once, and equal ids with other text
separately; repeated documents give repeated rows; empty tables give no rows; other
columns are not looked at.  keep() drops documents only for items of SHINGLE words or
more: a test answer of a word or two is in clean documents everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordgrid

SHINGLE = 3
THRESHOLD = 0.7
SLICE_ITEMS = 50_000
#: Part of an item's needed shingles that its sketch has to show.
SHOWN = 4
_BITS = 22
_SEED = np.random.default_rng(7).integers(1, 2**63, dtype=np.uint64)
_OUT = "item_id long, doc_id long, row_key long, shared long, shingles long, containment double, words long"


def _grams(w: wordgrid.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, told apart by k, and texts of all k-word shingles."""
    g, at = w.grams(k)
    return wordgrid.mix(g + np.uint64(k)), w.doc[at]


class Index:
    """Items of one slice, by size partition."""

    def __init__(self, ids: list, texts: list[str | None], k: int = SHINGLE, threshold: float = THRESHOLD):
        self.k, self.threshold, self.ids = k, threshold, ids
        self.sets: list[np.ndarray] = []
        self.words: list[int] = []
        for w in wordgrid.words(texts, plain=True):
            some = {n: _grams(w, n) for n in sorted({min(k, int(c)) for c in w.count if c})}
            edge = {n: np.searchsorted(d, np.arange(len(w.count) + 1)) for n, (_, d) in some.items()}
            self.words += w.count.tolist()
            for i, c in enumerate(w.count.tolist()):
                n = min(k, c)
                self.sets.append(np.unique(some[n][0][edge[n][i] : edge[n][i + 1]]) if c else np.empty(0, np.uint64))
        self.widths = sorted({min(k, c) for c in self.words if c})
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.vocabulary >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        sizes = np.array([len(s) for s in self.sets])
        need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
        self.shown = np.maximum(1, need // SHOWN)
        self.parts = []
        for c in sorted({int(n - 1).bit_length() for n in sizes if n}):
            own = [i for i, n in enumerate(sizes) if n and int(n - 1).bit_length() == c]
            sketch = [s[np.argsort(wordgrid.mix(s ^ _SEED), kind="stable")[: sizes[i] - need[i] + self.shown[i]]] for i in own for s in (self.sets[i],)]
            place = np.searchsorted(self.vocabulary, np.concatenate(sketch))
            item = np.repeat(own, [len(x) for x in sketch])
            order = np.argsort(place, kind="stable")
            self.parts.append((int(need[own].min()), place[order], item[order]))

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """Document number, item number, shared shingles, shingles of the item."""
        if not len(self.vocabulary):
            return
        size = len(self.vocabulary)
        for w in wordgrid.words(texts, plain=True):
            keys = []
            for n in self.widths:
                g, doc = _grams(w, n)
                hit = np.flatnonzero(self.bitmap[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
                x = np.minimum(np.searchsorted(self.vocabulary, g[hit]), size - 1)
                same = self.vocabulary[x] == g[hit]
                keys.append(doc[hit[same]] * size + x[same])
            held = np.unique(np.concatenate(keys))
            if not len(held):
                continue
            doc, x = held // size, held % size
            count = np.bincount(doc)
            edge = np.concatenate([[0], np.cumsum(count)])
            for least, place, item in self.parts:
                some = count[doc] >= least
                d, v = doc[some], x[some]
                a, z = np.searchsorted(place, v, "left"), np.searchsorted(place, v, "right")
                n = z - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                pair, agree = np.unique(np.repeat(d, n) * len(self.ids) + item[at], return_counts=True)
                pair = pair[agree >= self.shown[pair % len(self.ids)]]
                for p in pair.tolist():
                    r, i = divmod(p, len(self.ids))
                    own = self.sets[i]
                    shared = int(np.isin(own, self.vocabulary[x[edge[r] : edge[r + 1]]], assume_unique=True).sum())
                    if shared >= self.threshold * len(own) - 1e-9:
                        yield w.first + r, i, shared, len(own)


def search(docs: DataFrame, benchmark: DataFrame, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """item_id, doc_id, row_key, shared, shingles, containment of each pair at or above THRESHOLD, and words of the item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").distinct()
    slices = max(1, -(-items.count() // slice_items))
    out = None
    for s in range(slices):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == s).toPandas()
        index = spark.sparkContext.broadcast(Index(part["item_id"].astype(object).where(part["item_id"].notna(), None).tolist(), part["text"].tolist()))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                ids, keys = b["doc_id"].to_pylist(), b["row_key"].to_pylist()
                rows = [(None if x.ids[i] is None else int(x.ids[i]), ids[d], keys[d], n, m, n / m, x.words[i]) for d, i, n, m in x.found(b["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.float64() if c == 5 else pa.int64()) for c in range(7)], names=[c.split()[0] for c in _OUT.split(", ")])

        one = docs.select(F.col("doc_id").cast("long"), common.row_key().alias("row_key"), F.col("text")).mapInArrow(scan, _OUT)
        out = one if out is None else out.unionByName(one)
    return out


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of SHINGLE words or more, with all their columns."""
    return common.without(docs, search(docs, benchmark).where(F.col("words") >= SHINGLE).select("doc_id", "row_key").distinct())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "doc_id", "shared", "shingles", F.round("containment", 6).alias("containment"))


_WORDS = r"string_split(trim(regexp_replace(lower(text), '[\x00-\x20!-/:-@\[-`{-~]+', ' ', 'g')), ' ')"
_GRAMS = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
ORACLE = f"""
WITH i AS (SELECT item_id, text, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
     d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     ig AS (SELECT item_id, text, 3 AS k, len({_GRAMS}) AS shingles, unnest({_GRAMS}) AS s FROM i WHERE len(w) >= 3
        UNION ALL SELECT item_id, text, len(w) AS k, 1, array_to_string(w, ' ') FROM i WHERE len(w) < 3 AND w[1] <> ''),
     dg AS (SELECT doc_id, 3 AS k, unnest({_GRAMS}) AS s FROM d WHERE len(w) >= 3
        UNION ALL SELECT doc_id, 1, unnest(list_distinct(w)) FROM d WHERE 1 IN (SELECT k FROM ig)
        UNION ALL SELECT doc_id, 2, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM d WHERE len(w) >= 2 AND 2 IN (SELECT k FROM ig))
SELECT item_id, doc_id, count(*) AS shared, any_value(shingles) AS shingles, round(count(*) / any_value(shingles), 6) AS containment
FROM ig JOIN dg USING (k, s) GROUP BY item_id, text, doc_id HAVING count(*) >= 0.7 * any_value(shingles) - 1e-9
"""
