"""Operator 10, line dedup by a deletion-neighbourhood join.

A line is compared as its sequence of words (lower case, white space collapsed).
Of all occurrences in the order (doc_id, row_key, line number), null ids first,
the earliest of a line stays, whatever its length and document.  The edit bound of
a line is one word in SHARE: a line of n words also goes if some line whose earliest
occurrence comes before its own is within min(1, n // SHARE) word edits (insertion,
deletion or substitution) of it.  So in a line of fewer than SHARE words no edit is
allowed; in one of a single word, one edit would make every word equal to every other.

Exact repeats are grouped by a 64-bit hash.  For near ones each line emits
hashed keys of its variants with one word deleted, with the place of the
deletion, and of itself with place -1.  Lines that share key and place differ by
a substitution there at most; a line whose own key equals another's variant is
that line less a word.  So within a key it is enough to compare each line with
the earliest of its place and with the undeleted one, and the join is linear in
the keys even where thousands of lines share one.  The word edit distance of
each such pair is then verified on the words.

Before that, lines that have no partner are sorted out: two lines within one
edit, of which the shorter has m words, agree in their first m // 2 words or in
their last m // 2.  So each line of n words emits these two halves for m = n and
m = n - 1, and only lines that share one with another line are given variants.
Nothing is lost by it, and only those lines' texts are shuffled.

Defined cases: null text stays null and has no lines; blank lines stay; a very
long line is compared whole, as any other; rows of the same doc_id and text are one
document, all of its rows change alike; lines that tie are those of one document
row, so none is favoured; an empty table gives no rows; other columns are passed
through by apply().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, runs, wordgrid

SHARE = 5
#: Up to so many rows of line hashes are broadcast, beyond that they are joined by shuffle.
BROADCAST_ROWS = 2_000_000
_ORDER = ["doc_id", "row_key", "line_no"]
_BLANKS = r"[\x00-\x20]+"


def _lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row, number and text of each line of the batch that is not blank."""
    row, number, text = [], [], []
    for r, t in enumerate(batch["text"].to_pylist()):
        if t:
            for n, line in enumerate(t.split("\n")):
                if line and not line.isspace():
                    row.append(r)
                    number.append(n)
                    text.append(line)
    return np.array(row, np.int64), np.array(number, np.int32), text


def _hash(w: wordgrid.Words) -> np.ndarray:
    """Hash of all words of each text."""
    return wordgrid.mix(wordgrid.segments(w.hash, w.begin, w.begin + w.count) + w.count.astype(np.uint64))


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _occurrence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, number, text = _lines(b)
        keys = b["row_key"].to_numpy()
        for w in wordgrid.words(text):
            at = slice(w.first, w.first + len(w.count))
            some = w.count > 0
            r = row[at][some]
            yield pa.RecordBatch.from_arrays([_as_long(_hash(w)[some]), b["doc_id"].take(pa.array(r)), pa.array(keys[r]), pa.array(number[at][some])], names=["line", *_ORDER])


def _half_batches(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in wordgrid.words(_lines(b)[2]):
            long = np.flatnonzero(w.count >= near - 1)
            a, n, h = w.begin[long], w.count[long], _hash(w)[long]
            keys = []
            for m in (n, n - 1):
                half, tag = m // 2, m.astype(np.uint64)
                keys.append(wordgrid.mix(wordgrid.segments(w.hash, a, a + half) ^ tag))
                keys.append(wordgrid.mix(wordgrid.segments(w.hash, a + n - half, a + n) ^ ~tag))
            yield pa.RecordBatch.from_arrays([_as_long(np.concatenate(keys)), _as_long(np.tile(h, 4))], names=["key", "line"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs.whole(batches):
        key, line = t["key"].to_numpy(), t["line"].to_numpy()
        _, run = np.unique(key, return_inverse=True)
        low, high = (np.full(run[-1] + 1, x, np.int64) for x in (2**63 - 1, -(2**63)))
        np.minimum.at(low, run, line)
        np.maximum.at(high, run, line)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(line[(low < high)[run]]))], names=["line"])


def _text_batches(batches: Iterator[pa.RecordBatch], near: int, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The words of the lines; wanted: only of those with these hashes, sorted."""
    for b in batches:
        text = _lines(b)[2]
        for w in wordgrid.words(text):
            some = np.flatnonzero(w.count >= near - 1)
            if wanted is not None:
                h = _hash(w)[some].view(np.int64)
                at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                some = some[wanted[at] == h] if len(wanted) else some[:0]
            yield pa.RecordBatch.from_arrays([_as_long(_hash(w)[some]), pa.array([w.text(w.begin[i], w.begin[i] + w.count[i]).decode("utf-8", "replace") for i in some], pa.string())], names=["line", "words"])


def _variant_batches(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in wordgrid.words(b["words"].to_pylist()):
            n, end = w.count, np.repeat(w.begin + w.count, w.count)
            at, begin = np.arange(len(w.hash)), np.repeat(w.begin, w.count)
            head = wordgrid.segments(w.hash, begin, at)
            tail = wordgrid.segments(w.hash, at + 1, end)
            less = wordgrid.mix(head + tail * wordgrid.power(at - begin) + (np.repeat(n, n) - 1).astype(np.uint64))
            doc = w.doc
            many = np.repeat(n >= near, n)
            rows = np.concatenate([doc[many], np.arange(len(n))]) + w.first
            key = np.concatenate([less[many], _hash(w)])
            place = np.concatenate([(at - begin)[many], np.full(len(n), -1)]).astype(np.int32)
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays([_as_long(key), pa.array(place), b["line"].take(taken), *(b[c].take(taken) for c in _ORDER)], names=["key", "place", "line", *_ORDER])


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, earlier): the batches come sorted by key, place and order."""
    for t in runs.whole(batches):
        key, place, line = (t[c].to_numpy() for c in ("key", "place", "line"))
        order = list(zip(*(t[c].to_pylist() for c in _ORDER), strict=True))
        new_key = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new_key | np.append(True, place[1:] != place[:-1]))
        first = np.repeat(start, np.diff(np.append(start, len(key))))
        late = np.flatnonzero((np.arange(len(key)) != first) & (line != line[first]) & (place >= 0))
        a, z = list(line[late]), list(line[first[late]])
        run = np.flatnonzero(new_key)
        self_line = np.repeat(np.where(place[run] < 0, run, -1), np.diff(np.append(run, len(key))))
        for i in np.flatnonzero((self_line >= 0) & (place >= 0)):
            s = self_line[i]
            x, y = (tuple((v is not None, v or 0) for v in order[j]) for j in (i, s))
            a.append(line[i] if y < x else line[s])
            z.append(line[s] if y < x else line[i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["line", "earlier"])


def within_one(a: list[str], b: list[str]) -> bool:
    """Word edit distance of at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    p, least = 0, min(len(a), len(b))
    while p < least and a[p] == b[p]:
        p += 1
    s = 0
    while s < least - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return max(len(a), len(b)) - p - s <= 1


def _verified_batches(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [x.count(" ") + 1 >= near and within_one(x.split(" "), y.split(" ")) for x, y in zip(b["words"].to_pylist(), b["earlier_words"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["line"].filter(pa.array(ok, pa.bool_()))], names=["line"])


def removals(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, row_key, line_no of each occurrence that goes, and near: whether for an edit rather than a repeat."""
    parts = common.workers(docs)
    base = docs.select(F.col("doc_id").cast("long"), common.row_key().alias("row_key"), F.col("text"))
    text = base.select("text")
    occurrences = common.cut(base.mapInArrow(_occurrence_batches, "line long, doc_id long, row_key long, line_no int"))
    shared = text.mapInArrow(lambda batches: _half_batches(batches, share), "key long, line long").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared_batches, "line long").distinct()
    shared = common.cut(shared)
    if shared.count() <= BROADCAST_ROWS:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(shared.toPandas()["line"].to_numpy(np.int64)))
        texts = text.mapInArrow(lambda batches: _text_batches(batches, share, wanted.value), "line long, words string")
    else:
        texts = text.mapInArrow(lambda batches: _text_batches(batches, share), "line long, words string").join(shared, "line", "left_semi")
    texts = texts.groupBy("line").agg(F.first("words").alias("words"))
    firsts = occurrences.groupBy("line").agg(F.min(F.struct(*_ORDER)).alias("first"), F.count("*").alias("n"))
    texts = common.cut(texts.join(firsts, "line").select("line", "words", *(F.col(f"first.{c}").alias(c) for c in _ORDER)))
    variants = texts.mapInArrow(lambda batches: _variant_batches(batches, share), "key long, place int, line long, doc_id long, row_key long, line_no int")
    candidates = variants.repartition(parts, "key").sortWithinPartitions("key", "place", *_ORDER).mapInArrow(_candidate_batches, "line long, earlier long").distinct()
    words = texts.select("line", "words")
    pairs = candidates.join(words, "line").join(words.select(F.col("line").alias("earlier"), F.col("words").alias("earlier_words")), "earlier")
    near = pairs.select("line", "words", "earlier_words").mapInArrow(lambda batches: _verified_batches(batches, share), "line long").distinct().withColumn("near", F.lit(True))
    gone = firsts.join(near, "line", "left").where("n > 1 OR near")
    found = occurrences.join(gone, "line")
    return found.where(F.col("near") | ~F.struct(*_ORDER).eqNullSafe(F.col("first"))).select(*_ORDER, F.coalesce("near", F.lit(False)).alias("near")).distinct()


def apply(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """docs with text less the lines that go, and __gone, their number."""
    gone = removals(docs, share).groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(F.collect_set("line_no").alias("__lines"))
    joined = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__key"]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__lines", i)), "\n")
    return joined.select(*(F.when(F.col("__lines").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns), F.coalesce(F.size("__lines"), F.lit(0)).alias("__gone"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines, n_chars brought up to date; those left with no text but blanks go."""
    out = apply(docs)
    out = out.where((F.col("__gone") == 0) | F.col("text").rlike(r"[^\x00-\x20]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__gone")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents")).select("doc_id", F.col("__gone").cast("long").alias("removed"), "text")


ORACLE = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
     raw AS (SELECT doc_id, text, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM parts),
     occ AS (SELECT doc_id, text, line_no, trim(regexp_replace(lower(line), '[\x00-\x20]+', ' ', 'g')) AS words FROM raw),
     o AS (SELECT *, string_split(words, ' ') AS w FROM occ WHERE words <> ''),
     f AS (SELECT words, any_value(w) AS w, min({d: doc_id, n: line_no}) AS first FROM o GROUP BY words),
     v AS (SELECT words, first, len(w) AS n, unnest(range(0, len(w))) AS i, w FROM f WHERE len(w) >= 5),
     del AS (SELECT words, first, i, array_to_string(w[1:i] || w[i + 2:], ' ') AS k FROM v),
     sub AS (SELECT k, i, min(first) AS earliest FROM del GROUP BY k, i),
     near AS (SELECT words FROM del JOIN sub USING (k, i) WHERE first > earliest
        UNION SELECT del.words FROM del JOIN f ON f.words = del.k WHERE f.first < del.first
        UNION SELECT f.words FROM del JOIN f ON f.words = del.k WHERE del.first < f.first AND len(f.w) >= 5),
     gone AS (SELECT o.doc_id, o.line_no FROM o JOIN f ON o.words = f.words
        LEFT JOIN near ON near.words = o.words
        WHERE near.words IS NOT NULL OR {d: o.doc_id, n: o.line_no} <> f.first)
SELECT raw.doc_id, count(gone.line_no) AS removed, coalesce(string_agg(raw.line, chr(10) ORDER BY raw.line_no) FILTER (WHERE gone.line_no IS NULL), '') AS text
FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.line_no = gone.line_no GROUP BY raw.doc_id
"""
