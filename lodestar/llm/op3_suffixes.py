"""Operator 3, suffix-array dedup of passages of LENGTH words.

A window of LENGTH words (lower case, white space collapsed) is repeated if it
occurs at another place, in the same document or another.  Reported are the
maximal runs of repeated windows of each document: as "first" where the window's
occurrence is the earliest by (doc_id, row_key, word), null ids first, and as
"repeat" elsewhere.

The suffix array is sparse.  Each window has an anchor, the KEY-word gram in it
of the least hash; equal windows have equal anchors.  Anchors whose gram occurs
once are dropped after one exchange of hashes.  For each other, the suffix from
the anchor on, as long as its windows reach, is an entry, with the words before
the anchor that its windows begin with.  Every task sorts its entries into runs
and front-codes them (length of the prefix shared with the entry before, and the
rest); the runs are cut at splitters sampled from all anchors and exchanged by
range.  Each range merges its runs with a loser tree that keeps, for each loser,
the length of the prefix shared with the winner: a longer one decides without a
look at the text, an equal one is compared from there on, and a run's next entry
comes with its own, so no known prefix is compared again.

In the merged order, entries that share their first KEY words are adjacent; the
windows within such a group are compared in full, word for word.

Defined cases: null and empty texts and those under LENGTH words have no
windows; rows of the same doc_id and text are one document; occurrences that
overlap count, as with a line repeated many times over; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, runs, wordgrid

LENGTH = 50
KEY = 25
WIDTH = LENGTH - KEY + 1
#: Entries in a sorted run.
RUN = 50_000
#: Bytes of a splitter; less than KEY words have, so that no group is divided.
SPLIT = 40
#: Anchors sampled for each splitter, and at least in all.
SAMPLES, LEAST_SAMPLES = 20, 20_000
#: Ranges for each partition of the merge, so that hashing them to partitions evens out; entries of a range at most, but for those of one prefix.
RANGES, RANGE = 4, 1_000_000
_SAMPLED = 64


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of x[i : i + width] for each i with a whole window."""
    f = np.minimum if least else np.maximum
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(x.dtype).max if least else 0, x.dtype)
    full[:n] = x
    full = full.reshape(blocks, width)
    head = f.accumulate(full, axis=1).ravel()
    tail = np.ascontiguousarray(f.accumulate(full[:, ::-1], axis=1)[:, ::-1]).ravel()
    return f(tail[: n - width + 1], head[width - 1 : n])


def anchors(w: wordgrid.Words) -> tuple[np.ndarray, ...]:
    """Document, word, hash, and the least and greatest number of words by which its windows begin before it, of each anchor."""
    g, at = w.grams(KEY)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if len(g) < WIDTH:
        return none
    doc = w.doc[at]
    low = _slide(g, WIDTH, True)
    low[doc[: len(low)] != doc[WIDTH - 1 :]] = 0
    pad = np.zeros(WIDTH - 1, np.uint64)
    p = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), WIDTH, False) == g)
    if not len(p):
        return none
    most, alive = np.zeros(len(p), np.int64), np.ones(len(p), bool)
    least, open_ = np.zeros(len(p), np.int64), np.ones(len(p), bool)
    for d in range(1, WIDTH):
        q = np.maximum(p - d, 0)
        alive &= (p >= d) & (doc[q] == doc[p]) & (g[q] >= g[p])
        most[alive] = d
        q = np.minimum(p + d, len(g) - 1)
        stop = open_ & ((p + d >= len(g)) | (doc[q] != doc[p]) | (g[q] < g[p]))
        least[stop] = WIDTH - d
        open_ &= ~stop
    ok = least <= most
    p = p[ok]
    return doc[p], at[p] - w.begin[doc[p]], g[p], least[ok], most[ok]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in wordgrid.words(b["text"].to_pylist()):
            doc, word, key, least, most = anchors(w)
            row = pa.array(doc + w.first)
            sampled = np.flatnonzero(key % np.uint64(_SAMPLED) == 0)
            prefix = np.full(len(key), None, object)
            for i in sampled:
                a = w.begin[doc[i]] + word[i]
                prefix[i] = w.text(a, a + KEY)[:SPLIT]
            spot = word << 16 | least << 8 | most
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b["doc_id"].take(row), b["row_key"].take(row), pa.array(spot), pa.array(prefix, pa.binary())], names=["key", "doc_id", "row_key", "spot", "prefix"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs.whole(batches):
        key = t["key"].to_numpy()
        same = key[1:] == key[:-1]
        yield from t.filter(pa.array(np.append(False, same) | np.append(same, False))).drop_columns(["key"]).combine_chunks().to_batches()


def _varint(n: int, out: bytearray) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def shared_prefix(x: bytes, y: bytes, h: int = 0) -> int:
    """Length of the common prefix, known to be h at least."""
    n = min(len(x), len(y))
    if x[h:n] == y[h:n]:
        return n
    step = 16
    while x[h : h + step] == y[h : h + step]:
        h += step
        step *= 2
    while step > 1:
        step //= 2
        if x[h : h + step] == y[h : h + step]:
            h += step
    return h


def encode(entries: list[tuple[bytes, bytes]]) -> bytes:
    """Front-coded run of sorted (suffix, payload)."""
    out, last = bytearray(), b""
    for text, payload in entries:
        h = shared_prefix(last, text)
        for part, n in ((b"", h), (text[h:], len(text) - h), (payload, len(payload))):
            _varint(n, out)
            out += part
        last = text
    return zlib.compress(bytes(out), 1)


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Length of the prefix shared with the entry before, suffix, payload."""
    data, at, text = zlib.decompress(data), 0, b""
    size = len(data)

    def number() -> int:
        nonlocal at
        n = data[at]
        at += 1
        if n > 127:
            n &= 127
            shift = 7
            while True:
                x = data[at]
                at += 1
                n |= (x & 127) << shift
                if x < 128:
                    break
                shift += 7
        return n

    while at < size:
        h = number()
        n = number()
        text = text[:h] + data[at : at + n]
        at += n
        n = number()
        payload = data[at : at + n]
        at += n
        yield h, text, payload


def merge(streams: list[Iterator[tuple[int, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes]]:
    """Loser tree over sorted streams: prefix shared with the entry given before, suffix, payload, in order."""
    leaves = 1
    while leaves < len(streams):
        leaves *= 2
    lcp: list[int] = [0] * leaves
    text: list[bytes | None] = [None] * leaves
    load: list[bytes] = [b""] * leaves
    for s, stream in enumerate(streams):
        if (x := next(stream, None)) is not None:
            lcp[s], text[s], load[s] = 0, x[1], x[2]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser, whose lcp becomes the one with the winner."""
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        h = shared_prefix(x, y, lcp[a])
        if x[h : h + 1] < y[h : h + 1] or (len(x) == len(y) == h and a < b):
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    loser, winner = [0] * leaves, [0] * (2 * leaves)
    winner[leaves:] = range(leaves)
    for node in range(leaves - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    best = winner[1]
    while text[best] is not None:
        yield lcp[best], text[best], load[best]
        if (x := next(streams[best], None)) is None:
            text[best] = None
        else:
            lcp[best], text[best], load[best] = x
        node = (best + leaves) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


def _payload(doc_id: int | None, row_key: int, word: int, before: bytes) -> bytes:
    head = (b"\0" + bytes(8)) if doc_id is None else b"\1" + (doc_id ^ -(2**63)).to_bytes(8, "big", signed=True)
    return head + (row_key ^ -(2**63)).to_bytes(8, "big", signed=True) + word.to_bytes(8, "big") + before


def _place(order: bytes) -> tuple[int | None, int]:
    return int.from_bytes(order[1:9], "big", signed=True) ^ -(2**63) if order[0] else None, int.from_bytes(order[9:17], "big", signed=True) ^ -(2**63)


def _run_batches(splitters: list[bytes]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple[bytes, bytes]] = []

        def flush() -> pa.RecordBatch:
            entries.sort()
            ranges = [bisect_right(splitters, t[:SPLIT]) for t, _ in entries]
            edge = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist() + [len(entries)]
            data = [encode(entries[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            batch = pa.RecordBatch.from_arrays([pa.array([ranges[a] for a in edge[:-1]], pa.int32()), pa.array(data, pa.binary())], names=["part", "run"])
            entries.clear()
            return batch

        for b in batches:
            ids, keys, spots = (b[c].to_pylist() for c in ("doc_id", "row_key", "spots"))
            for w in wordgrid.words(b["text"].to_pylist()):
                for d in range(len(w.count)):
                    r = w.first + d
                    for spot in spots[r]:
                        word, least, most = spot >> 16, spot >> 8 & 255, spot & 255
                        a = int(w.begin[d]) + word
                        entries.append((w.text(a, a + LENGTH - least) + b" ", _payload(ids[r], keys[r], word, w.text(a - most, a))))
                    if len(entries) >= RUN:
                        yield flush()
        if entries:
            yield flush()

    return scan


def _offsets(text: bytes) -> list[int]:
    """Where words begin, and the end of the last with its blank."""
    raw = np.frombuffer(text, np.uint8)
    return [0, *(np.flatnonzero(raw == 32) + 1).tolist()]


def group_windows(members: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, bool, int, int, bytes]]:
    """Of entries that share KEY words: (order of the document, first, from word, to word, order of the earliest), runs of repeated windows."""
    alike: dict[tuple[bytes, bytes], list[tuple[bytes, int]]] = defaultdict(list)
    for text, payload in members:
        alike[text, payload[25:]].append((payload[:17], int.from_bytes(payload[17:25], "big")))
    found: dict[bytes, tuple[tuple[bytes, int], bool]] = {}
    windows = {}
    for (text, before), places in alike.items():
        places[:] = sorted(set(places))
        after = _offsets(text)
        left = b"" if not before else before + b" "
        start = [0] if not before else _offsets(left)
        back = len(start) - 1
        own = windows[text, before] = []
        for k in range(max(0, LENGTH - (len(after) - 1)), back + 1):
            piece = left[start[back - k] :] + text[: after[LENGTH - k]]
            own.append((k, piece))
            spot = (places[0][0], places[0][1] - k)
            old = found.get(piece)
            if old is None:
                found[piece] = spot, len(places) > 1
            elif old[0] != spot:
                found[piece] = min(old[0], spot), True
            elif len(places) > 1:
                found[piece] = spot, True
    for key, places in alike.items():
        again = [(k, found[piece][0]) for k, piece in windows[key] if found[piece][1]]
        if not again:
            continue
        for order, word in places:
            run: list | None = None
            for k, earliest in reversed(again):
                first, at = earliest == (order, word - k), word - k
                if run and run[1] == first and run[3] + 1 == at:
                    run[3] = at
                    run[4] = min(run[4], earliest[0])
                else:
                    if run:
                        yield tuple(run)
                    run = [order, first, at, at, earliest[0]]
            if run:
                yield tuple(run)


_SPANS = "doc_id long, row_key long, first boolean, from_word long, to_word long, earliest long"


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        place = [_place(r[0]) for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in place], pa.int64()), pa.array([p[1] for p in place], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([_place(r[4])[0] for r in rows], pa.int64())],
            names=[c.split()[0] for c in _SPANS.split(", ")],
        )

    for t in runs.whole(batches, "part"):
        rows: list[tuple] = []
        members: list[tuple[bytes, bytes]] = []
        head = 0
        for h, text, payload in merge([decode(d) for d in t["run"].to_pylist()]):
            if h < head or not members:
                if len(members) > 1:
                    rows.extend(group_windows(members))
                members, head = [], _offsets(text)[KEY]
            members.append((text, payload))
            if len(rows) > 20_000:
                yield out(rows)
                rows = []
        if len(members) > 1:
            rows.extend(group_windows(members))
        yield out(rows)


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjoining runs of windows of a document become one."""
    for b in batches:
        columns: list[list] = [[] for _ in range(6)]
        for doc_id, row_key, first, spans in zip(*(b[c].to_pylist() for c in ("doc_id", "row_key", "first", "spans")), strict=True):
            spans = sorted(((s["from_word"], s["to_word"], s["earliest"]) for s in spans), key=lambda s: s[:2])
            a, z, earliest = spans[0][0], spans[0][1], [spans[0][2]]
            for lo, hi, e in [*spans[1:], (2**62, 2**62, None)]:
                if lo <= z + 1:
                    z = max(z, hi)
                    earliest.append(e)
                else:
                    known = None if None in earliest else min(earliest)
                    for c, v in zip(columns, (doc_id, row_key, first, a, z + LENGTH, known), strict=True):
                        c.append(v)
                    a, z, earliest = lo, hi, [e]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 2 else pa.int64()) for i, c in enumerate(columns)], names=[c.split()[0] for c in _SPANS.split(", ")])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, first, from_word, to_word (exclusive) and the doc_id of the earliest occurrence among the windows."""
    spark = docs.sparkSession
    parts = common.workers(docs)
    base = docs.select(F.col("doc_id").cast("long"), common.row_key().alias("row_key"), F.col("text"))
    found = base.mapInArrow(_anchor_batches, "key long, doc_id long, row_key long, spot long, prefix binary")
    found = found.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared_batches, "doc_id long, row_key long, spot long, prefix binary")
    found = common.cut(found)
    ranges = max(RANGES * parts, -(-found.count() // RANGE))
    sample = found.where("prefix IS NOT NULL").select("prefix", F.pmod(F.xxhash64("doc_id", "row_key", "spot"), F.lit(1 << 40)).alias("draw"))
    share = (1 << 40) // max(1, -(-sample.count() // max(LEAST_SAMPLES, SAMPLES * ranges)))
    drawn = sorted(bytes(r[0]) for r in sample.where(F.col("draw") < share).collect())
    splitters = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    spots = found.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(F.collect_set("spot").alias("spots"))
    entries = base.join(spots.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key"))).select("doc_id", "row_key", "spots", "text")
    coded = entries.mapInArrow(_run_batches(splitters), "part int, run binary")
    spans = coded.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge_batches, _SPANS)
    listed = spans.groupBy("doc_id", "row_key", "first").agg(F.collect_set(F.struct("from_word", "to_word", "earliest")).alias("spans"))
    return listed.mapInArrow(_join_spans, _SPANS)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.when(F.col("first"), "first").otherwise("repeat").alias("role"), "from_word", "to_word", (F.col("to_word") - F.col("from_word")).alias("n_words"), F.col("earliest").alias("earliest_doc_id"))


def brute_force(rows: list[tuple[int | None, int, str | None]]) -> set[tuple]:
    """(doc_id, row_key, first, from_word, to_word) by looking at every window; for tests."""
    at: dict[tuple, list[tuple]] = defaultdict(list)
    for doc_id, key, text in set(rows):
        own = "".join(c if c > " " else " " for c in (text or "").lower()).split(" ")
        own = [x for x in own if x]
        for i in range(len(own) - LENGTH + 1):
            at[tuple(own[i : i + LENGTH])].append(((doc_id is not None, doc_id or 0, key), i, doc_id))
    hit: dict[tuple, set[int]] = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            least = min(places)
            for order, i, doc_id in places:
                hit[doc_id, order[2], (order, i, doc_id) == least].add(i)
    out = set()
    for (doc_id, key, first), starts in hit.items():
        for i in sorted(starts):
            if i - 1 not in starts:
                z = i
                while z + 1 in starts:
                    z += 1
                out.add((doc_id, key, first, i, z + LENGTH))
    return out
