"""Operator 8, SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is BLOCKS SimHash blocks of BITS bits over its words (lower
case, ASCII punctuation as blanks), each word weighted by a power of its count, and a
check block over its shingles of SHINGLE words.  Two documents are near
duplicates if some of the blocks differ in at most RADIUS bits, all of them in
at most WHOLE = BLOCKS * (RADIUS + 1) - 1 and the check blocks in at most CHECK.
By the pigeonhole principle some block of any pair within WHOLE is within
RADIUS, so the first condition loses nothing.

Each block is masked in 2 ** (RADIUS + 1) - 1 ways: bit position i has a vector
m(i) of RADIUS + 1 bits, and mask v keeps the positions whose m(i) has an odd
product with v.  For any RADIUS positions some v other than 0 is orthogonal to
all of them, so that two blocks within RADIUS agree under that mask with
certainty.  Each pair is reported only for the first mask in which it collides.
Pairs that are in one component anyway need no comparison, so a first pass over
STAR_MASKS masks joins each document with one drawn member of its bucket and
finds most of a group of thousands in linear time; the second pass, over all
masks, looks at every pair of different components.

Groups are connected components of the near duplicates; the first of each, by
(doc_id, row_key) with null ids first, stays.  Equal fingerprints are one node,
so thousands of exact copies cost one row in the tables.  Components come from
alternating large-star and small-star steps on checkpointed edges, after a
union-find within each partition.

Defined cases: null texts and texts without a word are near duplicates of
nothing and stay; very long texts are hashed whole, a slice of their words at a time; of
documents that tie in doc_id the one of the lesser row_key stays; rows with the same doc_id and text come back as one row with
their number in `rows`; an empty table gives no rows; other columns are not
looked at.  A text with fewer than SHINGLE words has one shingle, itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, runs, wordgrid

BLOCKS = 4
BITS = 56
RADIUS = 5
MASKS = 2 ** (RADIUS + 1) - 1
WHOLE = BLOCKS * (RADIUS + 1) - 1
CHECK = 22
#: Masks of each block used in the first pass.
STAR_MASKS = 4
#: Exponent in texts of SHORT words and less, and of LONG and more; in between it falls with the
#: logarithm, as counts of common words make long texts of one language alike.
POWER, SHORT, LONG = (0.9, 0.45), 200, 2000
SHINGLE = 3
_SEEDS = np.random.default_rng(8).integers(1, 2**63, 64, dtype=np.uint64)
_BLOCK_COLUMNS = [f"b{i}" for i in range(BLOCKS)] + ["check_block"]
_PRINTS = "doc_id long, row_key long, node long, " + ", ".join(f"{c} long" for c in _BLOCK_COLUMNS)


def masks(radius: int = RADIUS) -> np.ndarray:
    """2 ** (radius + 1) - 1 masks of BITS bits that cover every choice of radius positions."""
    top = 1 << (radius + 1)
    m = np.random.default_rng(88).permutation(np.resize(np.arange(1, top), BITS))
    odd = np.array([[bin(int(x) & v).count("1") % 2 == 1 for x in m] for v in range(1, top)])
    full = np.zeros((top - 1, 64), bool)
    full[:, :BITS] = odd
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)[:, 0]


def power(n: np.ndarray) -> np.ndarray:
    """Exponent of the counts in a text of n words."""
    return np.clip(POWER[0] - (POWER[0] - POWER[1]) * np.log(n / SHORT) / np.log(LONG / SHORT), POWER[1], POWER[0])


def _hashes(h: np.ndarray, count: int) -> np.ndarray:
    return np.stack([wordgrid.mix(h ^ s) for s in _SEEDS[:count]], 1)


def _sums(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each bit, its weight over the rows; a slice of rows at a time."""
    total = np.zeros(64 * rows.shape[1], np.float64)
    for a in range(0, len(rows), 2048):
        total += weight[a : a + 2048] @ np.unpackbits(rows[a : a + 2048].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    return total


def _blocks(sums: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Signs as BLOCKS words of BITS bits."""
    sign = (2 * sums > whole[:, None])[:, : BLOCKS * BITS].reshape(len(sums), BLOCKS, BITS)
    full = np.zeros((len(sums), BLOCKS, 64), bool)
    full[:, :, :BITS] = sign
    return np.packbits(full, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """A row of BLOCKS + 1 words for each text; all 0 for a text without words."""
    out = np.zeros((len(texts), BLOCKS + 1), np.uint64)
    for w in wordgrid.words(texts, plain=True):
        some = np.flatnonzero(w.count)
        if not len(some):
            continue
        kinds, kind = np.unique(w.hash, return_inverse=True)
        table = _hashes(kinds, -(-BLOCKS * BITS // 64))
        key, n = np.unique(w.doc * len(kinds) + kind, return_counts=True)
        edge = np.searchsorted(key, np.append(some, some[-1] + 1) * len(kinds))
        weight = (n ** np.repeat(power(w.count[some]), np.diff(edge))).astype(np.float32)
        rows = table[key % len(kinds)]
        sums = np.stack([_sums(rows[a:b], weight[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)])
        out[w.first + some, :BLOCKS] = _blocks(sums, np.add.reduceat(weight, edge[:-1]))
        g, at = w.grams(SHINGLE)
        edge = np.searchsorted(w.doc[at], np.append(some, some[-1] + 1))
        g = g[:, None].copy()
        one = np.ones(2048, np.float32)
        for d, a, b in zip(some, edge[:-1], edge[1:], strict=True):
            h = g[a:b] if b > a else wordgrid.mix(w.hash[w.begin[d] : w.begin[d] + w.count[d]].sum(keepdims=True, dtype=np.uint64))[:, None]
            total = sum(one[: min(2048, len(h) - i)] @ np.unpackbits(h[i : i + 2048].view(np.uint8), axis=1, bitorder="little").astype(np.float32) for i in range(0, len(h), 2048))
            out[w.first + d, BLOCKS] = np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = fingerprints(b["text"].to_pylist())
        node = wordgrid.mix(np.bitwise_xor.reduce(wordgrid.mix(f + _SEEDS[: BLOCKS + 1] * np.uint64(3)) * _SEEDS[: BLOCKS + 1], axis=1))
        none = ~f.any(axis=1)
        columns = [pa.array(x.view(np.int64), mask=none) for x in (node, *np.ascontiguousarray(f.T))]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["row_key"], *columns], names=[c.split()[0] for c in _PRINTS.split(", ")])


def _table_batches(masks_used: int):
    """A row (table, block, node, part) for each node, block and mask; the key follows from table and block.

    Rows come mask by mask, not node by node."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(BLOCKS):
                for t in range(masks_used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, i * MASKS + t, np.int16)), b[f"b{i}"], b["node"], b["part"]], names=["table", "block", "node", "part"])

    return tables


def _key() -> Column:
    """Hash of table and masked block, computed on either side of the exchange rather than carried over it."""
    mask = F.array(*(F.lit(int(m)) for m in masks().view(np.int64)))
    return F.xxhash64("table", F.col("block").bitwiseAND(F.element_at(mask, F.pmod("table", F.lit(MASKS)).cast("int") + 1)))


def _edges(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "z"])


def _star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each key, pairs with one member drawn by hash; linear in the rows."""
    for t in runs.whole(batches):
        key, block, node = (t[c].to_numpy() for c in ("key", "block", "node"))
        draw = wordgrid.mix(node.view(np.uint64) ^ key.view(np.uint64))
        order = np.lexsort((draw, key))
        edge = runs.bounds(key)
        centre = np.repeat(order[edge[:-1]], np.diff(edge))
        near = (np.bitwise_count(block.view(np.uint64) ^ block.view(np.uint64)[centre]) <= RADIUS) & (node != node[centre])
        yield _edges(node, np.flatnonzero(near), centre[near])


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of different parts within a key whose blocks are within RADIUS, for the first mask in which they collide."""
    m = masks()
    for t in runs.whole(batches):
        key, table, block, node, part = (t[c].to_numpy() for c in ("key", "table", "block", "node", "part"))
        x = block.view(np.uint64)
        for i, j in runs.cross(key, part):
            diff = x[i] ^ x[j]
            near = np.bitwise_count(diff) <= RADIUS
            i, j, diff = i[near], j[near], diff[near]
            if not len(i):
                continue
            first = ((diff[:, None] & m) == 0).argmax(axis=1)
            own = table[i] % MASKS == first
            yield _edges(node, i[own], j[own])


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (member, least member) of the components of this partition's edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for b in batches:
        for a, z in zip(b["a"].to_pylist(), b["z"].to_pylist(), strict=True):
            a, z = root(a), root(z)
            if a != z:
                parent[max(a, z)] = min(a, z)
    some = [(x, root(x)) for x in parent]
    some = [(r, x) for x, r in some if r != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64())], names=["a", "z"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a < z); root is the least node that it is connected with."""
    now = common.cut(edges.mapInArrow(_forest_batches, "a long, z long").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "z"))).first())

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("z").alias("a"), F.col("a").alias("z")))
        least = both.groupBy("a").agg(F.least(F.min("z"), F.col("a")).alias("m"))
        large = both.where("z > a").join(least, "a").where("m < z").select(F.col("m").alias("a"), "z").distinct()
        small = large.groupBy("z").agg(F.min("a").alias("m"))
        now = large.join(small, "z").select(F.col("m").alias("m"), F.explode(F.array("a", "z")).alias("x")).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("z")).distinct()
        now = common.cut(now)
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("z").alias("node"), F.col("a").alias("root"))


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, rows, group_id (doc_id of the one that stays), group_size (in distinct documents), keep."""
    prints = docs.select(F.col("doc_id").cast("long"), common.row_key().alias("row_key"), F.col("text")).mapInArrow(_fingerprint_batches, _PRINTS)
    prints = common.cut(prints.groupBy("doc_id", "row_key", "node", *_BLOCK_COLUMNS).agg(F.count("*").alias("rows")))
    nodes = prints.where("node IS NOT NULL").select("node", *_BLOCK_COLUMNS).distinct()
    parts = common.workers(docs)

    def tables(some: DataFrame, masks_used: int, *order: str) -> DataFrame:
        rows = some.select("node", "part", *_BLOCK_COLUMNS[:BLOCKS]).mapInArrow(_table_batches(masks_used), "table short, block long, node long, part long")
        return rows.repartition(parts, _key()).withColumn("key", _key()).sortWithinPartitions("key", *order)

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (nodes.select(F.col("node").alias(n), F.array(*_BLOCK_COLUMNS).alias(f"{n}_bits")) for n in ("a", "z"))
        apart = [F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("z_bits")[i])) for i in range(BLOCKS + 1)]
        return pairs.distinct().join(left, "a").join(right, "z").where((sum(apart[1:BLOCKS], apart[0]) <= WHOLE) & (apart[BLOCKS] <= CHECK)).select("a", "z")

    # a few masks and pairs with one drawn member of each bucket find most of a large group at a linear cost
    stars = tables(nodes.withColumn("part", F.lit(0).cast("long")), STAR_MASKS).mapInArrow(_star_batches, "a long, z long")
    begun = components(verified(stars))
    # then all masks and all pairs, but for those whose two are in one component already
    known = nodes.join(begun, "node", "left").withColumn("part", F.coalesce("root", "node"))
    pairs = tables(known, MASKS, "part").mapInArrow(_pair_batches, "a long, z long")
    roots = components(verified(pairs).unionByName(begun.select(F.col("root").alias("a"), F.col("node").alias("z"))))
    grouped = prints.join(roots, "node", "left").withColumn("group", F.when(F.col("node").isNull(), F.struct("doc_id", "row_key", F.lit(None).cast("long").alias("root"))).otherwise(F.struct(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row_key"), F.coalesce("root", "node").alias("root"))))
    first = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("group_size"))
    return grouped.join(first, "group").select("doc_id", "row_key", "rows", F.col("first.doc_id").alias("group_id"), "group_size", F.struct("doc_id", "row_key").eqNullSafe(F.col("first")).alias("keep"))


def keep(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns; of rows with the same doc_id and text one stays."""
    decided = common.cut(decide(docs).where("NOT keep OR rows > 1"))
    left = common.without(docs, decided.where("NOT keep"))
    again = decided.where("keep AND rows > 1").select("doc_id", "row_key")
    if again.isEmpty():
        return left
    once = left.withColumn("__key", common.row_key()).join(again.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__again")).hint("shuffle_hash"), left["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__again")), "left_semi")
    return common.without(left, again).unionByName(once.dropDuplicates(["doc_id", "__key"]).drop("__key"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(common.table(spark, sf_dir, "documents")).drop("row_key")
