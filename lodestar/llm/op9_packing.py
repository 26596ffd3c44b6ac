"""Operator 9, cost-balanced packing.

The cost of a piece of n tokens in training is LINEAR * n + QUADRATIC * n^2,
as attention is masked to the document.  Longer documents are cut into pieces
of CAPACITY tokens and a rest, so that nothing is lost.  Within a shard, pieces
in descending cost go to the cheapest sequence with room for them, out of
ceil(tokens / CAPACITY) sequences opened at the start; only if none has room is
another opened.  Shards hold about SHARD_TOKENS tokens each, so their number
grows with the corpus while each fits a worker; pieces fall in shards by hash.

Defined cases: a null or empty text has no tokens and comes back as one row of
0 tokens in no sequence (null); very long texts are
cut into pieces, never dropped; equal costs go by (doc_id, row_key, piece), of
equal sequences the first is taken; repeated rows are each packed; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenizers

CAPACITY = 8192
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SHARD_TOKENS = 4_000_000
_OUT = "doc_id long, row_key long, piece int, first_token long, n_tokens long, cost double, shard int, sequence string, at int"


def assign(cost: np.ndarray, tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place in it of each piece; the pieces come in descending cost."""
    bins = max(1, -(-int(tokens.sum()) // capacity))
    load, room = np.zeros(2 * bins + 8), np.full(2 * bins + 8, capacity, dtype=np.int64)
    to, at = np.empty(len(cost), np.int64), np.empty(len(cost), np.int64)
    for i, (c, n) in enumerate(zip(cost.tolist(), tokens.tolist(), strict=True)):
        b = int(np.where(room[:bins] >= n, load[:bins], np.inf).argmin())
        if room[b] < n:
            b = bins
            bins += 1
            if bins > len(load):
                load, room = np.append(load, np.zeros(bins)), np.append(room, np.full(bins, capacity))
        to[i], at[i] = b, capacity - room[b]
        load[b] += c
        room[b] -= n
    return to, at


def counts(docs: DataFrame, folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    @F.pandas_udf("long")
    def n_tokens(text: pd.Series) -> pd.Series:
        found = [np.diff(tokenizers.encode_all(folder, own)[0].edge) for own in tokenizers.together(pa.array(text, pa.string()))]
        return pd.Series(np.concatenate([np.empty(0, np.int64), *found]))

    return docs.select(F.col("doc_id").cast("long"), common.row_key().alias("row_key"), n_tokens("text").alias("total"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """doc_id, row_key (of its text), piece, first_token, n_tokens, cost, shard, sequence and place (at) in it."""
    found = common.cut(counts(docs, folder))
    total = found.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    pieces = found.select("doc_id", "row_key", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("total") - 1) / capacity).cast("int")))).alias("piece"))
    pieces = pieces.select(
        "doc_id", "row_key", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"),
        F.greatest(F.lit(0), F.least(F.lit(capacity), F.col("total") - F.col("piece").cast("long") * capacity)).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.lit(shards)).cast("int").alias("shard"),
    )

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p["cost"] = LINEAR * p["n_tokens"] + QUADRATIC * p["n_tokens"].astype("float64") ** 2
        p = p.sort_values(["cost", "doc_id", "row_key", "piece"], ascending=[False, True, True, True], kind="stable")
        full = p["n_tokens"].to_numpy() > 0
        to, at = assign(p["cost"].to_numpy()[full], p["n_tokens"].to_numpy()[full], capacity)
        p["sequence"] = pd.Series([None] * len(p), index=p.index, dtype=object)
        p["at"] = pd.Series([pd.NA] * len(p), index=p.index, dtype="Int32")
        p.loc[full, "sequence"] = p["shard"][full].astype(str).to_numpy() + "-" + to.astype(str).astype(object)
        p.loc[full, "at"] = at
        return p[[x.split()[0] for x in _OUT.split(", ")]]

    return pieces.groupBy("shard").applyInPandas(one, _OUT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
