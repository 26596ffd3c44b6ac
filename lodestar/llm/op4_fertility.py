"""Operator 4, quality rules by tokeniser fertility.

Two public vocabularies measure each text: characters per token under a
byte-level BPE and under a BPE with byte fallback, the share of byte-fallback
tokens, and the entropy of the token ids over its highest possible value for
that many tokens.  Bands come from all documents: for each language and length
class (powers of four of the token count, the first two in one) the quartiles,
widened by WIDEN quartile distances.  Short texts, of under 64 tokens, have their
own widening, SHORT_WIDEN.  Both are set so that at most 1 in 500 of the documents
labelled good at sf0.1 is rejected.  A class with fewer than LEAST documents takes
the bands of its language, or for short texts first those of its length in all
languages; a language with fewer takes those of the whole table.

Defined cases: null or empty or blank text is rejected as "empty"; a null
language counts as "und"; a value on the edge of a band is within it; of equal rows
(ties, repeats) each is judged, alike; very long texts are tokenised whole, in blocks cut where
no token crosses; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenizers

WIDEN = 2.5
SHORT_WIDEN = 4.0
LEAST = 30
#: Length classes up to this one hold the short texts.
SHORT_CLASS = 2
#: A longer text of n pieces has bands wider by NOISE / n, at most twice as wide, as few tokens measure little.
NOISE = 64
#: Quartile distances are taken as at least this share of the median.
FLOOR = 0.02
METRICS = ("chars_per_token", "chars_per_piece", "fallback_share", "evenness")
_SCHEMA = "n_tokens long, n_pieces long, chars_per_token double, chars_per_piece double, fallback_share double, entropy double, evenness double"


def measure_text(text: str | None, folder: str) -> tuple:
    return measure_texts(pa.array([text], pa.string()), folder)[0]


def measure_texts(texts: pa.Array, folder: str) -> list[tuple]:
    ranks, pieces = tokenizers.encode_all(folder, texts, both=True)
    ids, edge = pieces.ids, pieces.edge
    low, high = min(tokenizers.byte_pieces(folder)), max(tokenizers.byte_pieces(folder))
    bytewise = np.append(0, np.cumsum((ids >= low) & (ids <= high)))
    fallback, tokens = bytewise[edge[1:]] - bytewise[edge[:-1]], np.diff(ranks.edge)
    out = []
    for i, text in enumerate(texts.to_pylist()):
        if text is None or not text.strip():
            out.append((0, 0, 0.0, 0.0, 0.0, 0.0, 0.0))
            continue
        own, n = np.sort(ids[edge[i] : edge[i + 1]], kind="stable"), int(edge[i + 1] - edge[i])
        c = np.diff(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))) / n
        entropy = float(-(c * np.log2(c)).sum())
        out.append((int(tokens[i]), n, len(text) / int(tokens[i]), len(text) / n, int(fallback[i]) / n, entropy, entropy / np.log2(n) if n > 1 else 1.0))
    return out


def measure(docs: DataFrame, folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """doc_id, row_key, lang and the measures, a row for each row of docs."""

    @F.pandas_udf(_SCHEMA)
    def fertility(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([m for own in tokenizers.together(pa.array(text, pa.string())) for m in measure_texts(own, folder)], columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    found = docs.select("doc_id", common.row_key().alias("row_key"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), fertility(F.col("text")).alias("m"))
    return found.select("doc_id", "row_key", "lang", "m.*").withColumn("size_class", F.when(F.col("n_tokens") > 0, F.greatest(F.lit(1), F.floor(F.log2("n_tokens") / 2))).cast("int"))


def _bands(measured: DataFrame, keys: list[str], tag: str) -> DataFrame:
    aggs = [F.count("*").alias(f"{tag}_n")]
    aggs += [F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(f"{tag}_{m}") for m in METRICS]
    return measured.where("n_tokens > 0").groupBy(*keys).agg(*aggs)


def judge(measured: DataFrame) -> DataFrame:
    """The measures with reasons (array of the bands left) and keep.  measured is read five times; it should be stored.

    The bands have a row for each language and length class.  They are broadcast if counted as
    few, since a join on so few keys would be skewed; of many, AQE divides the large ones."""
    x = measured
    for keys, tag in ((["lang", "size_class"], "fine"), (["lang"], "mid"), (["size_class"], "size")):
        x = x.join(common.small(_bands(measured, keys, tag)), keys, "left")
    x = x.crossJoin(common.small(_bands(measured, [], "all")))
    short = F.col("size_class") <= SHORT_CLASS
    widen = F.when(short, SHORT_WIDEN).otherwise(WIDEN * (1 + NOISE / F.greatest(F.lit(NOISE), F.col("n_pieces"))))
    reasons = [F.when(F.col("n_tokens") == 0, F.lit("empty"))]
    for m in METRICS:
        q = F.when(F.col("fine_n") >= LEAST, F.col(f"fine_{m}")).when(short & (F.col("size_n") >= LEAST), F.col(f"size_{m}")).when(F.col("mid_n") >= LEAST, F.col(f"mid_{m}")).otherwise(F.col(f"all_{m}"))
        wide = widen * F.greatest(q[2] - q[0], F.lit(FLOOR) * q[1], F.lit(0.01))
        below, above = F.col(m) < q[0] - wide, F.col(m) > q[2] + wide
        out = {"fallback_share": above, "evenness": below}.get(m, below | above)
        reasons.append(F.when((F.col("n_tokens") > 0) & out, F.lit(m)))
    x = x.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return x.select(*measured.columns, "reasons", (F.size("reasons") == 0).alias("keep"))


def decide(docs: DataFrame, folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    return judge(common.cut(measure(docs, folder)))


def keep(docs: DataFrame, folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """The documents that pass, with all their columns."""
    return common.without(docs, decide(docs, folder).where("NOT keep").select("doc_id", "row_key"))


def op4_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(common.table(spark, sf_dir, "documents")).drop("row_key", "size_class")
