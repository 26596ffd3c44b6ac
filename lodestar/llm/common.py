"""What the operators share: tables, places that cut the lineage, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.storage import fresh, remove, shared_dir, table

__all__ = ["cut", "first_by_hash", "fresh", "remove", "row_key", "shared_dir", "small", "table", "without", "workers"]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written once to the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    place = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return df.checkpoint()


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df, stored, and marked for broadcast if it has at most so many rows; beyond that Spark plans a shuffle and AQE splits its skew."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def row_key(text: str = "text") -> Column:
    """Tells rows of one id but different text apart."""
    return F.xxhash64(F.col(text))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, row_key) is in gone(doc_id, row_key); null ids equal each other.

    The smaller side, gone, is the build side of a shuffled hash join, so the
    documents are neither sorted nor spilled."""
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("row_key").alias("__gone_key")).hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs["text"]) == gone["__gone_key"]), "left_anti")


def first_by_hash(rows: DataFrame, bound: int, *key: str) -> DataFrame:
    """At most bound rows, the first by hash of key (ties by key).

    Rows whose hash is beyond twice the bound's share are dropped before the sort, so
    that no task sends more than its part of them to the driver."""
    found = rows.withColumn("__draw", F.pmod(F.xxhash64(*key), F.lit(1 << 40)))
    share = min(1.0, 2 * max(bound, 100) / max(1, found.count()))
    return found.where(F.col("__draw") < int(share * (1 << 40))).orderBy("__draw", *key).limit(bound).drop("__draw")


#: Bytes of input to a partition of an exchange.
PARTITION = 64 << 20


def workers(docs: DataFrame) -> int:
    """Partitions of an exchange: those of the session, or as many more as the size of docs asks for, where Spark knows it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION) if size < 1 << 56 else 1)
