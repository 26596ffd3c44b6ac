"""Metrics of answers and retrieval, summaries with bootstrap intervals, aggregation over seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T

METRICS = ("exact_match", "f1", "precision_at_k", "recall_at_k", "supporting_doc_coverage", "all_supporting_docs_found")


def relevant_flag(doc_id: Column, text: Column, relevant: Column, answers: Column) -> Column:
    """By document id, or, failing that, by an answer in the text."""
    return F.array_contains(relevant, doc_id) | ((F.size(answers) > 0) & T.contains_answer(text, answers))


def retrieval_metrics(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """hits (question_id, rank, doc_id, text), questions (question_id, answers, relevant_doc_ids): a row for each question."""
    flagged = hits.join(questions, "question_id").select("question_id", "doc_id", "relevant_doc_ids", relevant_flag(F.col("doc_id"), F.col("text"), F.col("relevant_doc_ids"), F.col("answers")).alias("flag"))
    grouped = flagged.groupBy("question_id").agg(F.avg(F.col("flag").cast("double")).alias("p"), F.max("flag").alias("some"), F.collect_set("doc_id").alias("docs"))
    x = questions.select("question_id", "relevant_doc_ids").join(grouped, "question_id", "left")
    n = F.size(F.array_distinct("relevant_doc_ids"))
    found = F.coalesce(F.size(F.array_intersect("relevant_doc_ids", "docs")), F.lit(0))
    known = n > 0
    return x.select(
        "question_id", F.coalesce("p", F.lit(0.0)).alias("precision_at_k"),
        F.when(known, found / n).otherwise(F.coalesce(F.col("some").cast("double"), F.lit(0.0))).alias("recall_at_k"),
        F.when(known, found / n).otherwise(0.0).alias("supporting_doc_coverage"), F.when(known & (found == n), 1.0).otherwise(0.0).alias("all_supporting_docs_found"),
    )


def bootstrap(values: np.ndarray, confidence: float = 0.95, resamples: int = 1000, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean; the order of the values matters for equality to the bit."""
    v = np.asarray(values, dtype=float)
    if len(v) < 2:
        return (0.0, 0.0) if not len(v) else (float(v[0]), float(v[0]))
    rng = np.random.default_rng(seed)
    means = np.array([rng.choice(v, size=len(v), replace=True).mean() for _ in range(resamples)])
    tail = (1 - confidence) / 2
    return float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail))


def bootstrap_intervals(predictions: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS, order: str = "example_id", confidence: float = 0.95, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row for each group with <m>, <m>_ci_low and <m>_ci_high; a group goes to one task, groups in parallel."""
    kinds = dict(predictions.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{m} double, {m}_ci_low double, {m}_ci_high double" for m in metrics])

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        row = list(key)
        for m in metrics:
            v = p[m].to_numpy(float)
            row += [float(v.mean()) if len(v) else 0.0, *bootstrap(v, confidence, resamples, seed)]
        return pd.DataFrame([row], columns=[*keys, *(f"{m}{x}" for m in metrics for x in ("", "_ci_low", "_ci_high"))])

    return predictions.select(*keys, order, *metrics).groupBy(*keys).applyInPandas(one, schema)


def bootstrap_distributed(predictions: DataFrame, keys: list[str], metric: str, resamples: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Poisson bootstrap for groups too large for a task: weights by hash of (row, resample), partial sums map-side."""
    draws = predictions.select(*keys, F.col(metric).alias("x"), F.xxhash64(*predictions.columns).alias("h")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.pmod(F.xxhash64("h", "b", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    limits = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1)) if k else 1) for k in range(8)])
    weight = sum(((u >= float(x)).cast("int") for x in limits[1:]), (u >= float(limits[0])).cast("int"))
    means = draws.withColumn("w", weight).groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    tail = (1 - confidence) / 2
    return means.groupBy(*keys).agg(F.percentile("m", tail).alias("ci_low"), F.percentile("m", 1 - tail).alias("ci_high"))


def summarize(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, means of the metrics, latencies and chunk tokens by system; missing means are 0."""
    keys = keys or ["dataset", "system", "retriever", "chunker", "seed"]
    have = predictions.columns
    aggs = [F.count("*").cast("int").alias("num_examples")]
    aggs += [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS if m in have]
    aggs += [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in ("retrieval_latency_s", "generation_latency_s") if m in have]
    return predictions.groupBy(*keys).agg(*aggs)


def long_form(summary: DataFrame, fields: list[str]) -> DataFrame:
    """(keys, field, value) without nulls."""
    keys = [c for c in ("dataset", "system", "retriever", "chunker", "seed") if c in summary.columns]
    return summary.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(keys, fields, "field", "value").where("value IS NOT NULL")


def aggregate_seeds(summary: DataFrame, fields: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one), least and greatest of each field over seeds; null chunkers are one group."""
    keys = ["dataset", "system", "retriever", "chunker"]
    stats = (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))), ("min", F.min), ("max", F.max))
    aggs = [f(F.when(F.lit(True), F.col(c).cast("double"))).alias(f"{c}_{n}") for c in fields for n, f in stats]
    nothing = [F.when(F.count(c) == 0, F.lit(None)).otherwise(F.lit(1)).alias(f"__{c}") for c in fields]
    out = summary.groupBy(*keys).agg(F.count("*").cast("int").alias("num_seeds"), F.array_sort(F.collect_list("seed")).alias("seed_values"), *aggs, *nothing)
    fixed = [F.when(F.col(f"__{c}").isNotNull(), F.col(f"{c}_{n}")).alias(f"{c}_{n}") for c in fields for n, _ in stats]
    return out.select(*keys, "num_seeds", "seed_values", *fixed).orderBy("dataset", "system")


def score_answers(rows: DataFrame, prediction: str = "prediction", golds: str = "gold_answers") -> DataFrame:
    return rows.withColumn("exact_match", T.best_exact_match(prediction, golds)).withColumn("f1", T.best_f1(prediction, golds))


def best_per_group(rows: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """The row name of the greatest score in each group; a null group is left out."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.max_by(name, F.struct(F.col(score), F.col(name))).alias(name), F.max(score).alias(score))
