"""Experiments: chunkers by retrievers over a dataset, the baseline, seeds, summaries and artifacts."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schemas, storage
from lodestar.operators import chunking, evaluation, evidence, generation, retrieval
from lodestar.sources import datasets, results

Generate = Callable[[DataFrame], DataFrame]


def _timed(rows: DataFrame, name: str) -> tuple[DataFrame, float]:
    begun = time.perf_counter()
    return storage.stored(rows, name), time.perf_counter() - begun


def run_system(chunks: DataFrame, examples: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], k: int, generate: Generate, titles: bool) -> DataFrame:
    """Predictions of one (chunker, retriever) for all questions.

    Hits and answers are written and read back, so that later plans begin at a scan; a
    latency is the time of that step over the number of questions."""
    queries = examples.select(F.col("example_id").alias("query_id"), F.col("question").alias("query"))
    ranked, retrieval_s = _timed(retrieve(queries, k), "hits")
    hits = ranked.join(chunks.select("chunk_id", "doc_id", "title", "text"), "chunk_id").withColumnRenamed("query_id", "question_id")
    asked = examples.withColumnRenamed("example_id", "question_id")
    metrics = evaluation.retrieval_metrics(hits.select("question_id", "rank", "doc_id", "text"), asked.select("question_id", "answers", "relevant_doc_ids"))
    listed = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "title"))).alias("h"))
    rows = asked.join(evidence.experiment_context(hits, titles), "question_id", "left").join(listed, "question_id", "left")
    written, generation_s = _timed(generate(rows), "answers")
    answered = evaluation.score_answers(written, "prediction", "answers").join(metrics, "question_id")
    pick = lambda c: F.coalesce(F.transform("h", lambda x: x[c]), F.array().cast("array<string>")).alias(f"retrieved_{c}s")
    n = max(1, written.count())
    return answered.select(
        F.col("question_id").alias("example_id"), "question", "prediction", F.col("answers").alias("gold_answers"), pick("chunk_id"), pick("doc_id"), pick("title"), *evaluation.METRICS,
        F.lit(retrieval_s / n).alias("retrieval_latency_s"), F.lit(generation_s / n).alias("generation_latency_s"),
    )


def run_baseline(examples: DataFrame, generate: Generate) -> DataFrame:
    """Answers without context; retrieval metrics are 0."""
    rows, generation_s = _timed(generate(examples.withColumn("context", F.lit(None).cast("string"))), "answers")
    empty = F.array().cast("array<string>")
    scored = evaluation.score_answers(rows, "prediction", "answers")
    zeros = [F.lit(0.0).alias(m) for m in (*evaluation.METRICS[2:], "retrieval_latency_s")]
    return scored.select(
        "example_id", "question", "prediction", F.col("answers").alias("gold_answers"), *(empty.alias(f"retrieved_{c}s") for c in ("chunk_id", "doc_id", "title")), "exact_match", "f1", *zeros,
        F.lit(generation_s / max(1, rows.count())).alias("generation_latency_s"),
    )


def check(config: dict) -> None:
    """Fails on unknown chunkers, retrievers and datasets before any job."""
    for c in config.get("chunkers", []):
        if c.get("type") not in chunking.REGISTRY:
            raise ValueError(f"unknown chunker type: {c.get('type')}")
    for r in config.get("retrievers", []):
        if r.get("type", "dense") not in ("dense", "bm25", "hybrid", "rerank"):
            raise ValueError(f"unknown retriever type: {r.get('type')}")
    for d in config.get("datasets", []):
        if d.get("name") not in ("squad_v2", "hotpot_qa", "tables"):
            raise ValueError(f"unknown dataset: {d.get('name')}")


def run_dataset(docs: DataFrame, examples: DataFrame, config: dict, seed: int, dataset: str, generate: Generate = generation.extractive) -> tuple[DataFrame, DataFrame]:
    """Predictions and summaries of every system on one dataset, tagged; each system's predictions are stored before the next runs."""
    k, legacy = int(config.get("top_k", 4)), not (config.get("retrievers") or config.get("retriever"))
    specs = config.get("retrievers") or [config.get("retriever") or {"type": "dense"}]
    examples = storage.stored(examples, "examples")
    parts, sizes = [], []

    def tag(rows: DataFrame, retriever: str | None, chunker: str | None) -> DataFrame:
        name = F.lit("parametric_only") if chunker is None else F.lit(chunker if legacy else f"{retriever}__{chunker}")
        return storage.stored(rows.withColumns({"seed": F.lit(seed), "dataset": F.lit(dataset), "system": name, "retriever": F.lit(retriever or "none"), "chunker": F.lit(chunker).cast("string")}), "predictions")

    if config.get("include_parametric_baseline", True):
        parts.append(tag(run_baseline(examples, generate), None, None))
    for c in config["chunkers"]:
        chunks = storage.stored(chunking.build(docs, c), "chunks")
        made = retrieval.Retrievers(chunks, k)
        for r in specs:
            name = r.get("name", r.get("type", "dense"))
            parts.append(tag(run_system(chunks, examples, made.create(r), k, generate, dataset == "hotpot_qa"), name, c["name"]))
        made.release()
        sizes.append(chunks.agg(F.lit(c["name"]).alias("chunker"), F.count("*").cast("int").alias("num_chunks"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_chunk_tokens")))
    predictions = reduce(DataFrame.unionByName, parts)
    summary = evaluation.summarize(predictions)
    counted = reduce(DataFrame.unionByName, sizes).crossJoin(docs.agg(F.count("*").cast("int").alias("num_documents")))
    return predictions, storage.stored(summary.join(F.broadcast(counted), "chunker", "left"), "summaries")


def run_suite(spark: SparkSession, config: dict, out: str | None = None, generate: Generate = generation.extractive) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All seeds and datasets: predictions, summaries with intervals, aggregates over seeds; written to out if given."""
    check(config)
    predictions, summaries = [], []
    for seed in generation.seeds_of(config):
        for d in config["datasets"]:
            docs, examples = datasets.load(spark, {**d, "seed": seed})
            p, s = run_dataset(docs, examples, config, seed, d["name"], generate)
            predictions.append(p)
            summaries.append(s)
    p, s = reduce(DataFrame.unionByName, predictions), reduce(DataFrame.unionByName, summaries)
    keys = ["seed", "dataset", "system"]
    intervals = evaluation.bootstrap_intervals(p, keys, resamples=int(config.get("bootstrap_samples", 1000)))
    s = storage.stored(s.join(intervals.select(*keys, *(f"{m}{x}" for m in evaluation.METRICS for x in ("_ci_low", "_ci_high"))), keys), "summaries")
    a = storage.stored(evaluation.aggregate_seeds(s, ["num_examples", "num_documents", "num_chunks", "avg_chunk_tokens", *evaluation.METRICS, "avg_retrieval_latency_s", "avg_generation_latency_s"]), "aggregates")
    if out:
        results.write_table(p, f"{out}/table")
        results.export(p, s, a, config, out)
    return p, s, a


SCHEMA = schemas.PREDICTION
