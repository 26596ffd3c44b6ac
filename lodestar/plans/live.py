"""Live mode over a batch of questions: rewrite, plan, retrieve, fuse, compress, diversify, answer, cite."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import chunking, evidence, generation, retrieval
from lodestar.sources import uploads

MODES = ("traditional", "advanced", "multi_agent")


@dataclass
class Index:
    documents: DataFrame
    chunks: DataFrame
    retrievers: retrieval.Retrievers
    chunker_spec: dict
    retriever_spec: dict


def build_index(documents: DataFrame, chunker: str = "semantic", chunk_size: int = 256, chunk_overlap: int = 32, similarity_threshold: float = 0.72, retriever: str = "hybrid", top_k: int = 4) -> Index:
    spec = chunking.spec(chunker, chunk_size, chunk_overlap, similarity_threshold)
    wanted = retrieval.live_spec(retriever, top_k)
    if documents.isEmpty():
        raise ValueError("an index needs at least one document")
    chunks = chunking.build(documents, spec).persist()
    if chunks.isEmpty():
        raise ValueError("the chunker made no chunks of these documents")
    return Index(documents, chunks, retrieval.Retrievers(chunks, top_k), spec, wanted)


def build_index_from_files(spark: SparkSession, paths: list[str], **options: object) -> Index:
    return build_index(uploads.read(spark, *paths), **options)


@dataclass
class Result:
    evidence: DataFrame
    answers: DataFrame
    citations: DataFrame
    trace: list[dict] = field(default_factory=list)


def retrieval_queries(questions: DataFrame, mode: str, most_subqueries: int = 3) -> DataFrame:
    """question_id, question, query_variants, subqueries, queries."""
    advanced, multi = mode != "traditional", mode == "multi_agent"
    none = F.array().cast("array<string>")
    x = questions.select("question_id", "question").withColumn("query_variants", T.query_variants("question") if advanced else F.array(T.strip("question")))
    x = x.withColumn("subqueries", T.plan_subqueries("question", most_subqueries) if multi else none)
    return x.withColumn("queries", T.distinct_in_order(F.concat(F.array("question"), "query_variants", "subqueries")))


def retrieve(index: Index, planned: DataFrame, top_k: int, per_query_k: int) -> DataFrame:
    """Evidence rows; each query of a question is one retrieval query, and depth grows with their number."""
    each = planned.select("question_id", "question", F.size("queries").alias("__n"), F.posexplode("queries").alias("query_no", "query"))
    each = each.withColumn("query_id", F.concat_ws("#", F.col("question_id").cast("string"), F.col("query_no").cast("string")))
    depth = F.greatest(F.lit(max(top_k, per_query_k)), 2 * F.col("__n"))
    widest = max(top_k, per_query_k, 2 * (planned.agg(F.max(F.size("queries"))).first()[0] or 1))
    found = index.retrievers.create(index.retriever_spec)(each.select("query_id", "query"), widest)
    # what follows reads the hits, and then the evidence, several times: without persist() each time is another search of all chunks
    hits = found.join(each.withColumn("__depth", depth), "query_id").where(F.col("rank") <= F.col("__depth")).persist()
    pool = hits.groupBy("question_id").agg(F.greatest(F.lit(2 * top_k), F.max("__depth")).alias("__pool"))
    fused = retrieval.multi_query(hits.select("question_id", "query_no", "query", "chunk_id", "score", "rank"), max(2 * top_k, widest)).join(pool, "question_id").where(F.col("rank") <= F.col("__pool")).drop("__pool")
    # texts are joined after the ranking
    return fused.join(index.chunks.select("chunk_id", "doc_id", "title", "text"), "chunk_id").join(planned.select("question_id", "question"), "question_id").persist()


def run(index: Index, questions: DataFrame, mode: str = "advanced", top_k: int = 4, per_query_k: int = 8, token_budget: int = 384, most_subqueries: int = 3, generate: Callable[[DataFrame], DataFrame] = generation.extractive) -> Result:
    """questions: question_id, question."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    trace, begun = [], time.perf_counter()

    def note(stage: str, detail: str) -> None:
        trace.append({"stage": stage, "detail": detail, "seconds": round(time.perf_counter() - begun, 4)})

    planned = retrieval_queries(questions, mode, most_subqueries)
    if mode != "traditional":
        note("query_rewrite", "variants of each question")
    if mode == "multi_agent":
        note("planner_agent", "subqueries of each question")
    pool = retrieve(index, planned, top_k, per_query_k)
    note("retrieval", "fused over all queries of a question")
    packed = mode != "traditional"
    chosen = evidence.head(evidence.compress(pool, token_budget) if packed else evidence.uncompressed(pool), top_k)
    if packed:
        note("compression", f"to {token_budget} tokens")
    if mode == "multi_agent":
        chosen = evidence.diverse(chosen, top_k)
        note("filter_agent", "documents in turn")
    given = planned.join(evidence.contexts(chosen, packed), "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    answers = generate(given).withColumn("answer_support", T.support("prediction", F.coalesce("evidence_texts", F.array().cast("array<string>"))))
    answers = answers.withColumn("support_label", T.support_label("answer_support")).withColumn("mode", F.lit(mode)).withColumnRenamed("prediction", "answer")
    note("writer", "answers")
    note("evaluator", "support of the answers")
    return Result(chosen, answers, evidence.citations(chosen), trace)
