"""Record types as Spark schemas, and their flat forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, title string, text string, dataset string"
EXAMPLE = "example_id string, dataset string, question string, answers array<string>, relevant_doc_ids array<string>, metadata string"
CHUNK = "chunk_id string, doc_id string, title string, dataset string, chunk_index int, text string, token_count int"
PREDICTION = (
    "seed int, dataset string, system string, retriever string, chunker string, example_id string, question string, prediction string, gold_answers array<string>, "
    "retrieved_chunk_ids array<string>, retrieved_doc_ids array<string>, retrieved_titles array<string>, exact_match double, f1 double, "
    "precision_at_k double, recall_at_k double, supporting_doc_coverage double, all_supporting_docs_found double"
)


def flat_metric(name: str, value: Column, low: Column, high: Column) -> list[Column]:
    return [value.alias(name), low.alias(f"{name}_ci_low"), high.alias(f"{name}_ci_high")]


def flat_aggregate(name: str, x: Column) -> list[Column]:
    """mean, std, min and max of a struct as columns."""
    return [x[p].alias(f"{name}_{p}") for p in ("mean", "std", "min", "max")]


def system_name(retriever: Column | str, chunker: Column | str, legacy: bool = False) -> Column:
    """retriever__chunker, the chunker alone for configurations without retrievers, and parametric_only without a chunker."""
    c = F.col(chunker) if isinstance(chunker, str) else chunker
    r = F.col(retriever) if isinstance(retriever, str) else retriever
    return F.coalesce(c if legacy else F.when(c.isNotNull(), F.concat_ws("__", r, c)), F.lit("parametric_only"))


def with_legacy(frame: DataFrame, name: str) -> Column:
    """The column, its mean, or for coverage the older recall columns, whichever the frame has."""
    names = [f"{name}_mean", name]
    if name == "supporting_doc_coverage":
        names += ["recall_at_k_mean", "recall_at_k"]
    for n in names:
        if n in frame.columns:
            return F.col(n)
    raise ValueError(f"no column for {name}")
