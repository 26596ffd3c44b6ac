"""From raw documents to packed sequences: five stages, each written before the next reads it.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.

1. quality_rules     operator 4: documents outside the fertility bands go
2. line_dedup        operator 10: repeated lines go, n_chars follows the text, documents
                     whose every line was a repeat go
3. near_dedup        operator 8: one document of each group of near duplicates stays
4. decontamination   operator 7: documents that hold a benchmark item go
5. packing           operator 9: the rest in sequences (doc_id, piece, sequence, ...)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import common, op4_fertility, op7_decontamination, op8_simhash, op9_packing, op10_lines


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_fertility.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_lines.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_simhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_decontamination.keep(docs, common.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokeniser bands, SimHash components and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
