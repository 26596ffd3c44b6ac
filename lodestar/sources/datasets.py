"""Question datasets: samplers over tables in the layouts of the public datasets.

A seeded order is a column: by default the md5 of seed and id, which any engine can
reproduce; a permutation of one's own may be given as column `perm`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar import storage
from lodestar.functions import text as T


def shuffled(column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def squad_like(rows: DataFrame, max_examples: int, candidate_pool_size: int | None = None, seed: int = 42, answerable_only: bool = True, dataset: str = "squad_v2") -> tuple[DataFrame, DataFrame]:
    """rows (id, title, context, question, answers array): documents of the chosen titles and a round robin of questions over titles."""
    pool_size = candidate_pool_size or 5 * max_examples
    kept = rows.where(F.size("answers") > 0) if answerable_only else rows
    order = F.col("perm") if "perm" in rows.columns else shuffled("id", seed)
    pool = kept.withColumn("__o", order).orderBy("__o", "id").limit(pool_size)
    pool = pool.withColumn("__pos", F.row_number().over(Window.orderBy("__o", "id")))
    turn = F.row_number().over(Window.partitionBy("title").orderBy("__pos"))
    chosen = pool.withColumn("__turn", turn).withColumn("__t", shuffled("title", seed)).orderBy("__turn", "__t", "title").limit(max_examples)
    examples = chosen.select(
        F.concat(F.lit("squad::"), F.col("id").cast("string")).alias("example_id"), F.lit(dataset).alias("dataset"), "question", "answers",
        F.array(F.concat(F.lit("squad::"), "title")).alias("relevant_doc_ids"), F.to_json(F.struct("title")).alias("metadata"),
    )
    contexts = pool.join(chosen.select("title").distinct(), "title", "left_semi").groupBy("title", "context").agg(F.min("__pos").alias("p"))
    docs = contexts.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("p", "context"))).alias("c")).select(
        F.concat(F.lit("squad::"), "title").alias("doc_id"), "title", F.array_join(F.transform("c", lambda x: x["context"]), "\n\n").alias("text"), F.lit(dataset).alias("dataset")
    )
    return docs.orderBy("title"), examples


def hotpot_like(rows: DataFrame, max_examples: int | None, seed: int = 42, dataset: str = "hotpot_qa") -> tuple[DataFrame, DataFrame]:
    """rows (id, question, answer, context struct of titles and sentence lists, supporting_facts struct of titles); the first text of a title
    wins; max_examples of None takes all."""
    order = F.col("perm") if "perm" in rows.columns else shuffled("id", seed)
    picked = rows.withColumn("__o", order)
    if max_examples is not None:
        picked = picked.orderBy("__o", "id").limit(max_examples)
    every = picked.select("__o", "id", F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))).alias("i", "d"))
    docs = every.groupBy(F.col("d.title").alias("title")).agg(F.min_by(F.array_join("d.sentences", " "), F.struct("__o", "id", "i")).alias("text"))
    docs = docs.select(F.concat(F.lit("hotpot::"), "title").alias("doc_id"), "title", T.strip("text").alias("text"), F.lit(dataset).alias("dataset"))
    ids = lambda c: F.transform(F.array_sort(F.array_distinct(F.col(c))), lambda t: F.concat(F.lit("hotpot::"), t))
    examples = picked.select(
        F.concat(F.lit("hotpot::"), F.col("id").cast("string")).alias("example_id"), F.lit(dataset).alias("dataset"), "question", F.array("answer").alias("answers"), ids("supporting_facts.title").alias("relevant_doc_ids"),
        F.to_json(F.struct(ids("context.title").alias("candidate_doc_ids"), F.array_sort(F.array_distinct("supporting_facts.title")).alias("supporting_titles"))).alias("metadata"),
    )
    return docs, examples


#: Consecutive words by which a passage and the documents that hold it are joined.
GRAM = 3


def _grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    return T.let(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (k - 1))), lambda i: F.xxhash64(*(F.try_element_at(w, i + j) for j in range(k)))))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents whose text holds the item's text as it is.

    All words of a passage but the outer two lie whole in such a document, so the two are
    joined by the hash of the first GRAM of these inner words and then verified; a passage
    with fewer inner words is joined by as many as it has.  One of at most two words may lie
    within a word, so only such are looked for in every document."""
    words = lambda c: F.split(F.col(c), r"[\x00-\x20]+")
    inner = items.where("text IS NOT NULL").select("item_id", "text", words("text").alias("__w")).withColumn("__k", F.least(F.lit(GRAM), F.size("__w") - 2))
    base = docs.where("text IS NOT NULL").select("doc_id", F.col("text").alias("__t"))
    parts = []
    for k in sorted(r[0] for r in inner.select("__k").distinct().collect()):
        own = inner.where(F.col("__k") == k)
        if k <= 0:
            parts.append(base.join(own, F.contains("__t", "text")).select("doc_id", "item_id"))
            continue
        keyed = own.select("item_id", "text", F.xxhash64(*(F.col("__w")[j] for j in range(1, k + 1))).alias("__h"))
        # only hashes travel until a document and a passage agree in one
        grams = base.where(F.size(words("__t")) >= k).select("doc_id", F.explode(F.array_distinct(_grams(words("__t"), k))).alias("__h"))
        pairs = grams.join(keyed.select("item_id", "__h"), "__h").select("doc_id", "item_id")
        parts.append(pairs.join(own.select("item_id", "text"), "item_id").join(base, "doc_id").where(F.contains("__t", "text")).select("doc_id", "item_id"))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else docs.select("doc_id").crossJoin(items.select("item_id")).limit(0)


def from_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and benchmark tables as a corpus with questions; relevant are the documents that contain the passage."""
    raw = storage.table(spark, sf_dir, "documents")
    docs = raw.select(F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("source").alias("title"), "text", F.col("lang").alias("dataset"))
    items = storage.table(spark, sf_dir, "benchmark")
    relevant = containing(docs, items).groupBy("item_id").agg(F.array_sort(F.collect_set("doc_id")).alias("relevant_doc_ids"))
    examples = items.join(relevant, "item_id", "left").select(
        F.concat(F.lit("q::"), F.col("item_id").cast("string")).alias("example_id"), F.lit("benchmark").alias("dataset"), F.col("text").alias("question"),
        F.array("text").alias("answers"), F.coalesce("relevant_doc_ids", F.array().cast("array<string>")).alias("relevant_doc_ids"), F.lit("{}").alias("metadata"),
    )
    return docs, examples


def load(spark: SparkSession, spec: dict) -> tuple[DataFrame, DataFrame]:
    """By spec {name, path, max_examples, candidate_pool_size, seed, split}; fails before any job on an unknown name."""
    name = spec.get("name")
    if name == "tables":
        return from_tables(spark, spec["path"])
    if name not in ("squad_v2", "hotpot_qa"):
        raise ValueError(f"unknown dataset: {name}")
    path = f"{spec['path']}/{spec.get('split', 'validation')}"
    rows = spark.read.parquet(path)
    most = int(spec.get("max_examples", 50))
    if name == "squad_v2":
        return squad_like(rows, most, spec.get("candidate_pool_size"), spec.get("seed", 42), spec.get("answerable_only", True))
    return hotpot_like(rows, most, spec.get("seed", 42))
