"""Evidence of questions: compression to a token budget, diversity, context and citations.

Evidence rows have question_id, question, rank, chunk_id, doc_id, title, text,
score, raw_score and matched_queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.chunking import hashed_bag


def _picked(rated: Column, budget: Column, most: int) -> Column:
    """Fold over sentences by score: the first is always taken, later ones that overflow are skipped."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))

    def step(state: Column, x: Column) -> Column:
        size = F.size(state["at"])
        take = (size < most) & ((size == 0) | (state["n"] + x["n"] <= budget))
        return F.when(take, F.struct(F.concat(state["at"], F.array(x["i"])).alias("at"), (state["n"] + x["n"]).alias("n"))).otherwise(state)

    return F.array_sort(F.aggregate(rated, start, step)["at"])


def compress(evidence: DataFrame, total_budget: int = 384, most: int = 3, encoder: Callable[[Column], Column] = hashed_bag) -> DataFrame:
    """Adds compressed_text, selected_sentences, support_score and compression_ratio; items after the budget is spent go.

    The budget is shared by a fold over the ranked items of a question, of which there are few."""
    whole = max(total_budget, 64)
    # every sentence is encoded once, before the fold
    rate = lambda q: F.transform(T.sentences("text"), lambda s, i: F.struct(i.alias("i"), s.alias("s"), T.count_tokens(s).alias("n"), F.round(T.dot(encoder(s), q), 9).alias("score")))
    items = evidence.withColumn("__s", T.let(encoder(F.col("question")), rate))
    packed = items.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("__s").alias("s"), F.col("text").alias("text")))).alias("e"))
    share = F.greatest(F.lit(48), F.floor(F.lit(whole) / F.greatest(F.lit(1), F.size("e"))).cast("int"))
    kind = "array<struct<rank:int,text:string,sentences:array<string>,support:double,ratio:double>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(whole).alias("left"))

    def step(state: Column, x: Column) -> Column:
        rated = F.transform(F.array_sort(F.transform(x["s"], lambda y: F.struct((-y["score"]).alias("neg"), y["i"].alias("i"), y["n"].alias("n")))), lambda y: F.struct(y["i"].alias("i"), y["n"].alias("n")))
        text = lambda p: F.when(F.size(x["s"]) > 1, F.array_join(p["chosen"], " ")).otherwise(T.strip(x["text"]))

        def add(p: Column) -> Column:
            many, n = F.size(x["s"]) > 1, T.count_tokens(p["text"])
            row = F.struct(
                x["rank"].cast("int").alias("rank"), p["text"].alias("text"), F.when(many, p["chosen"]).when(p["text"] != "", F.array(p["text"])).otherwise(F.array().cast("array<string>")).alias("sentences"),
                F.when(many, F.aggregate(p["scores"], F.lit(0.0), lambda a, b: a + b) / F.size(p["scores"])).otherwise(1.0).alias("support"),
                F.when(many, n / F.greatest(T.count_tokens(x["text"]), F.lit(1))).otherwise(1.0).alias("ratio"),
            )
            return F.when((state["left"] > 0) & (n > 0), F.struct(F.concat(state["out"], F.array(row)).alias("out"), (state["left"] - n).alias("left"))).otherwise(state)

        at = _picked(rated, F.least(share, state["left"]), most)
        parts = T.let(at, lambda at: F.struct(F.transform(at, lambda i: x["s"][i]["s"]).alias("chosen"), F.transform(at, lambda i: x["s"][i]["score"]).alias("scores")))
        return T.let(parts, lambda p: T.let(F.struct(p["chosen"].alias("chosen"), p["scores"].alias("scores"), text(p).alias("text")), add))

    folded = packed.select("question_id", F.explode(F.aggregate("e", start, step)["out"]).alias("o"))
    flat = folded.select("question_id", F.col("o.rank").alias("rank"), F.col("o.text").alias("compressed_text"), F.col("o.sentences").alias("selected_sentences"), F.col("o.support").alias("support_score"), F.col("o.ratio").alias("compression_ratio"))
    joined = evidence.join(flat, ["question_id", "rank"])
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def uncompressed(evidence: DataFrame) -> DataFrame:
    return evidence.withColumns({"compressed_text": F.lit(""), "selected_sentences": F.array().cast("array<string>"), "support_score": F.lit(0.0), "compression_ratio": F.lit(1.0)})


def head(evidence: DataFrame, k: int) -> DataFrame:
    return evidence.where(F.col("rank") <= k)


def diverse(evidence: DataFrame, k: int) -> DataFrame:
    """The best item of each document first, then the others, by rank; k of them."""
    again = F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy("rank")) > 1
    w = Window.partitionBy("question_id").orderBy("__again", "__rank")
    return evidence.withColumn("__again", again).withColumn("__rank", F.col("rank")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__again", "__rank")


def _block(x: Column, compressed: bool) -> Column:
    text = F.when((x["compressed_text"] != ""), x["compressed_text"]).otherwise(x["text"]) if compressed else x["text"]
    return F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] Title: "), x["title"], F.lit("\nMatched queries: "), F.array_join(F.slice(x["matched_queries"], 1, 2), ", "), F.lit("\n"), text)


def contexts(evidence: DataFrame, compressed: bool) -> DataFrame:
    """(question_id, context, evidence texts): numbered blocks with title and matched queries."""
    need = ["rank", "title", "matched_queries", "text", "compressed_text"]
    e = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(*need))).alias("e"))
    used = F.transform("e", lambda x: F.when(x["compressed_text"] != "", x["compressed_text"]).otherwise(x["text"]))
    return e.select("question_id", F.array_join(F.transform("e", lambda x: _block(x, compressed)), "\n\n").alias("context"), used.alias("evidence_texts"))


def experiment_context(hits: DataFrame, title_only: bool = False) -> DataFrame:
    """(question_id, context) of hits (question_id, rank, title, doc_id, text); titles are shown for datasets that need them."""
    shown = F.coalesce(T.blank_to_null(F.col("title")), F.col("doc_id"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat(shown, F.lit(": ")) if title_only else F.lit(""), F.col("text"))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def citations(evidence: DataFrame) -> DataFrame:
    snippet = T.strip(F.coalesce(F.try_element_at("selected_sentences", F.lit(1)), F.col("text")))
    return evidence.select("question_id", F.col("rank").alias("index"), "title", "doc_id", F.substring(snippet, 1, 280).alias("snippet"), "matched_queries", F.round("score", 4).alias("score"), F.round("support_score", 4).alias("support_score"), F.round("compression_ratio", 4).alias("compression_ratio"))
