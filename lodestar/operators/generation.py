"""Generators: columns or DataFrame functions from question and context to an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T

NO_CONTEXT = "I do not have grounded context yet."
NO_MESSAGE = "I do not have a user message yet."


@runtime_checkable
class Generator(Protocol):
    """What a pluggable model offers; instances are made once in each Python worker."""

    def answer(self, question: str, context: str | None = None) -> str: ...

    def chat(self, messages: list[dict[str, str]]) -> str: ...


def extractive_answer(question: Column | str, context: Column | str, most: int = 3, characters: int = 360) -> Column:
    """The sentences of the context that share most terms with the question, in their order; the default, deterministic generator."""
    q, c = T.col(question), F.coalesce(T.col(context), F.lit(""))
    lines = F.filter(F.transform(F.split(c, r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), T.strip), lambda x: (x != "") & ~x.rlike(r"(?i)^(?:matched queries:|title:|\[\d+\]\s+title:)"))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^#+\s*", ""), r"^[-*]\s*", ""))
    terms = F.filter(F.array_distinct(T.lexical_tokens(q)), lambda t: F.length(t) > 2)

    def rated(terms: Column):
        def one(s: Column, i: Column) -> Column:
            words = F.array_distinct(T.lexical_tokens(s))
            part = T.let(F.lower(s), lambda low: F.exists(terms, lambda t: F.contains(low, t)))
            return F.struct((-(F.size(F.array_intersect(terms, words)) + F.when(part, 0.2).otherwise(0.0))).alias("neg"), i.alias("i"), s.alias("s"), F.size(words).alias("n"))

        return one

    def best(x: Column) -> Column:
        every = T.let(x["terms"], lambda terms: F.transform(x["found"], rated(terms)))
        plain = F.transform(x["found"], lambda s, i: F.struct(F.lit(-0.0).alias("neg"), i.alias("i"), s.alias("s"), F.lit(0).alias("n")))
        chosen = T.let(F.filter(every, lambda y: y["n"] >= 4), lambda long: F.slice(F.array_sort(F.when(F.size(long) > 0, long).otherwise(plain)), 1, most))
        ordered = F.array_sort(F.transform(chosen, lambda y: F.struct(y["i"].alias("i"), y["s"].alias("s"))))
        text = F.array_join(F.transform(ordered, lambda y: y["s"]), " ")
        return F.when(F.size(x["found"]) == 0, F.substring(T.strip(x["cleaned"]), 1, characters)).otherwise(T.strip(F.substring(text, 1, characters)))

    cleaned = T.let(lines, lambda a: F.when(F.size(a) > 0, F.array_join(a, ". ")).otherwise(c))
    answer = T.let(cleaned, lambda t: T.let(F.struct(t.alias("cleaned"), T.sentences(t).alias("found"), terms.alias("terms")), best))
    return F.when(c == "", NO_CONTEXT).otherwise(answer)


def extractive_chat(messages: Column | str) -> Column:
    said = F.filter(T.col(messages), lambda m: (m["role"] == "user") & (m["content"] != ""))
    return F.when(F.size(said) == 0, NO_MESSAGE).otherwise(NO_CONTEXT)


def extractive(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prediction", extractive_answer("question", "context"))


def with_model(rows: DataFrame, make: Callable[[], Generator], post: Callable[[str, str], str] | None = None) -> DataFrame:
    """Answers by a model, loaded once a Python worker; make must be picklable."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        g = make()
        for question, context in parts:
            yield pd.Series([(post or (lambda q, a: a))(q, g.answer(q, None if c is None or c == "" else c)) for q, c in zip(question, context, strict=True)], dtype=object)

    return rows.withColumn("prediction", ask("question", "context"))


class LocalModel:
    """A local sequence model by the optional transformers package, greedy decoding, the prompt cut to its token bound."""

    def __init__(self, name: str, device: str = "cpu", most_input: int = 1024, most_new: int = 32):
        try:
            from transformers import AutoModelForSeq2SeqLM, AutoTokenizer
        except ImportError as e:
            raise ImportError("local models need the optional package transformers") from e
        self.tokenizer, self.model = AutoTokenizer.from_pretrained(name), AutoModelForSeq2SeqLM.from_pretrained(name).to(device)
        self.device, self.most_input, self.most_new = device, most_input, most_new

    def _run(self, prompt: str) -> str:
        x = self.tokenizer(prompt, return_tensors="pt", truncation=True, max_length=self.most_input).to(self.device)
        return self.tokenizer.decode(self.model.generate(**x, max_new_tokens=self.most_new, do_sample=False)[0], skip_special_tokens=True).strip()

    def answer(self, question: str, context: str | None = None) -> str:
        head = f"Use the passages below and nothing else. Say 'unanswerable' if they do not settle it.\n\nPassages:\n{context}\n\n" if context else "Give the shortest answer.\n\n"
        return self._run(f"{head}Question: {question}\n\nAnswer:")

    def chat(self, messages: list[dict[str, str]]) -> str:
        return self._run("\n".join(f"{m['role'].capitalize()}: {m['content']}" for m in messages) + "\nAssistant:")


def fit_context(context: Column | str, question: Column | str, most_tokens: int, overhead: int = 40) -> Column:
    """The longest beginning of the context, in white-space tokens, that leaves the prompt within most_tokens."""
    words = T.whitespace_tokens(context)
    room = F.greatest(F.lit(0), most_tokens - overhead - T.count_tokens(question))
    return F.when(F.size(words) <= room, T.col(context)).otherwise(F.array_join(F.slice(words, F.lit(1), room), " "))


def endpoint(rows: DataFrame, complete: Callable[[], Callable[[list[dict[str, str]], int], str]], most_tokens: int = 1024, most_new: int = 128) -> DataFrame:
    """Answers by a chat endpoint: draft, normalise, a shorter second call for drafts that need it, compress.

    complete makes, once a worker, a client (messages, most new tokens) -> text.  The gate splits the
    rows, so that the second call is made for those alone; drafts are drawn in one pass and not again."""

    def call(column: str, limit: int):
        @F.pandas_udf("string")
        def said(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = complete()
            for p in parts:
                yield pd.Series([None if m is None else client([dict(x) for x in m], limit) for m in p], dtype=object)

        return said.asNondeterministic()(F.col(column))

    x = rows.withColumn("__context", fit_context("context", "question", most_tokens)).withColumn("__messages", T.chat_messages("question", "__context"))
    x = x.withColumn("__draft", T.normalize_response(F.coalesce(call("__messages", most_new), F.lit(""))))
    x = x.withColumn("__again", F.when(T.should_refine("__draft"), T.refinement_messages("question", "__draft", "__context")))
    x = x.withColumn("__short", T.normalize_response(F.coalesce(call("__again", min(24, most_new)), F.lit(""))))
    best = F.when(F.col("__again").isNull() | F.col("__short").isin("", "unanswerable"), F.col("__draft")).otherwise(F.col("__short"))
    return x.withColumn("prediction", T.compress_answer("question", T.normalize_response(best))).drop("__context", "__messages", "__draft", "__again", "__short")


def openai_client(model: str, base_url: str, api_key: str, temperature: float = 0.0) -> Callable[[], Callable[[list[dict[str, str]], int], str]]:
    def make() -> Callable[[list[dict[str, str]], int], str]:
        try:
            from openai import OpenAI
        except ImportError as e:
            raise ImportError("chat endpoints need the optional package openai") from e
        client = OpenAI(base_url=base_url, api_key=api_key)
        return lambda messages, most: client.chat.completions.create(model=model, messages=messages, temperature=temperature, max_tokens=most).choices[0].message.content or ""

    return make


def resolve_device(wanted: str = "auto", mps: bool = False, cuda: bool = False) -> str:
    return wanted if wanted != "auto" else "mps" if mps else "cuda" if cuda else "cpu"


def resolve_dtype(name: str) -> str:
    if name not in ("auto", "float32", "float16", "bfloat16"):
        raise ValueError(f"unknown dtype: {name}")
    return name


def seeds_of(config: dict) -> list[int]:
    return [int(s) for s in config["seeds"]] if config.get("seeds") else [int(config.get("seed") or 42)]
