"""Chunkers: a documents DataFrame (doc_id, title, text, dataset) to chunks.

Every chunker gives chunk_id, doc_id, title, dataset, chunk_index, text and
token_count.  chunk_index counts raw pieces, so ids have gaps where a blank piece
was dropped.  Tokens are white-space tokens unless a spec says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestar.functions import text as T

COLUMNS = ["chunk_id", "doc_id", "title", "dataset", "chunk_index", "text", "token_count"]
#: Documents that the recursive chunker holds in pieces at once.
DOCUMENTS = 64
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def finish(docs: DataFrame, name: str, pieces: Column) -> DataFrame:
    """Explodes an array of pieces; the text is stripped, blanks dropped, tokens counted on the stripped text."""
    return _finished(docs.select("doc_id", "title", "dataset", F.posexplode(pieces).alias("chunk_index", "__piece")), name)


def _finished(raw: DataFrame, name: str) -> DataFrame:
    out = raw.withColumn("text", T.strip("__piece")).where("text <> ''")
    return out.withColumn("chunk_id", F.concat_ws("::", F.lit(name), "doc_id", F.col("chunk_index").cast("string"))).withColumn("token_count", T.count_tokens("text")).select(COLUMNS)


def fixed(docs: DataFrame, name: str, chunk_size: int, chunk_overlap: int = 0) -> DataFrame:
    """Windows of chunk_size tokens, the last one the first to reach the end."""
    stride = max(1, chunk_size - chunk_overlap)

    def windows(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - chunk_size) / F.lit(float(stride))).cast("int"))
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * stride + 1, chunk_size), " "))
        return F.when(F.size(w) > 0, each)

    # bound once: the words would otherwise be split anew for every window
    return finish(docs, name, T.let(T.whitespace_tokens("text"), windows))


def _packed(items: Column, size: int, joined: bool) -> Column:
    """Greedy packing: an item starts a new chunk if the current is not empty and would pass size."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(state: Column, item: Column) -> Column:
        n = item["n"]
        full = (state["text"] != "") & (state["n"] + n > size)
        return F.when(full, F.struct(F.concat(state["done"], F.array(state["text"])).alias("done"), item["s"].alias("text"), n.alias("n"))).otherwise(
            F.struct(state["done"].alias("done"), F.when(state["text"] == "", item["s"]).otherwise(F.concat(state["text"], F.lit(" "), item["s"])).alias("text"), (state["n"] + n).alias("n"))
        )

    return F.aggregate(items, start, step, lambda s: F.when(s["text"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["text"]))))


def sentence(docs: DataFrame, name: str, chunk_size: int, **_: object) -> DataFrame:
    """Whole sentences packed up to chunk_size tokens; a longer sentence is a chunk of its own."""
    items = F.transform(T.sentences("text"), lambda s: F.struct(s.alias("s"), T.count_tokens(s).alias("n")))
    return finish(docs, name, _packed(items, chunk_size, True))


def hashed_bag(c: Column, width: int = 64) -> Column:
    """Offline encoder: unit vector of hashed word counts."""
    words = T.lexical_tokens(c)
    spots = F.transform(words, lambda w: F.pmod(F.crc32(w), F.lit(width)).cast("int"))
    counts = lambda w: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(w, lambda s: s == i)).cast("double"))
    return T.let(spots, lambda w: T.unit(counts(w)))


def semantic(docs: DataFrame, name: str, chunk_size: int, similarity_threshold: float = 0.72, min_chunk_tokens: int | None = None, encoder: Callable[[Column], Column] = hashed_bag, **_: object) -> DataFrame:
    """Breaks between neighbouring sentences less alike than the threshold, once min_chunk_tokens are there, and at chunk_size.

    min_chunk_tokens of 0 or None means max(32, chunk_size // 2)."""
    least = min_chunk_tokens or max(32, chunk_size // 2)
    # sentences are exploded to be encoded once each and gathered again per document
    one = docs.select("doc_id", "title", "dataset", F.posexplode(T.sentences("text")).alias("i", "s")).withColumn("v", encoder(F.col("s"))).withColumn("n", T.count_tokens("s"))
    return semantic_from_vectors(one, name, chunk_size, similarity_threshold, least)


def semantic_from_vectors(rows: DataFrame, name: str, chunk_size: int, similarity_threshold: float, least: int) -> DataFrame:
    """rows: a sentence each, with i, s, its unit vector v and token count n."""
    listed = rows.groupBy("doc_id", "title", "dataset").agg(F.array_sort(F.collect_list(F.struct("i", "s", "v", "n"))).alias("__a"))
    n = F.size("__a")
    alike = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, F.lit(2.0)).otherwise(T.dot(F.col("__a")[F.greatest(i - 1, F.lit(0))]["v"], F.col("__a")[i]["v"])))
    listed = listed.withColumn("__items", F.zip_with("__a", alike, lambda x, sim: F.struct(x["s"].alias("s"), x["n"].alias("n"), sim.alias("sim"))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(state: Column, item: Column) -> Column:
        cut = (state["text"] != "") & (((item["sim"] < similarity_threshold) & (state["n"] >= least)) | (state["n"] + item["n"] > chunk_size))
        fresh = F.struct(F.concat(state["done"], F.array(state["text"])).alias("done"), item["s"].alias("text"), item["n"].alias("n"))
        longer = F.struct(state["done"].alias("done"), F.when(state["text"] == "", item["s"]).otherwise(F.concat(state["text"], F.lit(" "), item["s"])).alias("text"), (state["n"] + item["n"]).alias("n"))
        return F.when(cut, fresh).otherwise(longer)

    pieces = F.aggregate("__items", start, step, lambda s: F.when(s["text"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["text"]))))
    return finish(listed, name, pieces)


def split_recursive(text: str, size: int, overlap: int, count: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Splits at the first separator present, which stays with the piece after it; longer pieces are split by the next ones; short ones are merged up to size, with overlap from the end of the piece before."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        cut = text.split(sep)
        parts = [p for p in [cut[0], *(sep + x for x in cut[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[tuple[str, int]] = []

    def merge() -> None:
        current: list[tuple[str, int]] = []
        total = 0
        for piece, n in held:
            if current and total + n > size:
                out.append("".join(p for p, _ in current).strip())
                while current and (total > overlap or total + n > size):
                    total -= current.pop(0)[1]
            current.append((piece, n))
            total += n
        if current:
            out.append("".join(p for p, _ in current).strip())
        held.clear()

    for p in parts:
        n = count(p)
        if n < size or (n == size and not rest):
            held.append((p, n))
        else:
            merge()
            out.extend(split_recursive(p, size, overlap, count, rest) if rest else [p.strip()])
    merge()
    return [x for x in out if x]


def recursive(docs: DataFrame, name: str, chunk_size: int, chunk_overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, **_: object) -> DataFrame:
    """Paragraphs, then lines, sentences, words and characters; in Python, as the recursion has no built-in form.

    Few documents are taken out of an Arrow batch at a time, and their pieces sent on."""
    kept = ["doc_id", "title", "dataset"]
    kind = StructType([*(docs.schema[c] for c in kept), StructField("chunk_index", IntegerType()), StructField("__piece", StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, DOCUMENTS) for i in range(0, big.num_rows, DOCUMENTS)):
                found = [split_recursive(t or "", chunk_size, chunk_overlap, lambda x: len(x.split()), separators) for t in b["text"].to_pylist()]
                at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int32())
                index = pa.array([j for x in found for j in range(len(x))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in kept), index, pa.array([p for x in found for p in x], b["text"].type)], names=kind.names)

    return _finished(docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(rows, kind), name)


def _library(docs: DataFrame, name: str, make: Callable[[], Callable[[str], list[tuple[str, int]]]]) -> DataFrame:
    """Chunks of a third-party library, with its token counts and its index over raw chunks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = make()
        for b in batches:
            out = [(f"{name}::{r.doc_id}::{i}", r.doc_id, r.title, r.dataset, i, t.strip(), n) for r in b.itertuples() for i, (t, n) in enumerate(split(r.text or "")) if t.strip()]
            yield pd.DataFrame(out, columns=COLUMNS)

    return docs.select("doc_id", "title", "dataset", "text").mapInPandas(rows, "chunk_id string, doc_id string, title string, dataset string, chunk_index int, text string, token_count int")


def _chonkie():
    try:
        import chonkie
    except ImportError as e:
        raise ImportError("this chunker needs the optional package chonkie") from e
    return chonkie


def library_recursive(docs: DataFrame, name: str, chunk_size: int, **_: object) -> DataFrame:
    _chonkie()

    def make() -> Callable[[str], list[tuple[str, int]]]:
        c = _chonkie().RecursiveChunker(chunk_size=chunk_size, min_characters_per_chunk=24)
        return lambda t: [(x.text, x.token_count) for x in c.chunk(t)]

    return _library(docs, name, make)


def library_semantic(docs: DataFrame, name: str, chunk_size: int, similarity_threshold: float = 0.7, similarity_window: int = 3, skip_window: int = 0, min_sentences: int = 1, embedding_model: str = "sentence-transformers/all-MiniLM-L6-v2", **_: object) -> DataFrame:
    _chonkie()

    def make() -> Callable[[str], list[tuple[str, int]]]:
        c = _chonkie().SemanticChunker(embedding_model=embedding_model, chunk_size=chunk_size, threshold=similarity_threshold, similarity_window=similarity_window, skip_window=skip_window, min_sentences_per_chunk=min_sentences)
        return lambda t: [(x.text, x.token_count) for x in c.chunk(t)]

    return _library(docs, name, make)


REGISTRY: dict[str, Callable[..., DataFrame]] = {"fixed": fixed, "recursive": recursive, "sentence": sentence, "semantic": semantic, "chonkie_recursive": library_recursive, "chonkie_semantic": library_semantic}


def build(docs: DataFrame, spec: dict) -> DataFrame:
    """Chunks by a spec {name, type, chunk_size, ...}; fails before any job on an unknown type."""
    kind = spec.get("type")
    if kind not in REGISTRY:
        raise ValueError(f"unknown chunker type: {kind}")
    if int(spec.get("chunk_size", 1)) < 1:
        raise ValueError("chunk_size must be positive")
    options = {k: v for k, v in spec.items() if k not in ("name", "type")}
    return REGISTRY[kind](docs, spec.get("name", f"{kind}_{spec.get('chunk_size')}"), **options)


def spec(kind: str, chunk_size: int, chunk_overlap: int = 0, similarity_threshold: float = 0.72) -> dict:
    """Spec of the live mode: overlap only where it is used, the threshold only for semantic."""
    extra = {"chunk_overlap": chunk_overlap} if kind in ("fixed", "recursive") else {"similarity_threshold": similarity_threshold} if kind == "semantic" else {}
    return {"name": f"{kind}_{chunk_size}", "type": kind, "chunk_size": chunk_size, **extra}


def window_count(n: int, size: int, overlap: int) -> int:
    """How many fixed windows n tokens make."""
    return 0 if n == 0 else 1 + max(0, math.ceil((n - size) / max(1, size - overlap)))
