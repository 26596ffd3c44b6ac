"""Uploaded files to documents: text, PDF, CSV, TSV and JSON, by suffix.

Files come as binaryFile rows (path, content), so they are read in parallel; ids
are upload::<slug of the stem>[::<row>] and not made unique across files.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.schemas import DOCUMENT

_FIELDS = ["doc_id", "title", "text", "dataset"]


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return files.select(F.try_url_decode(stem).alias("stem") if False else stem.alias("stem"), F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)).alias("suffix"), "content", name.alias("name"))


def texts(files: DataFrame) -> DataFrame:
    """One document a file that is not blank."""
    named = _named(files).withColumn("text", T.strip(T.decode_bytes("content"))).where("text <> ''")
    return named.select(F.concat(F.lit("upload::"), T.sanitize_identifier("stem")).alias("doc_id"), F.col("stem").alias("title"), "text", F.lit("uploaded").alias("dataset"))


def slug(stem: str) -> str:
    return re.sub("[^a-z0-9]+", "-", stem.strip().lower()).strip("-") or "document"


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def csv_documents(name: str, data: bytes) -> Iterator[tuple[str, str, str, str]]:
    """All cells are strings as written; the row number of a record is 0-based in ids and 1-based in titles."""
    stem = PurePosixPath(name).stem
    records = list(csv.reader(io.StringIO(decode(data).lstrip("﻿")), delimiter="\t" if name.lower().endswith(".tsv") else ","))
    records = [r for r in records if r]
    head = records[0] if records else []
    for i, record in enumerate(records[1:]):
        cells = dict(zip(head, record + [""] * (len(head) - len(record)), strict=False))
        text = cells["text"].strip() if "text" in cells else " ".join(f"{k}: {v}" for k, v in cells.items() if v.strip())
        if text:
            yield f"upload::{slug(stem)}::{i}", cells["title"].strip() if "title" in cells else f"{stem} row {i + 1}", text, "uploaded"


def json_documents(name: str, data: bytes) -> Iterator[tuple[str, str, str, str]]:
    stem = PurePosixPath(name).stem
    value = json.loads(decode(data))
    dump = lambda x: json.dumps(x, ensure_ascii=False, indent=2)

    def body(x: dict) -> str:
        return str(x.get("text") or x.get("content") or "").strip()

    if isinstance(value, list):
        for i, x in enumerate(value):
            title = f"{stem} item {i + 1}"
            text = (body(x) or dump(x)) if isinstance(x, dict) else str(x).strip()
            if text:
                yield f"upload::{slug(stem)}::{i}", str(x.get("title") or title) if isinstance(x, dict) else title, text, "uploaded"
    elif isinstance(value, dict):
        text = body(value)
        yield f"upload::{slug(stem)}", str(value.get("title") or stem) if text else stem, text or dump(value), "uploaded"
    elif decode(data).strip():
        yield f"upload::{slug(stem)}", stem, decode(data).strip(), "uploaded"


def pdf_documents(name: str, data: bytes) -> Iterator[tuple[str, str, str, str]]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("PDF files need the optional package pypdf") from e
    text = "\n\n".join(t for t in ((p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages) if t)
    stem = PurePosixPath(name).stem
    if text:
        yield f"upload::{slug(stem)}", stem, text, "uploaded"


def _parsed(files: DataFrame, parse) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([d for n, c in zip(b["name"], b["content"], strict=True) for d in parse(unquote(n), bytes(c))], columns=_FIELDS)

    return files.select("name", "content").mapInPandas(rows, DOCUMENT)


def documents(files: DataFrame) -> DataFrame:
    """Documents of all files; every branch reads only the files of its suffixes."""
    named = _named(files)
    of = lambda *s: named.where(F.col("suffix").isin(*s))
    other = files.where(~F.lower("path").rlike(r"\.(pdf|csv|tsv|json)$"))
    out = texts(other)
    for suffixes, parse in (((".csv", ".tsv"), csv_documents), ((".json",), json_documents), ((".pdf",), pdf_documents)):
        out = out.unionByName(_parsed(of(*suffixes), parse))
    return out


def read(spark: SparkSession, *paths: str) -> DataFrame:
    return documents(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "content"))


def pasted(spark: SparkSession, text: str, name: str = "pasted_notes.txt") -> DataFrame:
    return documents(spark.createDataFrame([(name, bytearray(text, "utf-8"))], "path string, content binary"))


def corpora(spark: SparkSession, chosen: list[str], known: dict[str, str]) -> DataFrame:
    """Built-in corpora by label; labels without a file are passed over."""
    from pathlib import Path

    paths = [known[c] for c in chosen if c in known and Path(known[c]).exists()]
    return read(spark, *paths) if paths else spark.createDataFrame([], DOCUMENT)


def payload_digest(files: DataFrame, settings: dict) -> DataFrame:
    """One row: a digest of the payloads, whatever their order, and of the settings."""
    each = files.select(F.sha2(F.concat_ws("\x00", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)), 256).alias("h"))
    return each.agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("h")), ""), F.lit(json.dumps(settings, sort_keys=True))), 256).alias("digest"))
