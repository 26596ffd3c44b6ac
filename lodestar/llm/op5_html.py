"""Operator 5, HTML extraction as a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative,
and the content is the contiguous region of the highest sum, found in one scan.
The weights are log ratios of how often a word, or a tag of some name, falls
inside and outside the content of labelled pages: with them the region of the
highest sum is the most likely one.  Words are held to at least FLOOR and tags to
at most -FLOOR; a tag seen too rarely to tell takes the mean of all tags.

Labelled pages are those that mark their content with one article or main
element.  These tags themselves have no weight, so that the region is found as
well on pages without them.  Weights are fitted on at most LABELLED pages, the
first by hash of url and page_id.

Defined cases: a null or empty page, or one without words, gives an empty text
and null places; scripts, styles, templates, the head and comments hold no words; an
unclosed one reaches to the end; very long pages are read whole; of equal sums (ties) the
first, shortest region is taken; without any labelled page DEFAULT weights hold; repeated pages are each
extracted; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LABELLED = 1000
FLOOR = 0.05
RARE = 5
DEFAULT = {"": 0.3, "*": -3.0}
_LABEL = {"article", "main"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?([a-zA-Z][a-zA-Z0-9]*)[^<>]*>?|<[!?][^>]*>?", re.S | re.I)
_BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article main blockquote pre header footer nav aside".split())
_OUT = "text string, n_words long, score double, begin long, until long"


def parts(page: str) -> list[tuple[str, int, int]]:
    """(name, from, to) of tags, name '' for text between them, in order."""
    out, at = [], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            out.append(("", at, m.start()))
        if m.group(2):
            out.append((m.group(2).lower(), m.start(), m.end()))
        at = m.end()
    if at < len(page):
        out.append(("", at, len(page)))
    return out


def fit(pages: list[str | None]) -> dict[str, float]:
    """Weight of a word under '', of tags by name, and of all other tags under '*'."""
    inside, outside = Counter(), Counter()
    for page in pages:
        found = parts(page or "")
        marks = [i for i, (name, _, _) in enumerate(found) if name in _LABEL]
        if len(marks) != 2:
            continue
        for i, (name, a, z) in enumerate(found):
            if name not in _LABEL:
                (inside if marks[0] < i < marks[1] else outside)[name] += 1 if name else len(page[a:z].split())
    if not inside[""] or not outside:
        return dict(DEFAULT)
    total_in, total_out = sum(inside.values()), sum(outside.values())

    def ratio(n: int, m: int) -> float:
        return math.log((n + 0.5) / (total_in + 1)) - math.log((m + 0.5) / (total_out + 1))

    tags = [t for t in inside.keys() | outside.keys() if t]
    weights = {t: min(-FLOOR, ratio(inside[t], outside[t])) for t in sorted(tags) if inside[t] + outside[t] >= RARE}
    weights[""] = max(FLOOR, ratio(inside[""], outside[""]))
    weights["*"] = min(-FLOOR, sum(v for t, v in weights.items() if t) / max(1, len(weights) - 1))
    return weights


def best(scores: list[float]) -> tuple[int, int, float]:
    """The half-open range of the greatest sum above 0; of several the first to end, and its shortest."""
    top = (0, 0, 0.0)
    start, total = 0, 0.0
    for i, s in enumerate(scores):
        if total <= 0:
            start, total = i, 0.0
        total += s
        if total > top[2]:
            top = (start, i + 1, total)
    return top


def extract(page: str | None, weights: dict[str, float]) -> tuple:
    found = parts(page or "")
    counts = [0 if name else len(page[a:z].split()) for name, a, z in found]
    a, z, score = best([n * weights[""] if not name else 0.0 if name in _LABEL else weights.get(name, weights["*"]) for (name, _, _), n in zip(found, counts, strict=True)])
    if a == z:
        return "", 0, 0.0, None, None
    lines = [""]
    for name, b, e in found[a:z]:
        if not name:
            lines[-1] += page[b:e]
        elif name in _BLOCK:
            lines.append("")
    text = "\n".join(t for t in (" ".join(entities.unescape(x).split()) for x in lines) if t)
    return text, sum(counts[a:z]), score, found[a][1], found[z - 1][2]


def labelled(pages: DataFrame, bound: int = LABELLED) -> list[str]:
    some = pages.select("html", "url", "page_id").where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    return [r["html"] for r in common.first_by_hash(some, bound, "url", "page_id", "html").collect()]


def content(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    @F.pandas_udf(_OUT)
    def region(page: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([extract(p, weights) for p in page], columns=[c.split()[0] for c in _OUT.split(", ")])
        return out.astype({"begin": "Int64", "until": "Int64"})

    return pages.select("page_id", "url", region("html").alias("r")).select("page_id", "url", "r.*")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return content(pages, fit(labelled(pages)))
