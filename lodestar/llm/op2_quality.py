"""Operator 2, quality classifier: a sparse ensemble of rules.

Statistics of each text are Spark column expressions.  Small regression trees,
boosted on a bounded sample of labelled documents, give conjunctive rules, one
for each path from a root to a node below it; lasso-penalised logistic
regression (FISTA) over all rules picks few of them with weights, and these are
compiled into one Spark column expression that scores every document.

The sample is the first SAMPLE labelled documents by hash of doc_id, a documented
bound; of these a fifth is held out.  A document is kept if its score reaches
the threshold: the greatest at which KEPT of the held-out good documents stay,
but at most CEILING.

Defined cases: null or blank text has statistics 0 and is scored like any other;
texts are measured whole, however long; a score that ties with the threshold is kept;
label rows without doc_id or quality are not used, of several of one document the greatest
quality is, and of several texts under a labelled doc_id the features that sort first; without labels of both kinds every document scores 1
and is kept; repeated rows are each scored, alike; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 10_000
TREES = 40
DEPTH = 3
BINS = 32
LEAF = 20
KEPT = 0.995
CEILING = 0.5
#: Penalties tried from the greatest; the first within one standard error of the least held-out loss is taken.
PENALTIES = (0.03, 0.01, 0.003, 0.001)
FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "repeats", "distinct_words", "line_words", "repeated_lines", "longest_word", "ends_with_stop")


def statistics(text: Column) -> list[tuple[str, Column]]:
    """Steps of named columns; a later one refers to earlier ones by name."""
    t = F.coalesce(text, F.lit(""))
    c, n = F.col, F.greatest
    one = F.lit(1.0)
    return [
        ("__chars", F.length(t)),
        ("__words", F.filter(F.split(t, r"[\x00-\x20]+"), lambda w: w != "")),
        ("__lines", F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")),
        # what is left once lower-case letters and blanks are gone is short
        ("__rest", F.regexp_replace(t, r"[\p{Ll}\x00-\x20]+", "")),
        ("__marks", F.regexp_replace(F.col("__rest"), r"[\p{L}\p{N}]+", "")),
        ("__digits", F.length("__rest") - F.length(F.regexp_replace("__rest", r"\p{Nd}+", ""))),
        ("__n", F.size("__words")),
        ("__letters", F.length(F.array_join("__words", ""))),
        ("log_words", F.log1p(c("__n").cast("double"))),
        ("word_length", c("__letters") / n(one, c("__n"))),
        ("upper", (F.length("__rest") - F.length("__marks") - c("__digits")) / n(one, c("__letters"))),
        ("digits", c("__digits") / n(one, c("__letters"))),
        ("symbols", F.length(F.regexp_replace("__marks", r"[.,;:'?()\"-]+", "")) / n(one, c("__n"))),
        ("repeats", F.length("__marks") / n(one, c("__n"))),
        ("distinct_words", F.size(F.array_distinct(F.transform("__words", F.lower))) / n(one, F.sqrt(c("__n").cast("double")))),
        ("line_words", c("__n") / n(one, F.size("__lines"))),
        ("repeated_lines", 1 - F.size(F.array_distinct("__lines")) / n(one, F.size("__lines"))),
        ("longest_word", F.coalesce(F.array_max(F.transform("__words", F.length)), F.lit(0)).cast("double")),
        ("ends_with_stop", F.when(F.substring(F.rtrim(t), -1, 1).isin(".", "!", "?", '"'), 1.0).otherwise(0.0)),
    ]


def measured(docs: DataFrame) -> DataFrame:
    x = docs.select("doc_id", F.col("text").alias("__text"))
    for name, column in statistics(F.col("__text")):
        x = x.withColumn(name, column)
    return x.select("doc_id", *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))


Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[tuple[Rule, np.ndarray]]) -> None:
    """Splits rows by the greatest gain in squared error; each node below the root is a rule."""
    if path:
        out.append((path, rows))
    if depth == 0 or len(rows) < 2 * LEAF:
        return
    y, best = target[rows], (1e-9, -1, -1)
    total, n = y.sum(), len(rows)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        c = codes[rows, f]
        count = np.bincount(c, minlength=len(e) + 1).cumsum()[:-1]
        part = np.bincount(c, weights=y, minlength=len(e) + 1).cumsum()[:-1]
        ok = (count >= LEAF) & (n - count >= LEAF)
        if not ok.any():
            continue
        gain = np.where(ok, part**2 / np.maximum(count, 1) + (total - part) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    _, f, k = best
    if f < 0:
        return
    low = codes[rows, f] <= k
    for side, some in ((False, rows[low]), (True, rows[~low])):
        _grow(x, codes, edges, target, some, depth - 1, (*path, (f, side, float(edges[f][k]))), out)


def rules_of(x: np.ndarray, y: np.ndarray, seed: int = 2) -> list[Rule]:
    """Distinct rules of boosted trees; a condition (feature, above, limit) holds where value > limit is above."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] if len(x) else e for f, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    rng, score, found = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        rows = np.sort(rng.permutation(len(y))[: max(2 * LEAF, len(y) // 2)])
        residual = y - 1 / (1 + np.exp(-score))
        nodes: list[tuple[Rule, np.ndarray]] = []
        _grow(x, codes, edges, residual, rows, int(rng.integers(2, DEPTH + 1)), (), nodes)
        for rule, own in nodes:
            found.setdefault(tuple(sorted(set(rule))), None)
            if not any(len(r) > len(rule) and r[: len(rule)] == rule for r, _ in nodes):
                score[holds(x, rule)] += 0.3 * residual[own].sum() / max(1e-6, (1 / (1 + np.exp(-score[own])) * (1 - 1 / (1 + np.exp(-score[own])))).sum())
    return list(found)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, limit in rule:
        out &= (x[:, f] > limit) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalties: tuple[float, ...] = PENALTIES, steps: int = 150) -> list[tuple[float, np.ndarray]]:
    """For each penalty, intercept and weights of the least logistic loss plus penalty * |w|, by FISTA from the solution before; columns are scaled to unit deviation."""
    mean, scale = z.mean(0), np.maximum(z.std(0), 1e-3)
    s = ((z - mean) / scale).astype(np.float32)
    y = y.astype(np.float32)
    v = np.random.default_rng(3).normal(size=s.shape[1]).astype(np.float32)
    for _ in range(20):  # greatest eigenvalue of s's / n
        v = s.T @ (s @ v)
        v /= max(1e-12, np.linalg.norm(v))
    rate = np.float32(4 / (1 + np.linalg.norm(s @ v) ** 2 / len(s)))
    w, b, out = np.zeros(s.shape[1], np.float32), np.float32(0), []
    for penalty in penalties:
        uw, ub, t = w, b, 1.0
        for _ in range(steps):
            r = 1 / (1 + np.exp(-(s @ uw + ub))) - y
            nw = uw - rate * (s.T @ r) / len(y)
            nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * np.float32(penalty), 0)
            nb = ub - rate * r.mean()
            nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            f = np.float32((t - 1) / nt)
            uw, ub = nw + f * (nw - w), nb + f * (nb - b)
            w, b, t = nw, nb, nt
        out.append((float(b - mean @ (w / scale)), w / scale))
    return out


@dataclass
class Model:
    bias: float
    rules: list[tuple[float, Rule]]
    threshold: float
    held_out: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * holds(x, r) for w, r in self.rules), np.zeros(len(x))))))

    def column(self) -> Column:
        """The rules as a Spark column."""
        total = F.lit(self.bias)
        for w, rule in self.rules:
            conditions = [F.col(FEATURES[f]) > limit if above else F.col(FEATURES[f]) <= limit for f, above, limit in rule]
            both = conditions[0]
            for c in conditions[1:]:
                both = both & c
            total = total + F.when(both, w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """The last fifth of the rows, which come in hashed order, is held out."""
    if not len(y) or y.min() == y.max():
        return Model(50.0, [], 0.0, 1.0)
    cut = max(1, len(y) * 4 // 5)
    if y[:cut].min() == y[:cut].max():
        cut = len(y)
    rules = rules_of(x[:cut], y[:cut])
    z = np.stack([holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    hx, hy = (x[cut:], y[cut:]) if cut < len(y) else (x, y)
    hz = z[cut:] if cut < len(y) else z
    tried = []
    for b, w in lasso(z[:cut], y[:cut]):
        q = np.clip(1 / (1 + np.exp(-(b + hz @ w))), 1e-9, 1 - 1e-9)
        loss = -(hy * np.log(q) + (1 - hy) * np.log(1 - q))
        tried.append((loss.mean(), loss.std() / len(loss) ** 0.5, b, w))
    least = min(tried, key=lambda r: r[0])
    _, _, b, w = next(r for r in tried if r[0] <= least[0] + least[1])
    model = Model(b, [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-6], 0.0, 0.0)
    q = model.score(hx)
    good = np.sort(q[hy == 1])
    model.threshold = min(CEILING, float(good[int((1 - KEPT) * len(good))]) if len(good) else CEILING)
    model.held_out = float(((q >= model.threshold) == (hy == 1)).mean())
    return model


def fit(features: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).cast("double").alias("__quality"))
    rows = common.first_by_hash(features.join(known, "doc_id").groupBy("doc_id", "__quality").agg(F.min(F.struct(*FEATURES)).alias("__f")).select("doc_id", "__quality", "__f.*"), bound, "doc_id").select(*FEATURES, "__quality").toPandas().to_numpy(float)
    return train(rows[:, :-1], rows[:, -1])


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, score (chance of good quality) and keep for each row of docs."""
    features = common.cut(measured(docs))
    model = fit(features, labels, bound)
    return features.select("doc_id", model.column().alias("score")).withColumn("keep", F.col("score") >= model.threshold)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
