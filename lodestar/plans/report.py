"""Report tables and plot data from summaries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.schemas import with_legacy

SYSTEMS = ["parametric_only", *(f"fixed_{n}" for n in (128, 256, 512)), *(f"{k}_256" for k in ("recursive", "sentence", "semantic"))]
COMPARED = [p + s for s in ("recursive_256", "semantic_256") for p in ("", "chonkie_")]
LABELS = {"squad_v2": "SQuAD v2", "hotpot_qa": "HotpotQA"}
SHOWN = ("exact_match", "f1", "recall_at_k", "precision_at_k")


def last_rows(summary: DataFrame, position: str) -> DataFrame:
    """One row for each dataset and system, the last by position."""
    row = F.struct(*summary.columns)
    return summary.groupBy("dataset", "system").agg(F.max_by(row, F.col(position)).alias("__r")).select("__r.*")


def ordered(summary: DataFrame, order: list[str] = SYSTEMS) -> DataFrame:
    """The systems of a fixed order that are there, with their place."""
    return summary.withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("system"))).where("place > 0")


def main_table(summary: DataFrame, order: list[str] = SYSTEMS) -> DataFrame:
    """Rendered cells by dataset and place; bold cells carry the column's maximum of the dataset."""
    w = Window.partitionBy("dataset")
    x = ordered(summary, order)
    for m in SHOWN:
        x = x.withColumn(f"max_{m}", F.max(m).over(w)).withColumn(f"{m}_pct", T.percent(m)).withColumn(f"{m}_tex", T.highlight(m, f"max_{m}", T.percent(m)))
    return x.select("dataset", "place", "system", *(f"{m}_pct" for m in SHOWN), *(f"{m}_tex" for m in SHOWN), T.decimal("avg_chunk_tokens").alias("tokens"), T.int_or_dash("num_chunks").alias("chunks"))


def comparison_table(summary: DataFrame) -> DataFrame:
    """Systems that both datasets have, in fixed order."""
    one, two = (summary.where(F.col("dataset") == d) for d in ("squad_v2", "hotpot_qa"))
    x = one.select("system", F.col("exact_match").alias("squad_exact_match"), F.col("f1").alias("squad_f1"), "avg_chunk_tokens").join(two.select("system", F.col("f1").alias("hotpot_f1")), "system")
    x = ordered(x, COMPARED)
    w = Window.partitionBy(F.lit(1))
    for m in ("squad_exact_match", "squad_f1", "hotpot_f1"):
        x = x.withColumn(f"{m}_pct", T.percent(m)).withColumn(f"{m}_tex", T.highlight(F.col(m), F.max(m).over(w), T.percent(m)))
    return x.select("place", "system", *(f"{m}_{k}" for m in ("squad_exact_match", "squad_f1", "hotpot_f1") for k in ("pct", "tex")), T.decimal("avg_chunk_tokens").alias("tokens"))


def winners(summary: DataFrame) -> DataFrame:
    """Systems within 1e-12 of the best F1 of each dataset."""
    best = summary.withColumn("m", F.max("f1").over(Window.partitionBy("dataset"))).where(F.abs(F.col("f1") - F.col("m")) < 1e-12)
    return best.groupBy("dataset").agg(F.array_sort(F.collect_list("system")).alias("winners"), F.max("m").alias("f1"))


def sample_sizes(summary: DataFrame, datasets: DataFrame) -> DataFrame:
    """Configured datasets (dataset, position) with their first known number of examples."""
    known = summary.where("num_examples IS NOT NULL").groupBy("dataset").agg(F.min_by("num_examples", "system").alias("num_examples"))
    return datasets.join(known, "dataset", "left").orderBy("position")


def _label(dataset: str) -> str:
    return LABELS.get(dataset, dataset)


def caption(dataset: str, best: list[str]) -> str:
    if dataset == "hotpot_qa" or not best:
        return f"Results on {_label(dataset)}."
    names = " and ".join(s.replace("_", " ") for s in best).capitalize()
    return f"Results on {_label(dataset)}. {names} {'leads' if len(best) == 1 else 'lead together'} end to end."


def _markdown(head: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(head), "|---|" + "---:|" * (len(head) - 1), *map(line, rows)])


def _latex(head: list[str], rows: list[list[str]], text: str, label: str) -> str:
    body = " \\\\\n".join(" & ".join(r) for r in rows) + " \\\\"
    inner = f"\\toprule\n{' & '.join(head)} \\\\\n\\midrule\n{body}\n\\bottomrule"
    columns = "l" + "r" * (len(head) - 1)
    return f"\\begin{{table*}}[t]\n\\centering\n\\small\n\\begin{{tabular}}{{{columns}}}\n{inner}\n\\end{{tabular}}\n\\caption{{{text}}}\n\\label{{{label}}}\n\\end{{table*}}"


HEAD = ["System", "EM", "F1", *(f"{m}@4" for m in ("Recall", "Precision")), "Avg chunk tokens", "# chunks"]
COMPARED_HEAD = ["System", *(f"SQuAD {m}" for m in ("EM", "F1")), "HotpotQA F1", "Avg chunk tokens"]


def render(summary: DataFrame, compared: DataFrame | None = None, sizes: dict[str, int] | None = None) -> tuple[str, str]:
    """Markdown and LaTeX reports; the rendered tables are small and come to the driver."""
    rows = main_table(summary).orderBy("dataset", "place").collect()
    best = {r["dataset"]: r["winners"] for r in winners(summary).collect()}
    note = ", ".join(f"{_label(d)} (n={n})" for d, n in (sizes or {}).items())
    md, tex = ["# Auto-generated Report Tables"], []
    if note:
        md.append(f"\\noindent\\textit{{Single-run percentages. Current subsets: {note}.}}")
        tex.append(md[-1].replace("(n=", "($n=").replace(")", "$)"))
    for d in sorted({r["dataset"] for r in rows}, key=lambda d: (list(LABELS).index(d) if d in LABELS else 99, d)):
        own = [r for r in rows if r["dataset"] == d]
        md += [f"## {_label(d)}", _markdown(HEAD, [[f"`{r['system']}`", *(r[f"{m}_pct"] for m in SHOWN), r["tokens"], r["chunks"]] for r in own])]
        escaped = lambda s: "\\texttt{" + s.replace("_", "\\_") + "}"
        tex.append(_latex([*HEAD[:-1], "\\# chunks"], [[escaped(r["system"]), *(r[f"{m}_tex"] for m in SHOWN), r["tokens"], r["chunks"]] for r in own], caption(d, best.get(d, [])), f"tab:{d}"))
    if compared is not None:
        own = comparison_table(compared).orderBy("place").collect()
        names = ("squad_exact_match", "squad_f1", "hotpot_f1")
        md += ["## Chonkie Comparison", _markdown(COMPARED_HEAD, [[f"`{r['system']}`", *(r[f"{m}_pct"] for m in names), r["tokens"]] for r in own])]
        tex.append(_latex(COMPARED_HEAD, [["\\texttt{" + r["system"].replace("_", "\\_") + "}", *(r[f"{m}_tex"] for m in names), r["tokens"]] for r in own], "The same chunkers in two implementations.", "tab:compared"))
    return "\n\n".join(md) + "\n", "\n\n".join(tex) + "\n"


def write(folder: str, markdown: str, latex: str) -> None:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "tables.md").write_text(markdown.rstrip() + "\n", encoding="utf-8")
    (out / "tables.tex").write_text(latex.rstrip() + "\n", encoding="utf-8")


def fixed_size_series(aggregates: DataFrame, metric: str = "f1") -> DataFrame:
    """(dataset, retriever, chunk_size, value) of the fixed chunkers, by size; what a line plot draws."""
    size = T.chunk_size_of("chunker")
    return aggregates.where(F.col("chunker").startswith("fixed_")).select("dataset", "retriever", size.alias("chunk_size"), with_legacy(aggregates, metric).alias("value")).where("chunk_size IS NOT NULL").orderBy("dataset", "retriever", "chunk_size")


def latency_series(aggregates: DataFrame) -> DataFrame:
    x = aggregates.where(F.col("system") != "parametric_only")
    return x.select("dataset", "system", F.coalesce(with_legacy(x, "avg_retrieval_latency_s"), F.lit(0.0)).alias("retrieval_s"), with_legacy(x, "f1").alias("f1")).orderBy("dataset", "system")


def quality_series(aggregates: DataFrame) -> DataFrame:
    """Retrieval coverage against F1."""
    x = aggregates.where(F.col("system") != "parametric_only")
    return x.select("dataset", "system", with_legacy(x, "supporting_doc_coverage").alias("coverage"), with_legacy(x, "f1").alias("f1")).orderBy("dataset", "system")


def notebook_table(aggregates: DataFrame) -> DataFrame:
    """The best retriever of each chunker, in percent to one digit; rows without chunker are left out, as by a group key."""
    x = aggregates.where("chunker IS NOT NULL")
    best = x.groupBy("dataset", "chunker").agg(F.max_by(F.struct("system", "retriever", *(with_legacy(x, m).alias(m) for m in SHOWN)), with_legacy(x, "f1")).alias("b"))
    return best.select("dataset", "chunker", "b.system", "b.retriever", *(F.round(F.col(f"b.{m}") * 100, 1).alias(m) for m in SHOWN)).withColumn("place", F.array_position(F.array(*map(F.lit, SYSTEMS)), F.col("chunker"))).orderBy("dataset", "place", "chunker")


def dashboard_results(summary: DataFrame, dataset: str | None = None, retriever: str | None = None, with_baseline: bool = True, sort: str = "f1") -> DataFrame:
    x = summary
    if dataset:
        x = x.where(F.col("dataset") == dataset)
    if retriever:
        x = x.where(F.col("retriever") == retriever)
    if not with_baseline:
        x = x.where(F.col("system") != "parametric_only")
    return x.fillna(0.0, subset=[m for m in SHOWN if m in x.columns]).orderBy(F.desc(sort), "system")


def corpus_preview(docs: DataFrame, rows: int = 24) -> DataFrame:
    return docs.select("title", "doc_id", F.length("text").alias("characters")).orderBy("doc_id").limit(rows)
