"""The pipeline: columns, effect of each stage, and run() against the stages applied by hand."""

import random

import pytest

import corpus_pipeline
from lodestar.llm import common, op4_fertility, op7_decontamination, op8_simhash, op10_lines

from .test_operators import DOCS, brute_groups, brute_lines, frame, prose

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_each_stage_by_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.cut(stage(spark, before, SF))
        assert docs.columns == columns
        ids = sorted(r.doc_id for r in docs.collect())
        rows = [tuple(r) for r in before.select("doc_id", common.row_key(), "text").collect()]
        if name == "quality_rules":
            want = [r.doc_id for r in op4_fertility.decide(before).where("keep").collect()]
        elif name == "line_dedup":
            gone = brute_lines(rows)
            text = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, k, n) not in gone) for d, k, t in rows}
            want = [d for d, t in text.items() if t.strip()]
            assert {r.doc_id: r.text for r in docs.collect()} == {d: text[d] for d in want}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_dedup":
            ordered = sorted(rows)
            label = brute_groups(op8_simhash.fingerprints([t for _, _, t in ordered]))
            want = [d for i, (d, _, _) in enumerate(ordered) if label.get(i, i) == i]
        else:
            hit = {r.doc_id for r in op7_decontamination.search(before, common.table(spark, SF, "benchmark")).collect()}
            want = [d for d, _, _ in rows if d not in hit]
        assert ids == sorted(want)


def test_run_equals_stages(spark):
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, SF))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("rows", [0, 7])
def test_odd_tables(spark, rows):
    rng = random.Random(2)
    text = prose(rng, 80)
    docs = frame(spark, [None, "", text, text, "  ", text + " more", prose(rng, 40)][:rows]) if rows else spark.createDataFrame([], DOCS)
    docs = docs.withColumnRenamed("source", "node")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = common.cut(out)
    assert docs.count() == (2 if rows else 0)
    assert op10_lines.keep(docs).count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
