"""The ten operators against brute force, held-out accuracy and odd tables."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, op1_secrets, op2_quality, op3_suffixes, op4_fertility, op5_html, op6_lm, op7_decontamination, op8_simhash, op9_packing, op10_lines, runs, tokenizers, wordgrid
from lodestar.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "be", "ti", "or", "sel", "mu", "gra", "on", "the", "du"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing extra columns."""
    rng = random.Random(1)
    base = prose(rng, 120)
    rows = [
        (None, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4), (3, base, "en", "s", 5), (3, base, "en", "s", 5), (4, base, None, None, None), (5, base + "\n" + base, "xx", "s", 1),
        (6, "x", "en", "s", 1), (7, "long " * 60_000, "en", "s", 1), (8, "y" * 120_000, "en", "s", 1), (9, "\x00퟿é ñ 漢字 😀 token = \"aa11bb22cc33dd44\"", "de", "s", 3), (None, base, "en", "s", 2), (3, "other text for a used id", "en", "s", 9),
    ]
    return spark.createDataFrame([(*r, 1, "z", 2.0, [1], "k") for r in rows], DOCS + ", part int, node string, score double, words array<int>, row_key string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


# 1


def test_secrets_held_out():
    net = op1_secrets.model()
    known = op1_secrets.findings(800, 77)
    chance = np.array([net.chances(op1_secrets._codes(op1_secrets.views(t, a, z))).max() for t, a, z, _, _ in known])
    found = chance >= np.array([net.thresholds[op1_secrets.CLASSES.index(k[3])] for k in known])
    y = np.array([k[4] for k in known]) == 1
    assert (found & y).sum() / y.sum() >= 0.95 and (found & y).sum() / found.sum() >= 0.95


def test_secrets_of_the_table(spark):
    """Every candidate of every document comes back with the chance that the network gives it alone; of the table's assigned secrets 0.98 are found."""
    docs = common.table(spark, SF.replace("0.001", "0.01"), "documents")
    net = op1_secrets.fitted(passages=op1_secrets.contexts(docs))
    got = {(r.doc_id, r.begin, r.until): r for r in op1_secrets.scan(docs, net).collect()}
    want = {}
    for r in docs.collect():
        for a, z, kind in op1_secrets.candidates(r.text):
            want[r.doc_id, a, z] = kind, max(float(net.chances(op1_secrets._codes([v]))[0]) for v in op1_secrets.views(r.text, a, z))
    assert got.keys() == want.keys()
    for k, (kind, chance) in want.items():
        assert got[k].kind == kind and abs(got[k].chance - chance) < 1e-4
    real = [r for r in got.values() if r.kind == "assigned"]
    assert len(real) > 10 and sum(r.secret for r in real) >= 0.98 * len(real)


def test_secrets_odd(odd, empty):
    net = op1_secrets.model()
    rows = op1_secrets.scan(odd, net).collect()
    assert any(r.doc_id == 9 and r.kind == "assigned" and r.secret and r.shown == "aa11" for r in rows)
    assert op1_secrets.scan(empty, net).count() == 0


def test_candidates_merge_overlaps():
    assert [c[2] for c in op1_secrets.candidates('token = "0123456789abcdef" and 4111111111111111')] == ["assigned", "bare"]


# 2


def test_quality_compiles_and_generalises(spark):
    features = common.cut(op2_quality.measured(common.table(spark, SF.replace("0.001", "0.01"), "documents")))
    labels = common.table(spark, SF.replace("0.001", "0.01"), "labels")
    model = op2_quality.fit(features, labels)
    assert model.rules and model.held_out > 0.9
    got = features.select("doc_id", model.column().alias("p"), *op2_quality.FEATURES).toPandas()
    assert np.allclose(got["p"], model.score(got[list(op2_quality.FEATURES)].to_numpy(float)))


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.keep for r in op2_quality.classify(odd, labels).collect()} == {True}
    assert op2_quality.classify(empty, labels).count() == 0


def test_quality_statistics_by_hand(spark):
    """The query's features and decision for a text, computed in plain Python."""
    texts = ["The cat sat.\nThe cat sat.", "A1 %% zz!!", "", None]
    rows = op2_quality.measured(frame(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        w, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.strip()]
        letters = max(1, sum(map(len, w)))
        assert np.isclose(r.log_words, np.log1p(len(w))) and np.isclose(r.word_length, sum(map(len, w)) / max(1, len(w)))
        assert np.isclose(r.upper, sum(c.isupper() for c in t or "") / letters) and np.isclose(r.digits, sum(c.isdigit() for c in t or "") / letters)
        assert np.isclose(r.distinct_words, len({x.lower() for x in w}) / max(1, len(w) ** 0.5)) and r.longest_word == max(map(len, w), default=0)
        assert np.isclose(r.repeated_lines, 1 - len(set(lines)) / max(1, len(lines))) and r.ends_with_stop == float((t or "").rstrip()[-1:] in (".", "!", "?", '"') and bool(t))
    model = op2_quality.Model(0.5, [(2.0, ((0, True, 1.0), (4, False, 0.5))), (-1.0, ((10, True, 0.5),))], 0.5, 1.0)
    x = np.array([[getattr(r, f) for f in op2_quality.FEATURES] for r in rows])
    plain = [1 / (1 + np.exp(-(0.5 + 2.0 * (v[0] > 1 and v[4] <= 0.5) - (v[10] > 0.5)))) for v in x]
    assert np.allclose(model.score(x), plain)


def test_lasso_drops_useless_columns():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (2000, 6)).astype(float)
    y = (z[:, 0] > 0).astype(float)
    _, w = op2_quality.lasso(z, y, (0.05,))[0]
    assert abs(w[0]) > 1 and np.abs(w[1:]).max() < 0.05


# 3


def test_suffixes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    parts = [prose(rng, 70) for _ in range(6)]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.5 else prose(rng, rng.randint(1, 90)) for _ in range(4)) for _ in range(60)]
    texts += [parts[0], parts[0], "a b " * 90, None, "", prose(rng, 49), " ".join(parts[1].split()[:50]), " ".join(parts[1].split()[:49])]
    docs = frame(spark, texts)
    rows = [tuple(r) for r in docs.select("doc_id", common.row_key(), "text").collect()]
    want = op3_suffixes.brute_force(rows)
    for size in (op3_suffixes.RUN, 7):
        monkeypatch.setattr(op3_suffixes, "RUN", size)
        assert {tuple(r)[:5] for r in op3_suffixes.repeats(docs).collect()} == want


def test_front_coding_and_loser_tree():
    rng = random.Random(4)
    lots = [sorted((prose(rng, 3).encode(), str(i).encode()) for i in range(rng.randint(0, 40))) for _ in range(7)]
    assert [x[1:] for x in op3_suffixes.decode(op3_suffixes.encode(lots[0]))] == lots[0]
    merged = list(op3_suffixes.merge([op3_suffixes.decode(op3_suffixes.encode(x)) for x in lots]))
    assert [x[1] for x in merged] == sorted(t for x in lots for t, _ in x)
    for (_, before, _), (h, text, _) in zip(merged[:-1], merged[1:], strict=True):
        assert h == op3_suffixes.shared_prefix(before, text)


def test_suffixes_odd(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", common.row_key(), "text").collect()]
    want = op3_suffixes.brute_force(rows)
    assert {tuple(r)[:5] for r in op3_suffixes.repeats(odd).collect()} == want and want
    assert op3_suffixes.repeats(empty).count() == 0


# 4


def test_fertility_measures_by_hand():
    text = "The cat — 漢 sat.\nThe cat sat."
    folder = tokenizers.TOKENIZER_DIR
    n, m, per, piece, share, entropy, even = op4_fertility.measure_text(text, folder)
    ids = tokenizers.encode_pieces(folder, text)
    assert n == len(tokenizers.ranks(folder).encode_ordinary(text)) and m == len(ids)
    assert per == len(text) / n and piece == len(text) / m
    assert share == sum(i in tokenizers.byte_pieces(folder) for i in ids) / m
    assert op4_fertility.measure_text(" \n", folder)[0] == 0


def test_blocks_do_not_change_tokens():
    rng = random.Random(5)
    text = prose(rng, 9000) + "\n\n  " + prose(rng, 3000)
    folder = tokenizers.TOKENIZER_DIR
    assert tokenizers.encode_ranks(folder, text) == tokenizers.ranks(folder).encode_ordinary(text)
    assert tokenizers.encode_pieces(folder, text) == tokenizers.pieces(folder).encode(text)
    assert "".join(tokenizers.blocks("x" * 50_001)) == "x" * 50_001


def test_texts_encoded_together_equal_each_alone():
    """The words of a batch are encoded once each, with the ids of the whole texts."""
    folder, rng = tokenizers.TOKENIZER_DIR, random.Random(4)
    parts = ["a", "the", "Der", "'s", "é", "日本", "🎉", "12", ".", "!?", "|", "<s>", "<unk>", "\x00", "\u2581", " ", " ", " ", "  ", "\n", "\t", "\x1c", "\xa0", "\u3000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += [None, "", " ", "x" * 50_000, "ab " * 20_000, "  a b" * 9_000, ("y" * 9_999 + " b") * 5, ("y" * 19_999 + " b") * 5]
    got: list[tuple[list[int], list[int]]] = []
    for own in tokenizers.together(pa.array(texts, pa.string())):
        a, b = tokenizers.encode_all(folder, own, both=True)
        got += [(a.ids[a.edge[i] : a.edge[i + 1]].tolist(), b.ids[b.edge[i] : b.edge[i + 1]].tolist()) for i in range(len(own))]
    assert got == [(tokenizers.encode_ranks(folder, t), tokenizers.encode_pieces(folder, t)) if t else ([], []) for t in texts]
    assert [len(x) for x in tokenizers.together(pa.array(["x" * tokenizers.TOGETHER, "a", "b"]))] == [1, 2]


def test_repeated_words_are_encoded_once(monkeypatch):
    """Encoding every word of every text was half the time of the pipeline."""
    folder, asked = tokenizers.TOKENIZER_DIR, []
    real = tokenizers.pieces(folder)

    class Counted:
        def encode(self, texts, num_threads):
            asked.extend([texts] if isinstance(texts, str) else texts)
            return real.encode(texts, num_threads=num_threads)

    monkeypatch.setattr(tokenizers, "pieces", lambda folder: Counted())
    op4_fertility.measure_texts(pa.array(["some words here"] * 500 + ["here some words"] * 500), folder)
    assert sum(map(len, asked)) < 100


def test_fertility_bands(spark, odd, empty):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(60, 120)) for _ in range(200)] + ["".join(chr(rng.randint(0x2500, 0x2BFF)) for _ in range(300))]
    got = {r.doc_id: r for r in op4_fertility.decide(frame(spark, texts)).collect()}
    assert [i for i, r in got.items() if not r.keep] == [200] and "fallback_share" in got[200].reasons
    kept = op4_fertility.keep(frame(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == 200
    empties = [r for r in op4_fertility.decide(odd).collect() if "empty" in r.reasons]
    assert len(empties) == 3 and op4_fertility.keep(odd).columns == odd.columns
    assert op4_fertility.decide(empty).count() == 0


def test_fertility_short_and_nearer_junk(spark):
    """Junk of few tokens, and longer junk about 3 quartile distances out, goes; clean texts of the same lengths stay."""
    rng = random.Random(7)
    short = [prose(rng, rng.randint(4, 9)) for _ in range(150)]
    long = [prose(rng, rng.randint(100, 140)) for _ in range(200)]
    junk = ["\u2500\u2501\u2502 \u2503\u2504\u2505", " ".join(w + "%%%" if i % 3 == 0 else w for i, w in enumerate(prose(rng, 120).split()))]
    got = op4_fertility.decide(frame(spark, short + long + junk)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got if not r.keep] == [350, 351]


# 5


def brute_best(scores):
    found = [(sum(scores[a:z]), a, z) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)]
    return max([0.0, *(s for s, _, _ in found)])


def test_maximum_subsequence():
    rng = random.Random(7)
    for _ in range(100):
        s = [rng.choice([-3, -1, -0.5, 0, 1, 2, 4]) for _ in range(rng.randint(0, 12))]
        a, z, top = op5_html.best(s)
        assert top == brute_best(s) and sum(s[a:z]) == top


def test_html_held_out(spark):
    pages = [r.html for r in common.table(spark, SF.replace("0.001", "0.01"), "pages").orderBy("page_id").collect()]
    weights = op5_html.fit(pages[:120])
    scores = []
    for p in pages[120:]:
        mine = set(op5_html.extract(p, weights)[0].split())
        a, z = p.find("<article>"), p.find("</article>")
        true = set(" ".join(p[x:y] for n, x, y in op5_html.parts(p) if not n and a <= x < z).split())
        scores.append(2 * len(mine & true) / max(1, len(mine) + len(true)))
    assert np.mean(scores) > 0.9


def test_html_odd(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (2, "u", "<p>a b<script>no</p>", 1), (2, "u", "<p>a b<script>no</p>", 1), (3, "v", "<" * 50_000, 1), (4, "w", "x &amp; y < 3 <b", 1)], "page_id long, url string, html string, text int")
    got = op5_html.content(pages, op5_html.fit(op5_html.labelled(pages))).collect()
    assert len(got) == 6 and sorted(r.text for r in got if r.page_id == 2) == ["a b", "a b"]
    assert [r.text for r in got if r.page_id is None or r.page_id == 1] == ["", ""]
    assert op5_html.content(pages.limit(0), op5_html.DEFAULT).count() == 0


# 6


def lm_tables(texts):
    """Counts of the texts, as the operator gathers them."""
    ids = np.concatenate(texts)
    before = np.concatenate([[op6_lm.VOCABULARY, *t[:-1]] for t in texts if len(t)]).astype(np.int64)
    n = np.bincount(ids, minlength=op6_lm.VOCABULARY)
    top = np.argsort(-n, kind="stable")[: op6_lm.OWN]
    place = np.full(op6_lm.VOCABULARY + 1, op6_lm.OWN)
    place[top] = np.arange(len(top))
    follows = np.zeros((op6_lm.VOCABULARY, op6_lm.OWN), np.int64)
    for b, i in zip(before, ids, strict=True):
        if place[b] < op6_lm.OWN:
            follows[i, place[b]] += 1
    kind = op6_lm.classes_of(n, follows)
    after = np.bincount(before * op6_lm.CLASSES + kind[ids], minlength=(op6_lm.VOCABULARY + 1) * op6_lm.CLASSES).reshape(-1, op6_lm.CLASSES)
    return op6_lm.Counts(kind, n, after, np.bincount(op6_lm.pair_cell(before, ids), minlength=op6_lm.CELLS))


def some_parameters(seed=6):
    rng = np.random.default_rng(seed)
    return {k: x + rng.normal(0, 0.2, x.shape).astype(x.dtype) for k, x in op6_lm.start().items()}


def brute_score(p, tables, t):
    """Log chance of each token, place by place."""
    out = []
    e = np.append(t, 0)
    inputs = [p["e"][tables.entry[op6_lm.VOCABULARY if i == 0 else t[i - 1]]].astype(float) for i in range(len(t))]
    for i in range(len(t)):
        first = max(0, (i // op6_lm.STRIDE - 1) * op6_lm.STRIDE)
        w = np.array([inputs[i] @ p["q"] @ (inputs[j] @ p["k"]) / op6_lm.DIM**0.5 + p["rel"][i - j] for j in range(first, i + 1)])
        w = np.exp(w) / np.exp(w).sum()
        y = inputs[i] + sum(x * (inputs[j] @ p["v"]) for x, j in zip(w, range(first, i + 1), strict=True)) @ p["o"]
        y = y + np.maximum(y @ p["w1"] + p["b1"], 0) @ p["w2"]
        b = op6_lm.VOCABULARY if i == 0 else t[i - 1]
        logit = y @ p["out"] + p["bias"] + tables.first[b]
        out.append(logit[tables.kind[e[i]]] - np.log(np.exp(logit).sum()) + float(tables.within(np.array([b]), np.array([e[i]]))[0]))
    return np.array(out)


def test_lm_gradient():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 300, n) for n in (40, 0, 10, 33, 1)]
    tables = lm_tables(texts).tables()
    p = {k: x.astype(np.float64) for k, x in some_parameters().items()}
    s = op6_lm.Strides.of(texts)
    for a, z, places in ((0, len(s.ids), np.arange(16)), (1, 4, np.array([2, 9])), (2, 3, np.array([0]))):
        _, g = op6_lm.loss(p, s, tables, a, z, places)
        for name in p:
            i = tuple(rng.integers(0, d) for d in p[name].shape) if name != "e" else (int(tables.entry[s.before[a, 0]]), 3)
            q = {k: x.copy() for k, x in p.items()}
            q[name][i] += 1e-5
            up = op6_lm.loss(q, s, tables, a, z, places, False)[0]
            q[name][i] -= 2e-5
            assert abs((up - op6_lm.loss(q, s, tables, a, z, places, False)[0]) / 2e-5 - g[name][i]) < 1e-6 + 2e-3 * abs(g[name][i])  # a hidden unit may be at its kink


def test_lm_scores_equal_brute_force(monkeypatch):
    """Each token once, in its window, whatever the batch; the loss of training is the same chance."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 300, n) for n in (40, 0, 10, 33, 1, 16, 17)]
    tables, p = lm_tables(texts).tables(), some_parameters()
    s = op6_lm.Strides.of(texts)
    for batch in (256, 2, 3):
        monkeypatch.setattr(op6_lm, "BATCH", batch)
        got = op6_lm.score(p, s, tables)
        for i, t in enumerate(texts):
            own = s.text == i
            assert np.allclose(got[own][s.real[own]], brute_score(p, tables, t), atol=1e-3)
    assert (got != 0).sum() == sum(map(len, texts))


def test_lm_scores_follow_the_parameters():
    """Tables that have scored for one model, and kept what they share for it, score for another as new ones do."""
    t = np.random.default_rng(3).integers(0, 300, 70)
    tables, s = lm_tables([t]).tables(), op6_lm.Strides.of([t])
    for seed in (6, 7, 6):
        p = some_parameters(seed)
        assert np.allclose(op6_lm.score(p, s, tables)[s.real], brute_score(p, tables, t), atol=1e-3)


def test_lm_is_causal_and_a_distribution():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 500, 300) for _ in range(4)]
    tables, p = lm_tables(texts).tables(), some_parameters()
    t = texts[0][:60]
    other = t.copy()
    other[40:] = 7
    a, b = (op6_lm.score(p, op6_lm.Strides.of([x]), tables).ravel() for x in (t, other))
    assert np.allclose(a[:40], b[:40], atol=1e-5) and not np.allclose(a[40:60], b[40:60])
    every = np.arange(op6_lm.VOCABULARY)
    for before in (int(t[0]), op6_lm.VOCABULARY, 40_000):
        inside = np.exp(tables.within(np.full(len(every), before), every).astype(float))
        whole = np.bincount(tables.kind, weights=inside, minlength=op6_lm.CLASSES)
        assert np.allclose(whole[np.unique(tables.kind)], 1, atol=1e-2) and abs(np.exp(tables.first[before].astype(float)).sum() - 1) < 1e-3


def test_lm_counts_equal_plain(spark):
    docs = common.table(spark, SF, "documents")
    got = op6_lm.counted(common.cut(op6_lm.encoded(docs, tokenizers.TOKENIZER_DIR)))
    want = lm_tables([np.array(tokenizers.encode_ranks(tokenizers.TOKENIZER_DIR, r.text), np.int64) for r in docs.collect()])
    assert (got.ids == want.ids).all() and (got.kind == want.kind).all() and (got.after == want.after).all() and (got.cells == want.cells).all()


def test_lm_beats_pairs_on_held_out_documents(spark):
    """Nats a token on documents that were not trained on: below smoothed pair counts of the same data, whichever smoothing suits them best."""
    docs = common.table(spark, SF.replace("0.001", "0.01"), "documents").dropDuplicates(["text"]).repartition(2, "doc_id")
    held = F.col("doc_id") % 6 == 0
    tokens = common.cut(op6_lm.encoded(docs.where(~held), tokenizers.TOKENIZER_DIR))
    counts = op6_lm.counted(tokens)
    tables = counts.tables()
    q = op6_lm.trained(tokens, op6_lm.start(), tables)
    texts = [np.array(tokenizers.encode_ranks(tokenizers.TOKENIZER_DIR, r.text), np.int64) for r in docs.where(held).collect()]
    s = op6_lm.Strides.of(texts)
    mine, begun = (-op6_lm.score(p, s, tables).sum() / s.real.sum() for p in (q, op6_lm.start()))
    ids, before = s.ids[s.real], s.before[s.real]
    alone = (counts.ids + 1.0) / (counts.ids + 1.0).sum()
    after = counts.after.sum(1)
    pairs = min(-np.log((counts.cells[op6_lm.pair_cell(before, ids)] + w * alone[ids]) / (after[before] + w)).mean() for w in (4, 10, 20, 40, 80, 160))
    assert mine < pairs - 0.02 and mine < begun - 0.02


def test_lm_memory_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(20)]
    texts += [texts[0], texts[1], texts[1] + " " + texts[2], None, "", "a"]
    folder = tokenizers.TOKENIZER_DIR
    tokens = common.cut(op6_lm.encoded(frame(spark, texts), folder))
    p, tables = some_parameters(), op6_lm.counted(tokens).tables()
    ids = [np.array(tokenizers.encode_ranks(folder, t or ""), np.int64) for t in texts]
    chance = [brute_score(p, tables, t) for t in ids]
    cut = []
    for i, t in enumerate(ids):
        a, z, _, _ = op6_lm.segments([t])
        cut += [(i, int(x), int(y), tuple(t[x : x + op6_lm.LEAD]), tuple(t[x:y])) for x, y in zip(a, z, strict=True)]
    total = [c.sum() for c in chance]
    for i, a, z, head, whole in cut:
        others = [c for c in cut if c[3] == head and c[:2] != (i, a)]
        if others:
            rest = chance[i][a + op6_lm.LEAD : z].sum()
            total[i] += np.log((1 - op6_lm.MEMORY) * np.exp(rest) + op6_lm.MEMORY * sum(c[4] == whole for c in others) / len(others)) - rest
    got = {r.doc_id: r for r in op6_lm.scored_by(tokens, p, tables).collect()}
    for i, t in enumerate(ids):
        assert got[i].n_tokens == len(t) and (got[i].log_chance is None) == (not len(t))
        assert not len(t) or abs(got[i].log_chance - total[i]) < 1e-2 + 1e-4 * len(t)
    assert min(got[i].per_token for i in (0, 1, 20, 21)) > max(got[i].per_token for i in range(3, 20) if len(ids[i]) > 40)


def test_lm_odd(odd, empty):
    got = op6_lm.scored(odd).collect()
    assert len(got) == odd.count() and all((r.n_tokens == 0) == (r.perplexity is None) for r in got)
    assert sorted(r.n_tokens for r in got)[-1] >= 60_000 and all(np.isfinite(r.per_token) for r in got if r.n_tokens)
    assert op6_lm.scored(empty).count() == 0


def test_lm_trains_on_every_document(spark):
    """A table of any one document moves the parameters."""
    rng = random.Random(8)
    for text in (prose(rng, 40) for _ in range(3)):
        tokens = common.cut(op6_lm.encoded(frame(spark, [text]), tokenizers.TOKENIZER_DIR))
        tables = op6_lm.counted(tokens).tables()
        q = op6_lm.trained(tokens, op6_lm.start(), tables)
        s = op6_lm.Strides.of([np.array(tokenizers.encode_ranks(tokenizers.TOKENIZER_DIR, text))])
        assert op6_lm.score(q, s, tables).sum() > op6_lm.score(op6_lm.start(), s, tables).sum()


class OneTask:
    """A table of texts as the training sees it, on one task and in this process."""

    def __init__(self, texts):
        self.sparkSession = self.sparkContext = self
        self.ids = pa.RecordBatch.from_arrays([pa.array([t.astype(np.uint16).tobytes() for t in texts], pa.binary())], names=["ids"])

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        self.rows = pa.Table.from_batches(f(iter([self.ids])), pa.schema([("i", pa.int32()), ("x", pa.float64())])).to_pandas()
        return self

    def groupBy(self, *_):
        return self

    agg = orderBy = groupBy

    def toPandas(self):
        return self.rows


def test_lm_trains_alike_at_every_size(spark, monkeypatch):
    """No rule of the training changes with the size of the table: each stride is in one step, of TARGETS targets."""
    rng = np.random.default_rng(2)
    for n in (1, 31, op6_lm.STEP - 1, op6_lm.STEP, op6_lm.STEP + 1, 2 * op6_lm.STEP):
        texts = [rng.integers(0, 300, n * op6_lm.STRIDE)]
        steps, loss = [], op6_lm.loss

        def noted(p, s, tables, a, z, places, steps=steps, loss=loss):
            steps.append((a, z, len(places)))
            return loss(p, s, tables, a, z, places)

        with monkeypatch.context() as m:
            m.setattr(op6_lm, "loss", noted)
            op6_lm.trained(OneTask(texts), op6_lm.start(), lm_tables(texts).tables())
        assert sorted(i for a, z, _ in steps for i in range(a, z)) == list(range(n))
        assert {t for _, _, t in steps} == {op6_lm.TARGETS}


# 7


def test_containment_equals_brute_force(spark, odd, empty):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (1, 2, 3, 5, 8, 12, 20, 33, 60, 100, 400)]
    texts = []
    for _ in range(120):
        w = prose(rng, rng.randint(5, 900)).split()
        for it in rng.sample(items, rng.randint(0, 2)):
            x = it.split()
            x = x[rng.randint(0, len(x) // 4) :]
            if rng.random() < 0.5 and len(x) > 20:  # in three parts, far from each other
                k = len(x) // 3
                for part in (x[:k], x[k : 2 * k], x[2 * k :]):
                    w += prose(rng, rng.randint(0, 400)).split() + part
            else:
                at = rng.randint(0, len(w))
                w[at:at] = x
        texts.append(" ".join(w).title() if rng.random() < 0.3 else ", ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None), (0, items[0]), (None, items[6]), (98, " . ")], "item_id long, text string")

    def grams(t, k):
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, it in [*enumerate(items), (None, items[6])]:
        k = min(3, len(it.split()))
        g = grams(it, k)
        want |= {(i, d) for d, t in enumerate(texts) if len(g & grams(t, k)) / len(g) >= op7_decontamination.THRESHOLD - 1e-9}
    docs = frame(spark, texts)
    for size in (50_000, 3):
        got = [(r.item_id, r.doc_id) for r in op7_decontamination.search(docs, bench, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert op7_decontamination.search(odd, bench.where("length(text) > 12")).count() == 0
    assert op7_decontamination.search(odd, odd.selectExpr("doc_id item_id", "text").where("doc_id = 8")).count() == 1  # one word of 120,000 letters
    assert op7_decontamination.search(empty, bench).count() == 0 and op7_decontamination.search(docs, bench.limit(0)).count() == 0
    assert op7_decontamination.keep(docs, bench).count() == len(texts) - len({d for i, d in want if i not in (0, 1)})


def test_containment_of_a_scattered_item(spark):
    """A 30-word item in three thirds, 400 words apart, is 0.857 contained."""
    rng = random.Random(18)
    w = [f"w{i}" for i in range(30)]
    text = " ".join([*prose(rng, 400).split(), *w[:10], *prose(rng, 400).split(), *w[10:20], *prose(rng, 400).split(), *w[20:]])
    got = op7_decontamination.search(frame(spark, [text]), spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")).first()
    assert (got.shared, got.shingles) == (24, 28)


# 8


def test_masks_cover():
    m = op8_simhash.masks()
    rng = random.Random(9)
    assert len(m) == op8_simhash.MASKS
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(op8_simhash.BITS), op8_simhash.RADIUS))
        assert ((m & np.uint64(diff)) == 0).any()


def brute_groups(prints):
    some = [i for i, f in enumerate(prints) if f.any()]
    label = {i: i for i in some}
    changed = True
    near = {i: [j for j in some if sum(int(prints[i][k] ^ prints[j][k]).bit_count() for k in range(op8_simhash.BLOCKS)) <= op8_simhash.WHOLE and int(prints[i][-1] ^ prints[j][-1]).bit_count() <= op8_simhash.CHECK] for i in some}
    while changed:
        new = {i: min(label[j] for j in near[i]) for i in some}
        changed, label = new != label, new
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(10)
    texts = []
    for _ in range(40):
        w = prose(rng, rng.randint(3, 300)).split()
        for _ in range(rng.randint(1, 6)):
            x = list(w)
            for _ in range(int(len(x) * rng.choice([0, 0.02, 0.05, 0.1]))):
                x[rng.randrange(len(x))] = prose(rng, 1)
            texts.append(" ".join(x))
    texts += ["", "...", None, ""]
    prints = op8_simhash.fingerprints(texts)
    want = brute_groups(prints)
    got = {r.doc_id: r for r in op8_simhash.decide(frame(spark, texts)).collect()}
    for i in range(len(texts)):
        assert got[i].group_id == want.get(i, i) and got[i].keep == (want.get(i, i) == i)
    assert op8_simhash.keep(frame(spark, texts)).count() == sum(r.keep for r in got.values())


def test_near_duplicates_odd(odd, empty):
    got = op8_simhash.decide(odd).collect()
    assert sum(r.rows for r in got) == odd.count()
    base = [r for r in got if r.group_size >= 3]
    assert [r.doc_id for r in base if r.keep] == [None] and len({r.group_id for r in base}) == 1
    kept = op8_simhash.keep(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1
    assert op8_simhash.decide(empty).count() == 0 and op8_simhash.keep(empty).count() == 0


def test_cross_pairs():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 6, 300))
    part = rng.integers(0, 3, 300)
    order = np.lexsort((part, key))
    part = part[order]
    for small in (0, 64, 1000):
        got = {tuple(sorted(p)) for i, j in runs.cross(key, part, small) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if key[i] == key[j] and part[i] != part[j]}


# 9


def test_packing_equals_plain_greedy(spark, odd, empty):
    rng = random.Random(11)
    docs = frame(spark, [prose(rng, rng.randint(0, 400)) for _ in range(150)] + ["", None])
    got = op9_packing.pack(docs, capacity=512, shard_tokens=10**9).toPandas()
    full = got[got.n_tokens > 0].sort_values(["cost", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    loads = [[0.0, 512, i] for i in range(-(-int(full.n_tokens.sum()) // 512))]
    for r in full.itertuples():
        fit = [x for x in loads if x[1] >= r.n_tokens]
        if not fit:
            loads.append([0.0, 512, len(loads)])
            fit = [loads[-1]]
        best = min(fit, key=lambda x: (x[0], x[2]))
        assert r.sequence == f"0-{best[2]}" and r.at == 512 - best[1]
        best[0] += r.cost
        best[1] -= r.n_tokens
    assert got[got.n_tokens == 0].sequence.isna().all()
    shards = op9_packing.pack(docs, capacity=512, shard_tokens=4000).toPandas()
    assert shards.shard.nunique() > 3 and shards.groupby("sequence").n_tokens.sum().max() <= 512 and shards.n_tokens.sum() == got.n_tokens.sum()
    assert op9_packing.pack(odd).groupBy().sum("n_tokens").first()[0] == op9_packing.counts(odd).groupBy().sum("total").first()[0]
    assert op9_packing.pack(empty).count() == 0


# 10


def brute_lines(rows):
    """(doc_id, row_key, line_no) that go, by comparing every pair of lines."""

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]

    occ = {}
    for doc_id, key, text in set(rows):
        for n, line in enumerate((text or "").split("\n")):
            w = tuple(x for x in "".join(c if c > " " else " " for c in line.lower()).split(" ") if x)
            if w:
                occ.setdefault(w, []).append(((doc_id is not None, doc_id or 0, key, n), (doc_id, key, n)))
    first = {k: min(v)[0] for k, v in occ.items()}
    gone = set()
    for w, v in occ.items():
        near = len(w) >= op10_lines.SHARE and any(first[u] < first[w] and u != w and abs(len(u) - len(w)) <= 1 and (u[:2] == w[:2] or u[-2:] == w[-2:]) and distance(u, w) <= 1 for u in occ)
        gone |= {p for o, p in v if near or o != first[w]}
    return gone


def test_lines_equal_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    pool = [prose(rng, rng.randint(1, 14)) for _ in range(40)]
    for line in list(pool):
        w = line.split()
        for _ in range(3):
            x = list(w)
            kind = rng.choice("isd")
            at = rng.randrange(len(x))
            x[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(w)]
            pool.append(" ".join(x) if x else "a")
    pool += ["a a a a b b b b", "a a a b b b b", "a a a a b b b", "a a a a a b b b b", ""]
    docs = frame(spark, ["\n".join(rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(70)] + [None, ""])
    rows = [tuple(r) for r in docs.select("doc_id", common.row_key(), "text").collect()]
    want = brute_lines(rows)
    for limit in (op10_lines.BROADCAST_ROWS, 0):
        monkeypatch.setattr(op10_lines, "BROADCAST_ROWS", limit)
        assert {tuple(r)[:3] for r in op10_lines.removals(docs).collect()} == want
    out = {r.doc_id: r.text for r in op10_lines.apply(docs).collect()}
    for doc_id, key, text in rows:
        assert out[doc_id] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (doc_id, key, n) not in want))


def test_lines_odd(odd, empty):
    some = odd
    rows = [tuple(r) for r in some.select("doc_id", common.row_key(), "text").collect()]
    assert {tuple(r)[:3] for r in op10_lines.removals(some).collect()} == brute_lines(rows)
    kept = op10_lines.keep(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 0 and kept.where("doc_id IS NULL").count() == 2
    assert op10_lines.apply(empty).count() == 0


def test_short_lines_of_other_documents(spark):
    """Exact repeats of any length, and an edit from 5 words on, across documents; under 5 words an edit is another line."""
    texts = ["All rights reserved.\nwe came home by the river", "all  RIGHTS reserved.\nwe came home by the lake\nLes.", "Les.\nall rights deserved.\none two three four", "ONE two three four\none two three five"]
    assert [r.text for r in op10_lines.apply(frame(spark, texts)).orderBy("doc_id").collect()] == [texts[0], "Les.", "all rights deserved.\none two three four", "one two three five"]


def test_within_one():
    assert op10_lines.within_one(list("abcd"), list("abd")) and op10_lines.within_one(list("abcd"), list("abxd")) and op10_lines.within_one([], ["a"])
    assert not op10_lines.within_one(list("abcd"), list("bacd")) and not op10_lines.within_one(list("ab"), list("abcd"))


# shared


def test_word_hashes_do_not_depend_on_place():
    texts = ["one two  three", "", None, "THREE\ttwo\none", "two three one two three"]
    (w,) = wordgrid.words(texts)
    names = [w.text(i, i + 1).decode() for i in range(len(w.hash))]
    assert len({(n, h) for n, h in zip(names, w.hash.tolist(), strict=True)}) == 3 and w.count.tolist() == [3, 0, 0, 3, 5]
    g, at = w.grams(2)
    seen = {}
    for h, i in zip(g.tolist(), at.tolist(), strict=True):
        seen.setdefault(h, set()).add((names[i], names[i + 1]))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == 5


def test_first_by_hash(spark):
    rows = spark.range(5000).withColumnRenamed("id", "x")
    assert common.first_by_hash(rows, 200, "x").count() == 200
    assert common.first_by_hash(rows.limit(50), 200, "x").count() == 50
    assert common.first_by_hash(rows.where(F.lit(False)), 200, "x").count() == 0
