"""Registered queries on the driver's tables, each with the same computation in SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import chunking, evaluation, evidence, generation, retrieval
from lodestar.plans import live, report
from lodestar.sources import datasets, uploads
from lodestar.sources.results import digest_row
from lodestar.storage import table as _table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("source").alias("title"), "text", F.col("lang").alias("dataset"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant's next turn as the answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _table(spark, sf, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return t.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer"))


# SQL pieces shared by the oracles


class _Sql(str):
    """SQL with {0} as the place of an expression; other braces are ordinary."""

    def format(self, expression: str) -> str:
        return self.replace("{0}", expression)


_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"
_TOKENS = _Sql("list_filter(string_split(regexp_replace({0}, '" + _WS + "+', ' ', 'g'), ' '), lambda x: x <> '')")
_LEX = _Sql(r"regexp_extract_all(lower({0}), '[\p{L}\p{N}_]+')")
_STOP = "[" + ", ".join(f"'{s}'" for s in T.STOPWORDS) + "]"
_KEYS = _Sql("list_filter(" + _LEX + ", lambda k: NOT list_contains(" + _STOP + ", k))")
_TRIM = _Sql("regexp_replace({0}, '^" + _WS + "+|" + _WS + "+$', '', 'g')")
_SENTENCES = _Sql(r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([.!?])" + _WS + r"+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: " + _TRIM.format("x") + "), lambda x: x <> '')")
_GUARD = r"(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])"
_BARE = r"regexp_replace(lower({0}), '[!-/:-@\[-`{-~]', '', 'g')"
_NORM = _Sql("trim(regexp_replace(regexp_replace(regexp_replace(" + _BARE + ", '" + _GUARD + r"', '\1 \2', 'g'), '" + _GUARD + r"', '\1 \2', 'g'), '" + _WS + "+', ' ', 'g'))")
_TURNS = """t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 qa AS (SELECT conv_id, turn, text AS question, next_text AS answer FROM t WHERE role = 'user' AND next_role = 'assistant')"""
_F1 = """CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE 2.0 * (n / len(p)) * (n / len(g)) / (n / len(p) + n / len(g)) END"""


def _fixed_sql(size: int, overlap: int) -> str:
    stride = float(size - overlap)
    return f"""w AS (SELECT 'doc::' || doc_id AS doc_id, source AS title, lang AS dataset, {_TOKENS.format('text')} AS w FROM documents),
 c AS (SELECT doc_id, title, dataset, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - {size}) / {stride}) AS INT)))) AS i FROM w WHERE len(w) > 0),
 chunks AS (SELECT 'fixed_{size}::' || doc_id || '::' || i AS chunk_id, doc_id, title, dataset, CAST(i AS INT) AS chunk_index, array_to_string(w[i * {int(stride)} + 1 : i * {int(stride)} + {size}], ' ') AS text,
   CAST(len(w[i * {int(stride)} + 1 : i * {int(stride)} + {size}]) AS INT) AS token_count FROM c)"""


_FIXED = _fixed_sql(128, 19)


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.build(_docs(spark, sf), {"name": "fixed_128", "type": "fixed", "chunk_size": 128, "chunk_overlap": 19})


# chunkers


@query(f"WITH {_FIXED} SELECT chunk_id, doc_id, chunk_index, token_count, md5(text) AS digest FROM chunks")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf).select("chunk_id", "doc_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


@query(f"WITH {_FIXED} SELECT dataset, count(*) AS num_chunks, count(DISTINCT doc_id) AS num_documents, round(avg(token_count), 6) AS avg_chunk_tokens FROM chunks GROUP BY dataset")
def chunk_fixed_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf).groupBy("dataset").agg(F.count("*").alias("num_chunks"), F.countDistinct("doc_id").alias("num_documents"), F.round(F.avg("token_count"), 6).alias("avg_chunk_tokens"))


@query(f"SELECT doc_id, len({_SENTENCES.format('text')}) AS n, md5(array_to_string({_SENTENCES.format('text')}, '|')) AS digest FROM documents")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.size(T.sentences("text")).cast("long").alias("n"), F.md5(F.array_join(T.sentences("text"), "|")).alias("digest"))


@query(f"SELECT doc_id, len({_TOKENS.format('text')}) AS n FROM documents")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", T.count_tokens("text").cast("long").alias("n"))


_PACK = f"""s AS (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents),
 e AS (SELECT doc_id, i, s[i] AS x, len({_TOKENS.format('s[i]')}) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
 r(doc_id, i, chunk, total) AS (SELECT doc_id, i, 0, n FROM e WHERE i = 1
   UNION ALL SELECT e.doc_id, e.i, CASE WHEN r.total + e.n > 64 THEN chunk + 1 ELSE chunk END, CASE WHEN r.total + e.n > 64 THEN e.n ELSE r.total + e.n END FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)"""


@query(f"WITH RECURSIVE {_PACK} SELECT doc_id, CAST(chunk AS INT) AS chunk_index, CAST(sum(n) AS INT) AS token_count, md5(string_agg(x, ' ' ORDER BY i)) AS digest FROM r JOIN e USING (doc_id, i) GROUP BY doc_id, chunk")
def chunk_sentence(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.build(_table(spark, sf, "documents").withColumnsRenamed({"source": "title", "lang": "dataset"}), {"name": "sentence_64", "type": "sentence", "chunk_size": 64})
    return out.select("doc_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


@query()
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.build(_docs(spark, sf), {"name": "semantic_128", "type": "semantic", "chunk_size": 128, "similarity_threshold": 0.3})


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.build(_docs(spark, sf), {"name": "recursive_128", "type": "recursive", "chunk_size": 128, "chunk_overlap": 16})


# lexical retrieval

_POST = f"""tok AS (SELECT chunk_id, {_LEX.format('text')} AS w FROM chunks), total AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
 post AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
 raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, total GROUP BY term, n),
 idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_FIXED}, {_POST}, q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_LEX.format('text')}) AS term FROM benchmark) GROUP BY ALL),
 scored AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN idf USING (term) JOIN post USING (term), total GROUP BY query_id, chunk_id),
 filled AS (SELECT query_id, chunk_id, score FROM scored UNION ALL SELECT item_id, chunk_id, 0.0 FROM benchmark, chunks WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.query_id = item_id AND s.chunk_id = chunks.chunk_id)),
 hits AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM filled QUALIFY rank <= 4)"""


@query(f"SELECT doc_id, len({_LEX.format('text')}) AS n, len(list_distinct({_LEX.format('text')})) AS distinct_n FROM documents")
def lexical_tokens(spark: SparkSession, sf: str) -> DataFrame:
    w = T.lexical_tokens("text")
    return _table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct_n"))


@query(f"WITH {_FIXED}, {_POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def df_idf(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.LexicalIndex(_fixed(spark, sf)).persist().idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM hits")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = retrieval.LexicalIndex(_fixed(spark, sf)).persist()
    return retrieval.bm25(index, _questions(spark, sf), 4).withColumn("score", F.round("score", 6))


@query("""WITH chunks AS (SELECT CAST(item_id AS VARCHAR) AS chunk_id FROM benchmark), hits AS (SELECT 0 AS query_id, chunk_id, 0.0 AS score, row_number() OVER (ORDER BY chunk_id) AS rank FROM chunks)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM hits WHERE rank <= 6""")
def bm25_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A query without a known word gets the first chunks with score 0."""
    chunks = _table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    return retrieval.bm25(retrieval.LexicalIndex(chunks), spark.createDataFrame([(0, "qqqqzzzz 0000xx")], "query_id int, query string"), 6)


# dense retrieval and fusion

_DENSE = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), qv AS (SELECT * FROM v),
 ds AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_inner_product(q.e, v.e), 9) AS score FROM qv q, v),
 dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 20)"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = _table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM dense WHERE rank <= 4")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense(*_vectors(spark, sf), 4).withColumn("score", F.round("score", 5))


_SPARSE = """sp AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, CAST(CASE WHEN q.label = v.label THEN 1 ELSE 0 END AS DOUBLE) AS score FROM qv q, v),
 sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sp QUALIFY rank <= 20)"""


def _same_first(v: DataFrame, k: int) -> DataFrame:
    """The k first vectors of each one by score, 1 for an equal label and 0 else, and by id.

    Those of a label are the same for all its queries; where they are fewer than k, the others that fill up
    are among the first 2 k of all."""
    chunks, queries = v.select(F.col("vec_id").alias("chunk_id"), "label"), v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("chunk_id"))
    first = chunks.where("label IS NOT NULL").withColumn("place", place).where(F.col("place") <= k).groupBy("label").agg(F.collect_list("chunk_id").alias("same")).persist()
    low = chunks.orderBy("chunk_id").limit(2 * k).agg(F.collect_list(F.struct("chunk_id", "label")).alias("low"))
    # few labels are broadcast, since a join on so few keys would be skewed
    found = queries.join(F.broadcast(first) if first.count() <= 20_000 else first, queries["l"] == first["label"], "left").drop("label").crossJoin(F.broadcast(low))
    scored = lambda ids, s: F.transform(ids, lambda c: F.struct(c.alias("chunk_id"), F.lit(s).alias("score")))
    same, none = F.coalesce("same", F.array().cast(dict(first.dtypes)["same"])), F.array().cast(dict(first.dtypes)["same"])
    others = F.transform(F.filter("low", lambda x: ~F.coalesce(x["label"] == F.col("l"), F.lit(False))), lambda x: x["chunk_id"])
    rows = found.select("query_id", F.inline(F.concat(scored(same, 1.0), scored(F.when(F.size(same) < k, others).otherwise(none), 0.0))))
    return retrieval.top_k(rows, k)


def _two_lists(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The dense list, and one of equal labels first as the second."""
    return [retrieval.dense(*_vectors(spark, sf), 20), _same_first(_table(spark, sf, "embeddings"), 20)]


@query(f"""WITH {_DENSE}, {_SPARSE}, u AS (SELECT query_id, chunk_id, rank, 0 AS l, 0.55 AS w FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1, 0.45 FROM sparse),
 f AS (SELECT query_id, chunk_id, round(sum(CAST(w AS DOUBLE) / (60.0 + rank)), 12) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INT) AS rank FROM f QUALIFY rank <= 4""")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.weighted_rrf(_two_lists(spark, sf), [0.55, 0.45], 60.0, 4).withColumn("score", F.round("score", 9))


@query(f"""WITH {_DENSE}, {_SPARSE}, u AS (SELECT query_id, chunk_id, rank, score, 0 AS l, 'dense' AS query FROM dense UNION ALL SELECT query_id, chunk_id, rank, score, 1, 'label' FROM sparse),
 f AS (SELECT query_id AS question_id, chunk_id, round(sum(1.0 / (60.0 + rank)), 12) AS score, greatest(0.0, max(score)) AS raw_score, list_sort(list_distinct(list(query))) AS m, min(l * 1000 + rank) AS first FROM u GROUP BY query_id, chunk_id)
SELECT question_id, chunk_id, round(score, 9) AS score, round(raw_score, 5) AS raw_score, array_to_string(m, ',') AS matched, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, raw_score DESC, first) AS INT) AS rank FROM f QUALIFY rank <= 8""")
def multi_query_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = [x.withColumns({"question_id": F.col("query_id"), "query_no": F.lit(i), "query": F.lit(n)}) for i, (x, n) in enumerate(zip(_two_lists(spark, sf), ("dense", "label"), strict=True))]
    out = retrieval.multi_query(rows[0].unionByName(rows[1]), 8)
    return out.select("question_id", "chunk_id", F.round("score", 9).alias("score"), F.round("raw_score", 5).alias("raw_score"), F.array_join("matched_queries", ",").alias("matched"), "rank")


_OVERLAP = f"""pairs AS (SELECT h.query_id, h.chunk_id, list_distinct({_LEX.format('b.text')}) AS q, list_distinct({_LEX.format('c.text')}) AS t FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN chunks c ON c.chunk_id = h.chunk_id),
 o AS (SELECT query_id, chunk_id, len(list_intersect(q, t)) AS n, len(q) AS a, len(t) AS b FROM pairs),
 re AS (SELECT query_id, chunk_id, round(n / greatest(a, 1) + 0.5 * n / greatest(b, 1), 9) AS score FROM o)"""


@query(f"WITH {_BM25}, {_OVERLAP} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM re QUALIFY rank <= 2")
def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _fixed(spark, sf)
    base = retrieval.bm25(retrieval.LexicalIndex(chunks).persist(), _questions(spark, sf), 4)
    return retrieval.rerank(base, _questions(spark, sf), chunks, 2).withColumn("score", F.round("score", 6))


# evaluation

_REL = """rel AS (SELECT b.item_id AS query_id, list_sort(list_distinct(list('doc::' || d.doc_id))) AS ids FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"""
_FLAGS = f"""WITH {_BM25}, {_REL}, f AS (SELECT h.query_id, h.rank, c.doc_id, coalesce(r.ids, []) AS ids,
  (list_contains(coalesce(r.ids, []), c.doc_id) OR (n.a <> '' AND contains({_NORM.format('c.text')}, n.a))) AS flag
 FROM hits h JOIN chunks c USING (chunk_id) LEFT JOIN rel r ON r.query_id = h.query_id JOIN (SELECT item_id, {_NORM.format('text')} AS a FROM benchmark) n ON n.item_id = h.query_id)"""
_METRICS = f"""{_FLAGS}, g AS (SELECT query_id, any_value(ids) AS ids, avg(CAST(flag AS INT)) AS p, max(CAST(flag AS INT)) AS hit, len(list_intersect(any_value(ids), list_distinct(list(doc_id)))) AS n FROM f GROUP BY query_id),
 m AS (SELECT query_id, p AS precision_at_k, CASE WHEN len(ids) > 0 THEN n / len(ids) ELSE hit END AS recall_at_k, CASE WHEN len(ids) > 0 THEN n / len(ids) ELSE 0.0 END AS coverage, CASE WHEN len(ids) > 0 AND n = len(ids) THEN 1.0 ELSE 0.0 END AS all_found FROM g)"""


def _bm25_hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs, examples = datasets.from_tables(spark, sf)
    chunks = chunking.build(docs, {"name": "fixed_128", "type": "fixed", "chunk_size": 128, "chunk_overlap": 19})
    questions = examples.select(F.substring_index("example_id", "::", -1).cast("long").alias("question_id"), "question", "answers", "relevant_doc_ids")
    found = retrieval.bm25(retrieval.LexicalIndex(chunks).persist(), questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query")), 4)
    return found.join(chunks.select("chunk_id", "doc_id", "title", "text"), "chunk_id").withColumnRenamed("query_id", "question_id"), questions


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in fixed windows, BM25 for every benchmark question, retrieval metrics by question."""
    hits, questions = _bm25_hits(spark, sf)
    m = evaluation.retrieval_metrics(hits, questions)
    return m.select(F.col("question_id").alias("query_id"), *(F.round(c, 6).alias(n) for c, n in (("precision_at_k", "precision_at_k"), ("recall_at_k", "recall_at_k"), ("supporting_doc_coverage", "coverage"), ("all_supporting_docs_found", "all_found"))))


@query(f"{_FLAGS} SELECT query_id, CAST(rank AS INT) AS rank, doc_id, flag FROM f")
def relevance_flags(spark: SparkSession, sf: str) -> DataFrame:
    hits, q = _bm25_hits(spark, sf)
    x = hits.join(q.select("question_id", "answers", "relevant_doc_ids"), "question_id")
    return x.select(F.col("question_id").alias("query_id"), "rank", "doc_id", evaluation.relevant_flag(F.col("doc_id"), F.col("text"), F.col("relevant_doc_ids"), F.col("answers")).alias("flag"))


@query(f"{_METRICS} SELECT query_id, round(precision_at_k, 6) AS precision_at_k, round(CAST(recall_at_k AS DOUBLE), 6) AS recall_at_k, round(CAST(coverage AS DOUBLE), 6) AS coverage, round(CAST(all_found AS DOUBLE), 6) AS all_found FROM m")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)


@query(f"{_METRICS} SELECT count(*) AS num_examples, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(coverage), 6) AS coverage, round(avg(all_found), 6) AS all_found FROM m")
def system_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = flagship(spark, sf)
    return m.agg(F.count("*").alias("num_examples"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision_at_k", "recall_at_k", "coverage", "all_found")))


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalize_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_answer("text")).alias("digest"))


_QA_F1 = f"""WITH {_TURNS}, x AS (SELECT conv_id, turn, list_filter(string_split({_NORM.format('question')}, ' '), lambda t: t <> '') AS p, list_filter(string_split({_NORM.format('answer')}, ' '), lambda t: t <> '') AS g FROM qa),
 y AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda a: a = t)), len(list_filter(g, lambda a: a = t))))), 0) AS n FROM x)"""


@query(f"{_QA_F1} SELECT conv_id, turn, round(CAST({_F1} AS DOUBLE), 6) AS f1 FROM y")
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.round(T.token_f1("question", "answer"), 6).alias("f1"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, CAST({_NORM.format('question')} = {_NORM.format('upper(question)')} AS DOUBLE) AS same, CAST({_NORM.format('question')} = {_NORM.format('answer')} AS DOUBLE) AS em FROM qa")
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", T.exact_match("question", F.upper("question")).alias("same"), T.exact_match("question", "answer").alias("em"))


@query(f"""WITH d AS MATERIALIZED (SELECT doc_id, {_NORM.format('text')} AS t FROM documents), b AS MATERIALIZED (SELECT item_id, {_NORM.format('text')} AS a FROM benchmark)
SELECT doc_id, item_id, a <> '' AND contains(t, a) AS found FROM d, b""")
def contains_answer(spark: SparkSession, sf: str) -> DataFrame:
    # each text is normalised once and bound, not once a pair; the pairs are the result
    items = _table(spark, sf, "benchmark").agg(F.collect_list(F.struct("item_id", T.normalize_answer("text").alias("a"))).alias("items"))
    pairs = T.let(T.normalize_answer("text"), lambda t: F.transform("items", lambda i: F.struct(i["item_id"].alias("item_id"), ((i["a"] != "") & F.contains(t, i["a"])).alias("found"))))
    return _table(spark, sf, "documents").select("doc_id", "text").crossJoin(items).select("doc_id", F.inline(pairs))


@query(f"{_QA_F1}, z AS (SELECT conv_id, {_F1} AS f1 FROM y) SELECT conv_id % 10 AS bucket, count(*) AS num_examples, round(avg(f1), 6) AS f1_mean, round(coalesce(stddev_samp(f1), 0), 6) AS f1_std, round(min(f1), 6) AS f1_min, round(max(f1), 6) AS f1_max FROM z GROUP BY ALL")
def seed_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    x = _turns(spark, sf).withColumn("f1", T.token_f1("question", "answer"))
    return x.groupBy((F.col("conv_id") % 10).alias("bucket")).agg(F.count("*").alias("num_examples"), F.round(F.avg("f1"), 6).alias("f1_mean"), F.round(F.coalesce(F.stddev_samp("f1"), F.lit(0.0)), 6).alias("f1_std"), F.round(F.min("f1"), 6).alias("f1_min"), F.round(F.max("f1"), 6).alias("f1_max"))


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    x = _turns(spark, sf).select((F.col("conv_id") % 5).alias("bucket"), F.concat_ws("-", "conv_id", "turn").alias("example_id"), T.token_f1("question", "answer").alias("f1"))
    return evaluation.bootstrap_intervals(x, ["bucket"], ("f1",))


@query("SELECT source AS \"group\", max_by(doc_id, {s: n_chars, d: doc_id}) AS doc_id, max(n_chars) AS n_chars FROM documents WHERE source IS NOT NULL GROUP BY source")
def argmax_per_group(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "documents").withColumnRenamed("source", "group")
    return evaluation.best_per_group(x, "group", "n_chars", "doc_id")


@query("SELECT lang AS dataset, list_aggregate(list_sort(list(source)), 'string_agg', ',') AS winners FROM (SELECT lang, source, avg(n_chars) AS m, max(avg(n_chars)) OVER (PARTITION BY lang) AS top FROM documents GROUP BY lang, source) WHERE abs(m - top) < 1e-9 GROUP BY lang")
def winners(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset"), F.col("source").alias("system")).agg(F.avg("n_chars").alias("f1"))
    return report.winners(x).select("dataset", F.array_join("winners", ",").alias("winners"))


@query("SELECT lang, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS poor, round(avg(n_chars), 4) AS avg_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang ORDER BY lang")
def report_pivot(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id")
    return x.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"), F.round(F.avg("n_chars"), 4).alias("avg_chars")).orderBy("lang")


# answers


@query(r"""WITH x AS (SELECT conv_id, turn, trim(regexp_replace(string_split(trim(text), chr(10))[1], '^\s*\[\d+\]\s*', '')) AS s FROM (SELECT conv_id, turn, '[3] Answer: ' || text || ' [1]' AS text FROM conversations WHERE length(trim(text)) > 0 AND text NOT LIKE '%' || chr(10) || '%')),
 y AS (SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(regexp_replace(s, '^\s*(?i:answer|final answer)\s*:\s*', ''), '^\s*(?i:the answer is)\s+', '')), '^["''`]+|["''`]+$', '', 'g')) AS s FROM x)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(s, '\s+\[\d+\]\s*$', ''), '(?i)\s*\([^)]*implies[^)]*\)\s*$', ''), '[ .;:]+$', '') AS said FROM y""")
def normalize_qa_response(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "conversations").where(~F.contains("text", F.lit("\n")) & (F.length(F.trim("text")) > 0))
    return x.select("conv_id", "turn", T.normalize_response(F.concat(F.lit("[3] Answer: "), "text", F.lit(" [1]"))).alias("said"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'over ' || doc_id || ' million' ELSE 'about ' || doc_id || ' acts' END AS said FROM documents")
def compress_answer_quantity(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    answer = F.concat(F.lit("There were "), F.when(even, F.concat(F.lit("over "), "doc_id", F.lit(" million people"))).otherwise(F.concat(F.lit("about "), "doc_id", F.lit(" acts there"))))
    return _table(spark, sf, "documents").select("doc_id", T.compress_answer(F.lit("How many were there?"), answer).alias("said"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS said FROM orders")
def compress_answer_date(spark: SparkSession, sf: str) -> DataFrame:
    o = _table(spark, sf, "orders")
    return o.select("o_orderkey", T.compress_answer(F.lit("When was it placed?"), F.concat(F.lit("It was placed on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" by a customer"))).alias("said"))


@query(r"""WITH x AS (SELECT conv_id, turn, text AS a, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n, regexp_matches(text, '[\[\]():]') AS m, lower(text) AS l FROM conversations)
SELECT conv_id, turn, CASE WHEN a = '' OR a = 'unanswerable' OR (n <= 4 AND NOT m) THEN false ELSE n >= 7 OR m OR regexp_matches(l, ' (is|are|was|were|from|to|implies|owned by|founded by|performed by|played by) ') END AS again FROM x""")
def should_refine(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").select("conv_id", "turn", T.should_refine("text").alias("again"))


_UNIQUE = _Sql("list_filter({0}, lambda x, i: list_position({0}, x) = i)")
_VARIANTS = rf"""k AS (SELECT item_id, text, {_KEYS.format('text')} AS k, list_filter(list_transform(regexp_extract_all(text, '(?:[A-Z][\p{{L}}\p{{N}}_/-]*{_WS}*){{1,4}}'), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS c FROM benchmark),
 parts AS (SELECT item_id, k, list_filter([{_TRIM.format('text')}, CASE WHEN len(k) > 0 THEN array_to_string(k[1:12], ' ') END, CASE WHEN len(c) > 0 THEN array_to_string(({_UNIQUE.format('c')})[1:2], ' ') END,
   CASE WHEN len(k) >= 6 THEN array_to_string(k[1:len(k) // 2], ' ') END, CASE WHEN len(k) >= 6 THEN array_to_string(k[len(k) // 2 + 1:], ' ') END], lambda x: x IS NOT NULL AND x <> '') AS p FROM k),
 vs AS (SELECT item_id, k, ({_UNIQUE.format('p')})[1:4] AS v FROM parts)"""


@query(f"WITH {_VARIANTS} SELECT item_id, array_to_string(v, '|') AS variants FROM vs")
def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select("item_id", F.array_join(T.query_variants("text"), "|").alias("variants"))


@query(f"WITH {_VARIANTS} SELECT item_id, array_to_string(CASE WHEN len(v) > 1 THEN v[2:4] ELSE [] END, '|') AS subqueries FROM vs WHERE len(v) > 1")
def plan_subqueries(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").where(F.size(T.query_variants("text")) > 1).select("item_id", F.array_join(T.plan_subqueries("text"), "|").alias("subqueries"))


@query(f"""WITH {_BM25}, h AS (SELECT query_id, rank AS place, doc_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) > 1 AS again FROM hits JOIN chunks USING (chunk_id)),
 n AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY again, place) AS INT) AS rank FROM h)
SELECT query_id, doc_id, rank FROM n WHERE rank <= 3""")
def diverse_evidence(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = _bm25_hits(spark, sf)
    return evidence.diverse(hits, 3).select(F.col("question_id").alias("query_id"), "doc_id", "rank")


_SUPPORT = f"""WITH {_TURNS}, s AS (SELECT conv_id, turn, list_distinct({_KEYS.format('question')}) AS a, {_LEX.format('answer')} AS e FROM qa),
 z AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, list_distinct(e))) / len(a) END AS support FROM s)"""


@query(f"{_SUPPORT} SELECT conv_id, turn, round(CAST(support AS DOUBLE), 6) AS support FROM z")
def support_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.round(T.support("question", F.array("answer")), 6).alias("support"))


@query(f"{_SUPPORT} SELECT CASE WHEN support >= 0.75 THEN 'high' WHEN support >= 0.4 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM z GROUP BY ALL")
def support_label(spark: SparkSession, sf: str) -> DataFrame:
    x = _turns(spark, sf).select(T.support_label(T.support("question", F.array("answer"))).alias("label"))
    return x.groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {_BM25} SELECT query_id, md5(string_agg('[' || rank || '] Title: ' || title || chr(10) || 'Matched queries: q' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id""")
def context_format(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = _bm25_hits(spark, sf)
    out = evidence.contexts(evidence.uncompressed(hits.withColumn("matched_queries", F.array(F.lit("q")))), False)
    return out.select(F.col("question_id").alias("query_id"), F.md5("context").alias("digest"))


@query(f"WITH {_BM25} SELECT query_id, CAST(rank AS INT) AS \"index\", doc_id, substring({_TRIM.format('text')}, 1, 280) AS snippet, round(score, 4) AS score FROM hits JOIN chunks USING (chunk_id)")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = _bm25_hits(spark, sf)
    out = evidence.citations(evidence.uncompressed(hits.withColumn("matched_queries", F.array(F.lit("q")))))
    return out.select(F.col("question_id").alias("query_id"), "index", "doc_id", "snippet", "score")


@query()
def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", generation.extractive_answer("question", "answer").alias("said"))


@query("SELECT conv_id, turn, 'I do not have grounded context yet.' AS said FROM conversations WHERE role = 'user'")
def parametric_baseline(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "conversations").where("role = 'user'").withColumnRenamed("text", "question").withColumn("context", F.lit(None).cast("string"))
    return generation.extractive(x).select("conv_id", "turn", F.col("prediction").alias("said"))


def _live(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    index = live.build_index(_docs(spark, sf), "fixed", 128, 16, retriever="bm25")
    q = _table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return live.run(index, q, mode).answers.select("question_id", "mode", "answer", "answer_support", "support_label")


@query()
def live_traditional(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf, "traditional")


@query()
def live_advanced(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf, "advanced")


@query()
def live_multi_agent(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf, "multi_agent")


# sources and reports


@query("SELECT doc_id FROM (SELECT doc_id, md5('42:' || doc_id) AS h FROM documents) ORDER BY h, doc_id LIMIT 50")
def pool_sample_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", datasets.shuffled("doc_id", 42).alias("h")).orderBy("h", "doc_id").limit(50).select("doc_id")


_SQUAD = """base AS (SELECT doc_id AS id, source AS title, lang AS context, md5('42:' || doc_id) AS o FROM documents), pool AS (SELECT *, row_number() OVER (ORDER BY o, id) AS pos FROM base QUALIFY pos <= 200),
 turns AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY pos) AS turn, md5('42:' || title) AS t FROM pool), chosen AS (SELECT * FROM turns ORDER BY turn, t, title LIMIT 40)"""


def _squad_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("context"), F.lit("q").alias("question"), F.array(F.lit("a")).alias("answers"))


@query(f"WITH {_SQUAD} SELECT 'squad::' || id AS example_id, 'squad::' || title AS relevant FROM chosen")
def round_robin_questions(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.squad_like(_squad_rows(spark, sf), 40)[1].select("example_id", F.col("relevant_doc_ids")[0].alias("relevant"))


@query(f"WITH {_SQUAD}, c AS (SELECT title, context, min(pos) AS p FROM pool WHERE title IN (SELECT title FROM chosen) GROUP BY title, context) SELECT 'squad::' || title AS doc_id, string_agg(context, chr(10) || chr(10) ORDER BY p) AS text FROM c GROUP BY title")
def grouped_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.squad_like(_squad_rows(spark, sf), 40)[0].select("doc_id", "text")


@query("SELECT source AS title, min_by(doc_id, {o: md5('42:' || doc_id), d: doc_id}) AS doc_id FROM documents GROUP BY source")
def first_doc_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"),
        F.struct(F.array("source").alias("title"), F.array(F.array(F.col("doc_id").cast("string"))).alias("sentences")).alias("context"), F.struct(F.array("source").alias("title")).alias("supporting_facts"),
    )
    return datasets.hotpot_like(rows, None)[0].select("title", F.col("text").cast("long").alias("doc_id"))


def _files(spark: SparkSession, sf: str, suffix: str, content: F.Column) -> DataFrame:
    return _table(spark, sf, "pages").select(F.concat(F.lit("file:/up/page-"), F.col("page_id").cast("string"), F.lit(suffix)).alias("path"), F.encode(content, "UTF-8").alias("content"))


@query("SELECT 'upload::page-' || page_id AS doc_id, 'page-' || page_id AS title, md5(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) AS digest FROM pages")
def text_docs(spark: SparkSession, sf: str) -> DataFrame:
    return uploads.documents(_files(spark, sf, ".html", F.col("html"))).select("doc_id", "title", F.md5("text").alias("digest"))


@query("SELECT 'upload::page-' || page_id || '::0' AS doc_id, 'page-' || page_id || ' row 1' AS title, 'page: ' || page_id || ' link: ' || url AS text FROM pages")
def csv_docs(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("page,link\n"), F.col("page_id").cast("string"), F.lit(',"'), "url", F.lit('"\n'))
    return uploads.documents(_files(spark, sf, ".csv", body)).select("doc_id", "title", "text")


@query("SELECT 'upload::page-' || page_id || '::' || i AS doc_id, CASE i WHEN 0 THEN url ELSE 'page-' || page_id || ' item 2' END AS title, CASE i WHEN 0 THEN 'page ' || page_id ELSE CAST(page_id AS VARCHAR) END AS text FROM pages, range(2) r(i)")
def json_docs(spark: SparkSession, sf: str) -> DataFrame:
    item = F.to_json(F.struct(F.col("url").alias("title"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("content")))
    return uploads.documents(_files(spark, sf, ".json", F.concat(F.lit("["), item, F.lit(", "), F.col("page_id").cast("string"), F.lit("]")))).select("doc_id", "title", "text")


@query()
def payload_digest(spark: SparkSession, sf: str) -> DataFrame:
    return uploads.payload_digest(_files(spark, sf, ".html", F.col("html")), {"chunk_size": 128})


@query()
def index_digest(spark: SparkSession, sf: str) -> DataFrame:
    # one aggregate: a row made in the driver would start Python workers to write it
    return digest_row(_fixed(spark, sf), "hashed_bag")


@query("SELECT DISTINCT source, CAST(regexp_extract('fixed_' || n_chars, '_(\\d+)$', 1) AS INT) AS size FROM documents")
def chunk_size_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("source", T.chunk_size_of(F.concat(F.lit("fixed_"), F.col("n_chars").cast("string"))).alias("size")).distinct()


@query("SELECT source AS system, CAST(list_position(['src3', 'src1', 'src0', 'src2'], source) AS BIGINT) AS place, count(*) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3') GROUP BY source")
def order_by_system_list(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "documents").groupBy(F.col("source").alias("system")).agg(F.count("*").alias("n"))
    return report.ordered(x, ["src3", "src1", "src0", "src2"]).select("system", F.col("place").cast("long").alias("place"), "n")


@query("SELECT source AS system, round(avg(n_chars), 4) AS f1 FROM documents WHERE lang = 'en' GROUP BY source ORDER BY f1 DESC, system")
def dashboard_filter_sort(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "documents").groupBy(F.col("source").alias("system"), F.col("lang").alias("dataset")).agg(F.round(F.avg("n_chars"), 4).alias("f1"))
    return report.dashboard_results(x, dataset="en").select("system", "f1")


@query("SELECT source AS title, doc_id, length(text) AS characters FROM documents ORDER BY doc_id LIMIT 24")
def corpus_preview(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "documents").select(F.col("source").alias("title"), "doc_id", "text")
    return report.corpus_preview(x).withColumn("characters", F.col("characters").cast("long"))


@query("SELECT quality, count(*) AS n, printf('%.1f', 100.0 * avg(toxic)) AS toxic_pct FROM labels GROUP BY quality")
def percent_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("n"), T.percent(F.avg("toxic")).alias("toxic_pct"))
