"""Queries of sparse and dense retrieval, scores and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import shared
from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.operators import retrieval as R
from tessera.plans.registry import query

# Fixed values of the sample queries.
TERMS = ("the", "and", "licensed", "scum", "version")
TOP = 20

TOKENS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
BM25_SQL = f"""
WITH d AS (SELECT doc_id, lang, {TOKENS_SQL} AS ws FROM documents),
q AS (SELECT unnest({list(TERMS)}) AS term),
c AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avgdl FROM d),
o AS (SELECT doc_id, lang, len(ws) AS dl, unnest(ws) AS term FROM d),
h AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT doc_id, lang, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM h JOIN f USING (term), c GROUP BY doc_id, lang)
"""


def _terms(t):
    return t.spark.createDataFrame([("q", x) for x in TERMS], "query string, term string")


def _bm25(t, scope=None):
    return R.bm25_scores(t.documents, X.word_tokens(F.col("text")), _terms(t), scope=scope)


def _ranked(t):
    # scores are rounded before they are ranked, so that equal ones tie whatever the order of summing
    return R.top_k(_bm25(t).withColumn("score", F.round("score", 6)), TOP, ["query"])


@query(BM25_SQL + f"SELECT doc_id AS doc, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id)::INTEGER AS rank FROM s ORDER BY rank LIMIT {TOP}")
def bm25_topk_documents(t):
    return _ranked(t).select("doc", "score", "rank")


@query(BM25_SQL + f"SELECT doc_id AS doc, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id)::INTEGER AS rank FROM s WHERE lang = 'de' ORDER BY rank LIMIT {TOP}")
def bm25_topk_scoped(t):
    return R.top_k(_bm25(t, F.col("lang") == "de").withColumn("score", F.round("score", 6)), TOP, ["query"]).select("doc", "score", "rank")


@query(f"SELECT doc_id AS doc, len({TOKENS_SQL}) AS len FROM documents")
def bm25_doc_stats(t):
    return R.doc_stats(t.documents, X.word_tokens(F.col("text")))


@query(f"SELECT count(*) AS n_docs, round(coalesce(avg(len({TOKENS_SQL})), 0), 6) AS avgdl FROM documents")
def bm25_avgdl(t):
    return R.average_length(R.doc_stats(t.documents, X.word_tokens(F.col("text")))).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH o AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM o GROUP BY term")
def bm25_term_stats(t):
    found = R.postings(t.documents, X.word_tokens(F.col("text")))
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("SELECT p_partkey, list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(replace(p_name || 'XMLNode_' || p_type, ' ', ''), '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_'), lambda x: x <> ''), lambda x: lower(x)) AS words FROM part")
def identifier_split_tokens(t):
    name = F.concat(F.col("p_name"), F.lit("XMLNode_"), F.col("p_type"))
    return t.part.select("p_partkey", X.split_identifier(F.replace(name, F.lit(" "), F.lit(""))).alias("words"))


@query("SELECT p_partkey, list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(replace(p_name || 'XMLNode_' || p_type, ' ', '') , '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_|([^A-Za-z0-9])'), lambda x: x <> ''), lambda x: lower(x)) AS tokens FROM part")
def code_tokens_parts(t):
    name = F.concat(F.col("p_name"), F.lit("XMLNode_"), F.col("p_type"))
    return t.part.select("p_partkey", X.code_tokens(F.replace(name, F.lit(" "), F.lit(""))).alias("tokens"))


@query("SELECT doc_id, (ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents")
def token_count_approx(t):
    return t.documents.select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) > 64 THEN left(text, 256) ELSE text END AS text FROM documents")
def trim_to_budget(t):
    return t.documents.select("doc_id", X.trim_to_tokens(F.col("text"), 64).alias("text"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10) || '... [truncated]' ELSE text END AS text FROM documents")
def truncate_lines(t):
    return t.documents.select("doc_id", X.truncate_lines(F.col("text"), 3).alias("text"))


@query("SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) <= 512 THEN text END AS text FROM documents")
def truncate_for_model(t):
    return t.documents.select("doc_id", X.truncate_for_model(F.col("text"), 512, "reject").alias("text"))


@query("SELECT o_orderkey, greatest(5, least(20, floor(o_totalprice / 200)))::INTEGER AS k FROM orders")
def top_k_for_budget(t):
    return t.orders.select("o_orderkey", X.top_k_for_budget(F.col("o_totalprice")).alias("k"))


@query("SELECT p_partkey, format('### {}\n`{}`\n```rust\n{}\n```', p_name, p_brand, p_type) AS markdown, format('{} ({})\n{}', p_name, p_brand, p_type) AS plain, to_json({'name': p_name, 'size': p_size})::VARCHAR AS json FROM part")
def format_results(t):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    json = F.to_json(F.struct(name.alias("name"), F.col("p_size").alias("size")))
    return t.part.select("p_partkey", X.markdown(name, brand, kind).alias("markdown"), X.plain(name, brand, kind).alias("plain"), json.alias("json"))


# ---- vectors

DIST_SQL = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _prompts(t):
    return t.embeddings.where("vec_id = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _queries(t):
    """The stated set of queries: every row whose id is divisible by 100."""
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


#: Every hundredth vector against all; KNN_SQL takes the queries of a list.
NEAR_SQL = f"WITH n AS (SELECT q.vec_id AS query, e.vec_id AS id, e.label, {DIST_SQL} AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)"
KNN_SQL = f"WITH n AS (SELECT q.vec_id AS query, e.vec_id AS id, e.label, {DIST_SQL} AS distance FROM embeddings q, embeddings e WHERE q.vec_id IN %s)"


@query(NEAR_SQL + " SELECT query, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, id)::INTEGER AS rank FROM n QUALIFY rank <= 20")
def knn_l2_topk(t):
    return R.knn(_queries(t), _vectors(t), TOP).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query(NEAR_SQL + " SELECT query, id, round(1 - distance, 6) AS score FROM n WHERE label = 3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, id) <= 20")
def knn_prefilter_label(t):
    return R.dense_scores(R.knn(_queries(t), _vectors(t), TOP, where=F.col("label") == 3)).select("query", "id", F.round("score", 6).alias("score"))


@query(NEAR_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM n) SELECT query, id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 100 AND label = 3")
def knn_postfilter_label(t):
    return R.knn(_queries(t), _vectors(t), 100, post_filter=F.col("label") == 3).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH n AS (SELECT q.vec_id AS id, e.vec_id AS neighbour, {DIST_SQL} AS distance FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id) SELECT id, neighbour, round(distance, 6) AS distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour)::INTEGER AS rank FROM n QUALIFY rank <= 5")
def knn_graph_per_label(t):
    return R.knn_graph(_vectors(t), 5, "label").select("id", "neighbour", F.round("distance", 6).alias("distance"), "rank")


RADIUS = 100.0


@query(NEAR_SQL + f" SELECT query, id, round(distance, 6) AS distance FROM n WHERE distance <= {RADIUS} QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, id) <= 50")
def radius_search(t):
    return R.knn(_queries(t), _vectors(t), 50, radius=RADIUS).select("query", "id", F.round("distance", 6).alias("distance"))


@query(NEAR_SQL + " SELECT query, label, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query, label ORDER BY distance, id)::INTEGER AS rank FROM n QUALIFY rank <= 3")
def multi_prompt_knn(t):
    return R.knn(_queries(t), _vectors(t), 3, by=["label"]).select("query", "label", "id", F.round("distance", 6).alias("distance"), "rank")


@query(NEAR_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY distance, id)::INTEGER AS rank FROM n) SELECT query, label, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 1 + query // 100 % 4 AND (query % 300 = 0 OR distance <= 90 + query % 50)")
def prompt_batch(t):
    """Prompts with limits of their own: one to four hits in each label, most of them within a radius."""
    asked = _queries(t)
    k, radius = (1 + F.floor(F.col("query") / 100) % 4).cast("int"), F.when(F.col("query") % 300 != 0, (90 + F.col("query") % 50).cast("double"))
    return R.knn_of_prompts(asked.withColumn("k", k).withColumn("radius", radius), _vectors(t), ["label"]).select("query", "label", "id", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, len(embedding) = 64 AS valid FROM embeddings")
def vector_validation(t):
    good = R.valid_vectors(t.embeddings.withColumnRenamed("embedding", "vector"), 64)
    return good.select("vec_id", F.round(S.norm(F.col("vector")), 5).alias("norm"), F.lit(True).alias("valid"))


@query(f"WITH v AS (SELECT vec_id, embedding FROM embeddings) SELECT e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS cosine FROM v e, v q WHERE q.vec_id = 0")
def cosine_to_prompt(t):
    one = F.broadcast(_prompts(t))
    return t.embeddings.join(one).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("vector")), 5).alias("cosine"))


# ---- normalisation and fusion

LIST_SQL = BM25_SQL + f", r AS (SELECT doc_id AS doc, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= {TOP})"


@query(LIST_SQL + " SELECT doc, round(least(1, greatest(0, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-6))), 6) AS score FROM r")
def score_minmax(t):
    return _ranked(t).select("doc", F.round(S.minmax(F.col("score"), ["query"]), 6).alias("score"))


@query(LIST_SQL + " SELECT doc, round((score - avg(score) OVER ()) / greatest(stddev_pop(score) OVER (), 1e-6), 5) AS score FROM r")
def score_zscore(t):
    return _ranked(t).select("doc", F.round(S.zscore(F.col("score"), ["query"]), 5).alias("score"))


@query(LIST_SQL + " SELECT doc, round(1 / (1 + exp(-2.0 * (score - 1.0))), 6) AS score FROM r")
def score_logistic(t):
    return _ranked(t).select("doc", F.round(S.logistic(F.col("score"), 1.0, 2.0), 6).alias("score"))


def _dense_ranked(t):
    # documents and vectors are taken to share ids: doc_id = vec_id
    return R.knn(_prompts(t), _vectors(t), TOP).select(F.lit("q").alias("query"), F.col("id").alias("doc"), "rank")


RRF_SQL = LIST_SQL + f""", n AS (SELECT e.vec_id AS doc, {DIST_SQL} AS distance FROM embeddings q, embeddings e WHERE q.vec_id = 0),
v AS (SELECT doc, row_number() OVER (ORDER BY distance, doc) AS rank FROM n QUALIFY rank <= {TOP}),
u AS (SELECT doc, sum(1.0 / (60 + rank)) AS score FROM (SELECT doc, rank FROM r UNION ALL SELECT doc, rank FROM v) GROUP BY doc)
SELECT doc, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc)::INTEGER AS rank FROM u QUALIFY rank <= {TOP}"""


@query(RRF_SQL)
def rrf_hybrid(t):
    fused = R.rrf([(_ranked(t), 1.0), (_dense_ranked(t), 1.0)]).withColumn("score", F.round("score", 9))
    return R.top_k(fused, TOP, ["query"]).select("doc", F.round("score", 6).alias("score"), "rank")


MMR_SQL = """
WITH RECURSIVE n AS (SELECT e.vec_id AS id, e.embedding AS x, %s AS distance FROM embeddings q, embeddings e WHERE q.vec_id = 0 ORDER BY distance, id LIMIT 50),
u AS (SELECT id, 1 - distance AS rel, list_transform(x, lambda y: y::DOUBLE / nullif(sqrt(list_sum(list_transform(x, lambda z: z::DOUBLE * z::DOUBLE))), 0)) AS v FROM n),
r AS (SELECT 0 AS rank, list({'id': id, 'rel': rel, 'v': v, 'sim': 0.0::DOUBLE} ORDER BY id) AS cs, NULL::BIGINT AS doc, NULL::DOUBLE AS objective FROM u
      UNION ALL SELECT rank + 1, list_transform(list_filter(cs, lambda c: c.id <> best.id), lambda c: {'id': c.id, 'rel': c.rel, 'v': c.v, 'sim': greatest(c.sim, list_dot_product(c.v, best.v))}), best.id, 0.7 * best.rel - 0.3 * best.sim
      FROM (SELECT rank, cs, list_reduce(cs, lambda a, b: CASE WHEN 0.7 * a.rel - 0.3 * a.sim >= 0.7 * b.rel - 0.3 * b.sim THEN a ELSE b END) AS best FROM r WHERE rank < 10))
SELECT 0 AS query, doc, round(objective, 6) AS objective, rank::INTEGER AS rank FROM r WHERE rank > 0
""" % DIST_SQL


@query(MMR_SQL)
def mmr_select(t):
    near = R.dense_scores(R.knn(_prompts(t), _vectors(t), 50)).select("query", F.col("id").alias("doc"), "score")
    vectors = _vectors(t).select(F.col("id").alias("doc"), "vector")
    return R.mmr(near.join(vectors, "doc"), 10).withColumn("objective", F.round("objective", 6))


@query(KNN_SQL % "(0)" + f", k AS (SELECT label, id, 1 - distance AS score FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, id) <= 5) SELECT id AS doc, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM k QUALIFY rank <= {TOP}")
def merge_kinds(t):
    per_kind = R.dense_scores(R.knn(_prompts(t), _vectors(t), 5, by=["label"])).select("query", F.col("id").alias("doc"), "score")
    return R.merge_kinds([per_kind.where(F.col("doc") % 2 == 0), per_kind.where(F.col("doc") % 2 == 1)], TOP).select("doc", F.round("score", 6).alias("score"), "rank")


@query(LIST_SQL + " SELECT doc, row_number() OVER (ORDER BY length(text) DESC, doc)::INTEGER AS rank FROM r JOIN documents ON doc_id = doc")
def rerank_by_length(t):
    texts = t.documents.select(F.col("doc_id").alias("doc"), F.length("text").alias("n"))
    return R.rerank(_ranked(t).join(texts, "doc"), F.col("n")).select("doc", "rank")


@query(LIST_SQL.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3)") + " SELECT doc, score, rank::INTEGER AS rank FROM r")
def bm25_after_removal(t):
    words = X.word_tokens(F.col("text"))
    index, gone = shared.materialize(R.postings(t.documents, words), "postings"), t.documents.where("doc_id % 10 = 3").select(F.col("doc_id").alias("doc"))
    # documents are taken out of what is read of the index, their lengths and the postings of the terms: both are written
    # before, as Spark would otherwise join the whole index with what is gone
    terms = F.broadcast(_terms(t))
    stats = R.remove_docs(shared.materialize(index.select("doc", "len").distinct(), "lengths"), gone)
    corpus = F.broadcast(R.average_length(stats))
    hits = shared.materialize(R.remove_docs(shared.materialize(index.join(terms, "term"), "found"), gone), "hits")
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))
    one = R.bm25(F.col("tf"), F.col("len"), F.col("avgdl"), R.idf(F.col("n_docs"), F.col("df")))
    scored = hits.join(df, "term").join(corpus).groupBy("query", "doc").agg(F.round(F.sum(one), 6).alias("score"))
    return R.top_k(scored, TOP, ["query"]).select("doc", "score", "rank")
