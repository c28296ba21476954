"""Queries of context assembly and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.plans.registry import query


def _parts(t):
    """Documents as parts: one query a language, the source as file, the length as score."""
    return t.documents.select(
        F.col("lang").alias("query"), F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.lit("function").alias("kind"), "text", F.col("n_chars").cast("double").alias("score")
    )


PARTS_SQL = """
WITH c AS (SELECT lang AS query, doc_id AS id, source AS file_path, n_chars, CASE WHEN text IS NOT NULL THEN least(ceil(length(text) / 4.0), 200)::BIGINT END AS tokens, coalesce(ceil(length(text) / 4.0) > 200, false) AS truncated FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, id)::INTEGER AS position FROM c)
"""


@query(PARTS_SQL + " SELECT query, id, tokens, truncated, position, tokens IS NOT NULL AS admitted FROM p")
def context_budget(t):
    """Admission that only a single part beyond max_total would end (none is), without a limit for a file."""
    return C.assemble(_parts(t), max_total=4096, per_file=0, per_part=200, strict_total=False).select("query", "id", "tokens", "truncated", "position", "admitted")


FOLD_SQL = PARTS_SQL + """,
l AS (SELECT query, list({'id': id, 'tokens': tokens} ORDER BY position) AS ps FROM p WHERE tokens IS NOT NULL GROUP BY query),
f AS (SELECT query, list_reduce(list_transform(ps, lambda x: {'total': x.tokens, 'ids': [x.id]}), lambda s, x: CASE WHEN s.total + x.total <= 3000 THEN {'total': s.total + x.total, 'ids': list_concat(s.ids, x.ids)} ELSE s END, {'total': 0::BIGINT, 'ids': []::BIGINT[]}) AS s FROM l)
SELECT p.query, p.id, coalesce(list_contains(s.ids, p.id), false) AS admitted FROM p LEFT JOIN f ON f.query IS NOT DISTINCT FROM p.query
"""


@query(FOLD_SQL)
def context_strict_budget(t):
    """Every part that still fits under the total is admitted, in order."""
    return C.assemble(_parts(t), max_total=3000, per_file=0, per_part=200).select("query", "id", "admitted")


CAPS_SQL = PARTS_SQL.replace("200", "300").replace("ORDER BY n_chars DESC", "ORDER BY file_path NULLS FIRST, n_chars DESC") + """,
l AS (SELECT query, list({'id': id, 'file': coalesce(file_path, ''), 'tokens': tokens} ORDER BY position) AS ps FROM p WHERE tokens IS NOT NULL GROUP BY query),
f AS (SELECT query, list_reduce(list_transform(ps, lambda x: {'total': x.tokens, 'file': x.file, 'used': x.tokens, 'ids': [x.id]}), lambda s, x:
        CASE WHEN s.total + x.total <= 20000 AND (CASE WHEN s.file = x.file THEN s.used ELSE 0 END) + x.used <= 1500
             THEN {'total': s.total + x.total, 'file': x.file, 'used': (CASE WHEN s.file = x.file THEN s.used ELSE 0 END) + x.used, 'ids': list_concat(s.ids, x.ids)}
             ELSE {'total': s.total, 'file': x.file, 'used': CASE WHEN s.file = x.file THEN s.used ELSE 0 END, 'ids': s.ids} END,
        {'total': 0::BIGINT, 'file': '', 'used': 0::BIGINT, 'ids': []::BIGINT[]}) AS s FROM l)
SELECT p.query, p.id, p.file_path, p.tokens, p.position, coalesce(list_contains(s.ids, p.id), false) AS admitted FROM p LEFT JOIN f ON f.query IS NOT DISTINCT FROM p.query
"""


@query(CAPS_SQL)
def context_file_caps(t):
    return C.assemble(_parts(t), policy="file", max_total=20_000, per_file=1500, per_part=300).select("query", "id", "file_path", "tokens", "position", "admitted")


@query(PARTS_SQL + " SELECT query, coalesce(sum(tokens), 0)::BIGINT AS total_tokens, count(DISTINCT file_path) FILTER (tokens IS NOT NULL) AS files, count(tokens) AS parts, count(*) FILTER (truncated) AS truncated_parts, count(*) FILTER (id % 10 = 0) AS dedup_removed FROM p GROUP BY query")
def context_stats(t):
    """Every tenth document is given twice, the second time with a lower score."""
    parts = _parts(t).unionByName(_parts(t).where("id % 10 = 0").withColumn("score", F.col("score") - 1))
    return C.stats(C.assemble(parts, max_total=4096, per_file=0, per_part=200, strict_total=False), parts)


PLAN_SQL = FOLD_SQL.replace("lang AS query", "(doc_id % 4)::VARCHAR AS query")
PLAN_SQL = PLAN_SQL[: PLAN_SQL.rindex("SELECT p.query")] + """
, a AS (SELECT p.query, sum(CASE WHEN list_contains(s.ids, p.id) THEN tokens ELSE 0 END) AS part_tokens, count(*) FILTER (NOT coalesce(list_contains(s.ids, p.id), false)) AS excluded_parts FROM p LEFT JOIN f USING (query) GROUP BY p.query),
m AS (SELECT (conv_id % 4)::VARCHAR AS query, ceil(length(text) / 4.0)::BIGINT AS tokens, role = 'user' AS included FROM conversations),
n AS (SELECT query, sum(CASE WHEN included THEN tokens ELSE 0 END) AS message_tokens, count(*) FILTER (NOT included) AS excluded_messages FROM m GROUP BY query),
b AS (SELECT query, coalesce(message_tokens, 0)::BIGINT AS message_tokens, coalesce(excluded_messages, 0) AS excluded_messages, coalesce(part_tokens, 0)::BIGINT AS part_tokens, coalesce(excluded_parts, 0) AS excluded_parts FROM n FULL JOIN a USING (query))
SELECT *, message_tokens + part_tokens AS estimated_tokens FROM b
"""


@query(PLAN_SQL)
def context_plan(t):
    from tessera.functions.text import approx_tokens

    messages = t.conversations.select((F.col("conv_id") % 4).cast("string").alias("query"), approx_tokens(F.col("text")).alias("tokens"), (F.col("role") == "user").alias("included"))
    # documents are dealt to the queries of the messages as their parts
    parts = C.assemble(_parts(t).withColumn("query", (F.col("id") % 4).cast("string")), max_total=3000, per_file=0, per_part=200)
    return C.plan(messages, parts)


def _messages(t):
    from tessera.functions.text import approx_tokens

    last = F.when(F.col("turn") % 3 != 0, F.col("turn") * 7 % 11)
    return t.conversations.where("text is not null").select(
        F.col("conv_id").alias("conv"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("turn").alias("path_index"), last.alias("last_included"),
        (F.col("turn") % 2).alias("include_count"), approx_tokens(F.col("text")).alias("tokens"), F.when(F.col("turn") % 4 == 1, F.lit(0)).alias("ttl"),
    )


LEASE_SQL = """
WITH m AS (SELECT conv_id AS conv, conv_id || ':' || turn AS id, turn, CASE WHEN turn % 3 <> 0 THEN turn * 7 % 11 END AS last_included, turn % 2 AS include_count, ceil(length(text) / 4.0)::BIGINT AS tokens, turn % 4 = 1 AS expired FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv, expired ORDER BY coalesce(last_included, 0) DESC, include_count DESC, turn DESC, id)::INTEGER AS lease_rank FROM m)
"""


@query(LEASE_SQL + " SELECT conv, id, lease_rank FROM r")
def lease_order(t):
    return C.select_leased(_messages(t), 10**9).select("conv", "id", "lease_rank")


@query(
    LEASE_SQL
    + """, l AS (SELECT conv, list({'k': lease_rank, 'n': tokens} ORDER BY lease_rank) AS ms FROM r WHERE NOT expired GROUP BY conv),
f AS (SELECT conv, list_reduce(list_transform(ms, lambda x: {'total': x.n, 'ks': [x.k]}), lambda s, x: CASE WHEN len(s.ks) = 0 OR s.total + x.total <= 120 THEN {'total': s.total + x.total, 'ks': list_concat(s.ks, x.ks)} ELSE s END, {'total': 0::BIGINT, 'ks': []::INTEGER[]}) AS s FROM l)
SELECT r.conv, id, NOT expired AND coalesce(list_contains(s.ks, lease_rank), false) AS included, CASE WHEN expired THEN 'TtlExpired' WHEN NOT coalesce(list_contains(s.ks, lease_rank), false) THEN 'Budget' END AS reason FROM r LEFT JOIN f ON f.conv = r.conv"""
)
def leased_messages(t):
    return C.select_leased(_messages(t), 120).select("conv", "id", "included", "reason")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 5 > 0 THEN turn % 5 - 1 END AS ttl FROM conversations")
def ttl_decrement(t):
    kind = F.when(F.col("role") == "user", "Leased").otherwise("Pinned")
    return t.conversations.select("conv_id", "turn", C.decrement_ttl(kind, F.col("turn") % 5).alias("ttl"))


@query("WITH m AS (SELECT * FROM conversations WHERE length(text) > 0), c AS (SELECT * FROM m WHERE turn % 3 = 2 QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) = 1) SELECT conv_id AS conv, turn AS path_index, role AS atom, ceil(length(text) / 4.0)::BIGINT AS tokens FROM m WHERE turn % 3 <> 2 UNION ALL SELECT conv_id, turn, 'call', ceil(length(text) / 4.0)::BIGINT FROM c UNION ALL SELECT conv_id, turn, 'result', 1 FROM c")
def budget_atoms(t):
    role = F.when(F.col("turn") % 3 == 2, F.lit("tool_call")).otherwise(F.col("role"))
    m = t.conversations.where(F.length("text") > 0)
    messages = m.select(F.col("conv_id").alias("conv"), F.col("turn").alias("path_index"), role.alias("role"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text", (F.col("turn") % 2).alias("call_id"), F.lit("done").alias("result"))
    return C.budget_atoms(messages).select("conv", "path_index", "atom", "tokens")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn >= 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def conversation_tail(t):
    from tessera.operators.maintenance import latest_by_parent

    return latest_by_parent(t.conversations.where("turn >= 2"), "conv_id", "turn", "role", 2).select("conv_id", "turn", "role")
