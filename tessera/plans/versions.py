"""Queries of versioned relations, pending work and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import maintenance as M
from tessera.operators import temporal as T
from tessera.plans.registry import query

AT = ("ts", "event_id")
V_SQL = "WITH v AS (SELECT user_id, ts, event_id, value, event_type <> 'error' AS is_assert FROM events)"
MOMENT = "2024-01-15 00:00:00"


def _versions(t):
    """events as a change log: the key is user_id, an error retracts."""
    return t.events.select("user_id", "ts", "event_id", "value", (F.col("event_type") != "error").alias("is_assert"))


@query(V_SQL + " SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE is_assert")
def live_versions(t):
    return T.live(_versions(t), ["user_id"], AT).select("user_id", "event_id", F.round("value", 6).alias("value"))


@query(V_SQL + ", m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS moment FROM v) SELECT user_id, event_id FROM (SELECT v.* FROM v, m WHERE ts <= to_timestamp(floor(epoch(moment)))::TIMESTAMP QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE is_assert")
def as_of_versions(t):
    span = t.events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lo, hi = (F.unix_micros(F.col(x).cast("timestamp")) for x in ("lo", "hi"))
    moment = F.broadcast(span.select(F.timestamp_seconds(F.floor((lo + F.floor((hi - lo) / 2)) / 1_000_000)).cast("timestamp_ntz").alias("__at")))
    versions = _versions(t).join(moment)
    return T.as_of(versions, ["user_id"], F.col("__at"), AT).select("user_id", "event_id")


@query(V_SQL + " SELECT user_id, count(*) AS versions, count(*) FILTER (is_assert) AS asserts FROM v GROUP BY user_id")
def history_count(t):
    return T.history(_versions(t), ["user_id"])


@query(V_SQL + " SELECT user_id FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE is_assert AND user_id % 3 <> 0")
def retract_then_live(t):
    versions = _versions(t)
    gone = t.events.where("user_id % 3 = 0").select("user_id").distinct()
    later = T.retract_rows(versions, gone, ["user_id"], F.timestamp_micros(F.lit(4_000_000_000_000_000)), AT)
    return T.live(later, ["user_id"], AT).select("user_id")


@query("SELECT user_id, count(*) AS versions FROM (SELECT user_id FROM events UNION ALL SELECT DISTINCT user_id FROM events WHERE user_id % 5 = 0) GROUP BY user_id")
def assert_then_history(t):
    fresh = t.events.where("user_id % 5 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max("value").alias("value"))
    return T.history(T.assert_rows(_versions(t), fresh, F.timestamp_micros(F.lit(4_000_000_000_000_000))), ["user_id"]).select("user_id", "versions")


@query("SELECT user_id, max_by(value, event_id) FILTER (event_type = 'purchase') AS purchase, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def merge_last_values(t):
    log = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase"), F.col("event_type").alias("last_type"))
    return T.merge_fields(log, "user_id", ["event_id"], ["purchase", "last_type"])


@query("SELECT event_id, (props::JSON ->> '$.k') AS k FROM events")
def json_field_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_unlabelled(t):
    return M.pending(t.documents, t.labels, "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def complete_labelled(t):
    return M.complete(t.documents, t.labels, "doc_id").select("doc_id")


@query("WITH p AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT count(*) AS pending, count(*) FILTER (lang = 'en') AS files, count(*) - count(*) FILTER (lang = 'en') AS others FROM p")
def pending_minus_files(t):
    files = F.count_if(F.col("lang") == "en")
    return M.pending(t.documents, t.labels, "doc_id").agg(F.count("*").alias("pending"), files.alias("files"), (F.count("*") - files).alias("others"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id::VARCHAR > '3' ORDER BY doc_id::VARCHAR LIMIT 50")
def keyset_page(t):
    return M.keyset_page(t.documents.select("doc_id", "lang"), "3", 50, "doc_id")


KINDS = ("1-URGENT", "3-MEDIUM", "2-HIGH")


@query(f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN {KINDS} ORDER BY list_position({list(KINDS)}, o_orderpriority), o_orderkey LIMIT 7000")
def page_fill_by_kind(t):
    return M.fill_by_kind(t.orders.select("o_orderkey", "o_orderpriority"), KINDS, 7000, "o_orderpriority", "o_orderkey")


IDS = (17, 3, 999999, 5, 3, 42)


@query(f"SELECT pos - 1 AS pos, doc_id, lang FROM (SELECT unnest({list(IDS)}) AS doc_id, generate_subscripts({list(IDS)}, 1) AS pos) JOIN documents USING (doc_id)")
def ordered_lookup(t):
    return M.ordered_lookup(t.documents.select("doc_id", "lang"), IDS, "doc_id").select("pos", "doc_id", "lang")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def stable_dedup(t):
    from tessera.operators.context import stable_dedup as dedup

    return dedup(t.documents.select("doc_id", F.sha2("text", 256).alias("hash")), "hash", [F.col("doc_id")]).select("doc_id")


@query("SELECT md5(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_relations(t):
    from tessera.operators.graph import duplicate_edges

    return duplicate_edges(t.documents.select(F.md5("text").alias("hash")), ["hash"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def percentiles(t):
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return t.events.groupBy("event_type").agg(*(F.round(F.percentile("value", p), 6).alias(n) for n, p in at.items()), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS kinds, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY p_brand")
def relation_stats(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("kinds"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("SELECT count(*) AS n FROM documents WHERE list_contains(['de', 'fr'], lang) AND n_chars >= 500 AND lang IS NOT NULL")
def scalar_predicates(t):
    return t.documents.where(F.col("lang").isin("de", "fr") & (F.col("n_chars") >= 500) & F.col("lang").isNotNull()).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_nationkey AS key FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def union_of_rules(t):
    a = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"))
    return a.unionByName(t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("key"))).distinct()


@query("SELECT x.v AS v, p_partkey FROM (VALUES (7, 'a'), (15, 'b'), (7, 'c')) x(size, v) JOIN part ON p_size = size")
def inline_relation(t):
    rows = t.spark.createDataFrame([(7, "a"), (15, "b"), (7, "c")], "size int, v string")
    return t.part.join(F.broadcast(rows), F.col("p_size") == F.col("size")).select("v", "p_partkey")


@query("SELECT l_suppkey AS model, count(*) AS requests, sum(l_quantity)::BIGINT AS prompt_tokens, sum(l_linenumber)::BIGINT AS completion_tokens, round(sum(l_discount), 6) AS cost, sum(l_quantity + l_linenumber)::BIGINT AS total_tokens FROM lineitem GROUP BY l_suppkey")
def usage_totals(t):
    """Lines as requests to a model (their supplier)."""
    from tessera.operators.maintenance import usage_totals as totals

    log = t.lineitem.select(F.col("l_suppkey").alias("model"), F.col("l_quantity").cast("long").alias("prompt_tokens"), F.col("l_linenumber").cast("long").alias("completion_tokens"), F.col("l_discount").cast("double").alias("cost"))
    return totals(log, ["model"]).withColumn("cost", F.round("cost", 6))
