"""Queries of changes, masks, edits, event logs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import ids as I
from tessera.functions import text as X
from tessera.operators import maintenance as M
from tessera.plans.registry import query


@query("SELECT member, change FROM (SELECT n_name AS member, 'added' AS change FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 <> 0 UNION ALL SELECT n_name, 'removed' FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0)")
def workspace_drift(t):
    names = t.nation.select(F.col("n_name").alias("member"), "n_nationkey")
    return M.drift(names.where("n_nationkey % 2 = 0"), names.where("n_nationkey % 3 = 0"))


@query("SELECT c_nationkey AS key FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0")
def except_sets(t):
    return t.customer.select(F.col("c_nationkey").alias("key")).distinct().join(t.supplier.where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("key")), "key", "left_anti")


@query("SELECT p_partkey, triple, profile, features FROM part, (VALUES ('x86'), ('arm')) a(triple), (VALUES ('dev'), ('release')) b(profile), (VALUES (''), ('a,b')) c(features)")
def cu_cross_product(t):
    units = M.cross_units(t.part.select("p_partkey"), ["x86", "arm"], ["dev", "release"], [[], ["b", "a", "b"]])
    return units.withColumn("features", F.array_join("features", ","))


@query("SELECT p_partkey FROM part WHERE p_size % 5 IN (1, 3)")
def cu_mask_semi(t):
    enabled = t.part.select((F.col("p_size") % 5).alias("cu_id"), F.col("p_partkey").alias("node_id"))
    return M.mask_nodes(t.part, enabled, [1, 3], "p_partkey").select("p_partkey")


@query("SELECT a.p_size % 5 AS cu_id, a.p_partkey AS source_id, b.p_partkey AS target_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_size % 5 = b.p_size % 5")
def cu_mask_edges(t):
    enabled = t.part.select((F.col("p_size") % 5).alias("cu_id"), F.col("p_partkey").alias("node_id"))
    edges = t.part.select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") + 1).alias("target_id"))
    return M.mask_edges(edges, enabled).select("cu_id", "source_id", "target_id")


@query("SELECT p_partkey FROM part WHERE (p_size > 20 AND NOT (p_brand = 'Brand#11')) OR p_partkey % 7 = 0")
def cfg_predicate(t):
    atoms = {"unix": F.col("p_size") > 20, 'feature="x"': F.col("p_brand") == "Brand#11", "test": F.col("p_partkey") % 7 == 0}
    return t.part.where(M.cfg_column('any(all(unix, not(feature = "x")), test, unknown)', atoms)).select("p_partkey")


@query("SELECT doc_id::VARCHAR AS file_path, CASE WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'modified' END AS change FROM documents WHERE doc_id % 11 = 0 OR doc_id % 10 = 3 UNION ALL SELECT 'new' || doc_id, 'added' FROM documents WHERE doc_id < 5")
def change_scan(t):
    path = F.col("doc_id").cast("string").alias("file_path")
    stored = t.documents.select(path, F.md5("text").alias("hash"))
    edited = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = t.documents.where("doc_id % 11 != 0").select(path, F.md5(edited).alias("hash"))
    fresh = t.documents.where("doc_id < 5").select(F.concat(F.lit("new"), "doc_id").alias("file_path"), F.md5("text").alias("hash"))
    return M.scan_changes(stored, current.unionByName(fresh))


@query("SELECT source AS namespace, count(*) AS files, count(*) FILTER (doc_id % 10 = 3) AS stale FROM documents GROUP BY source")
def freshness_report(t):
    files = t.documents.select(F.col("source").alias("namespace"), F.col("doc_id").alias("file_path"))
    changes = files.where("file_path % 10 = 3").select("file_path", F.lit("modified").alias("change"))
    return M.freshness(files, files, changes)


EDITS_SQL = "WITH e AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS file, (event_id * 37 % 1000)::BIGINT AS s, (event_id * 37 % 1000 + event_id % 9)::BIGINT AS t FROM events), r AS (SELECT id, file, least(s, t) AS lo, CASE WHEN s = t THEN t + 1 ELSE greatest(s, t) END AS hi FROM e)"


def _edits(t):
    start = F.col("event_id") * 37 % 1000
    return t.events.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("file"), start.alias("start"), (start + F.col("event_id") % 9).alias("end"), F.col("event_id").alias("proposed_at")
    )


@query(EDITS_SQL + " SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.file = b.file AND a.id < b.id AND a.lo < b.hi AND b.lo < a.hi")
def overlapping_edits(t):
    return M.overlaps(_edits(t))


@query(
    EDITS_SQL + """, l AS (SELECT file, list({'id': id, 'lo': lo, 'hi': hi} ORDER BY id::BIGINT DESC) AS es FROM r GROUP BY file),
f AS (SELECT file, list_reduce(list_transform(es, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda a: a.lo < e[1].hi AND e[1].lo < a.hi)) = 0 THEN list_concat(acc, e) ELSE acc END) AS acc FROM l)
SELECT r.id, CASE WHEN list_contains(list_transform(acc, lambda a: a.id), r.id) THEN 'Accepted' ELSE 'Stale' END AS status FROM r JOIN f USING (file)"""
)
def accepted_edits(t):
    return M.accept_greedily(_edits(t))


#: Bytes as hexadecimal digits; text of bytes that are no UTF-8 is null.
HEX_SQL = "WITH h AS (SELECT doc_id, text, hex(encode(text)) AS x FROM documents)"


@query(HEX_SQL + " SELECT doc_id, CASE WHEN length(x) >= 24 THEN try(decode(unhex('3C' || substr(x, 9, 8) || '2323' || substr(x, 21)))) END AS text FROM h")
def splice_edits(t):
    edit = lambda a, b, x: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(x).alias("text"))
    edits = F.array(edit(0, 4, "<"), edit(8, 10, "##"), edit(9, 3, "never"))
    # null where an edit would cut a character in two
    body = X.splice(F.encode("text", "UTF-8"), edits).cast("string")
    return t.documents.select("doc_id", F.when((F.octet_length("text") >= 12) & F.is_valid_utf8(body), body).alias("text"))


LINES_SQL = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), f AS (SELECT *, line ILIKE '%license%' AS changed FROM l)"


@query(LINES_SQL + ", w AS (SELECT *, max(changed::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM f) SELECT doc_id, n::INTEGER AS n, line FROM w WHERE near = 1")
def unified_diff_filter(t):
    """Lines within two of a changed one, by windows over each text's own lines."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-2, 2)
    near = F.max(F.lower("line").contains("license").cast("int")).over(w)
    return lines.withColumn("near", near).where("near = 1").select("doc_id", (F.col("n") + 1).alias("n"), "line")


LOG_SQL = "WITH g AS (SELECT user_id AS request, event_id AS ts, CASE event_type WHEN 'signup' THEN 'requested' WHEN 'error' THEN 'failed' ELSE 'completed' END AS event FROM events WHERE event_type IN ('signup', 'error', 'purchase'))"


def _log(t):
    event = F.when(F.col("event_type") == "signup", "requested").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return t.events.where(F.col("event_type").isin("signup", "error", "purchase")).select(F.col("user_id").alias("request"), F.col("event_id").alias("ts"), event.alias("event"))


@query(LOG_SQL + " SELECT request, coalesce(min_by(event, ts) FILTER (event <> 'requested'), 'requested') AS status, min(ts) FILTER (event = 'requested') AS requested_at, min(ts) FILTER (event <> 'requested') AS ended_at, count(*) FILTER (event = 'requested') AS requests, count(DISTINCT event) FILTER (event <> 'requested') > 1 AS late FROM g GROUP BY request")
def event_lifecycle(t):
    return M.lifecycle(_log(t))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS rank FROM events QUALIFY rank <= 3")
def latest_by_parent(t):
    return M.latest_by_parent(t.events, "user_id", "ts", "event_id", 3).select("user_id", "event_id", "rank")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'denied' END AS state FROM events")
def proposal_states(t):
    said = F.when(F.col("event_id") % 2 == 0, "Approved").otherwise("DENIED")
    return t.events.select("event_id", M.proposal_state(said).alias("state"))


DEBOUNCE_SQL = """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, max_by(event_type, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS kind FROM s GROUP BY user_id, k
"""


@query(DEBOUNCE_SQL)
def debounce_sessions(t):
    from tessera.streaming.streams import debounce

    rank = F.element_at(F.create_map(*(F.lit(x) for p in {"error": 5, "purchase": 4, "signup": 3, "click": 2, "view": 1}.items() for x in p)), F.col("event_type"))
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = debounce(events, "user_id", "ts", "event_type", rank, "1 hour")
    return found.select("user_id", "events", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "kind")


@query("SELECT p_type AS key, count(*) AS n, list_sort(list(DISTINCT p_brand)) AS repos, list_slice(list_sort(list(p_partkey)), 1, 5) AS examples FROM part GROUP BY p_type")
def failure_clusters(t):
    return M.failure_clusters(t.part.select(F.col("p_type").alias("key"), F.col("p_brand").alias("repo"), F.col("p_partkey").alias("id")), ["key"])


BUILD_SQL = """
WITH l AS (SELECT user_id AS build, event_id, event_type, CASE event_type WHEN 'error' THEN '{"reason":"compiler-message","message":{"level":"error"}}' WHEN 'click' THEN '{"reason":"compiler-message","message":{"level":"warning"}}' WHEN 'view' THEN '{"reason":"build-finished"}' ELSE 'no json ' || event_id END AS line FROM events),
e AS (SELECT build, event_id, line FROM l QUALIFY row_number() OVER (PARTITION BY build ORDER BY event_id DESC) <= 3)
SELECT build, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS warnings, count(*) FILTER (event_type IN ('error', 'click')) AS messages, count(*) FILTER (event_type NOT IN ('error', 'click', 'view')) AS unreadable,
       (SELECT right(string_agg(e.line, chr(10) ORDER BY e.event_id), 80) FROM e WHERE e.build = l.build) AS tail FROM l GROUP BY build
"""


@query(BUILD_SQL)
def build_summary(t):
    """Events as the lines of a build's output, a build for each user."""
    said = lambda level: F.to_json(F.struct(F.lit("compiler-message").alias("reason"), F.struct(F.lit(level).alias("level")).alias("message")))
    done = F.to_json(F.struct(F.lit("build-finished").alias("reason")))
    kind = F.col("event_type")
    line = F.when(kind == "error", said("error")).when(kind == "click", said("warning")).when(kind == "view", done).otherwise(F.concat(F.lit("no json "), "event_id"))
    return M.build_summary(t.events.select(F.col("user_id").alias("build"), F.col("event_id").alias("line_no"), line.alias("line")), "build", tail=3, cap=80)


@query("SELECT doc_id, 1::BIGINT AS removed, 2::BIGINT AS added, '@@ -1' AS head FROM documents WHERE length(trim(text)) > 0")
def unified_diffs(t):
    """Each text against itself with a changed first line and one line more before it."""
    from tessera.functions import diff

    texts = t.documents.where("length(trim(text)) > 0").select("doc_id", F.col("doc_id").cast("string").alias("file_path"), F.concat(F.lit("first\n"), F.col("text")).alias("old"))
    changed = texts.withColumn("new", F.concat(F.lit("changed line\nnew line\n"), F.substring("old", 7, 2**30)))
    found = diff.unified_diffs(changed, 2)
    return found.select("doc_id", "removed", "added", F.substring(F.element_at(F.split("diff", "\n"), 3), 1, 5).alias("head"))


@query("SELECT root, kind, name FROM (SELECT p_size AS root, p_brand AS kind, p_name AS name, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY root ORDER BY kind, name, p_partkey) = 1")
def target_precedence(t):
    from tessera.sources.files import one_target_per_root

    targets = t.part.select(F.col("p_size").alias("root"), F.col("p_brand").alias("kind"), F.col("p_name").alias("name"), "p_partkey")
    return one_target_per_root(targets, F.col("kind"), [F.col("p_partkey")]).select("root", "kind", "name")


@query(
    HEX_SQL + ", s AS (SELECT *, try(decode(unhex(substr(x, 9, 20)))) AS snippet FROM h), "
    "r AS (SELECT *, CASE WHEN text IS NULL THEN 'missing' WHEN doc_id % 7 = 0 THEN 'hash_mismatch' WHEN length(x) < 40 THEN 'out_of_range' WHEN snippet IS NULL THEN 'not_text' ELSE 'ok' END AS status FROM s) "
    "SELECT doc_id, status, CASE WHEN status = 'ok' THEN snippet END AS snippet FROM r"
)
def snippet_batch(t):
    from tessera.sources.files import read_snippets

    docs = t.documents
    contents = docs.select(F.col("doc_id").cast("string").alias("file_path"), F.encode("text", "UTF-8").alias("content"))
    hash_ = F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(I.content_hash(F.encode("text", "UTF-8")))
    stop = F.when(F.octet_length("text") < 20, F.lit(1_000_000)).otherwise(F.lit(14)).cast("long")
    requests = docs.select("doc_id", F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("file_path"), F.lit(4).cast("long").alias("start_byte"), stop.alias("end_byte"), hash_.alias("file_hash"))
    return read_snippets(requests, contents).select("doc_id", "status", "snippet")
