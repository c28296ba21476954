"""Graph queries, on a containment tree made of the driver's tables.

Nodes are region, nation, customer and order (ids r:, n:, c:, o:); each contains the next. Suppliers (s:) hang below
nations by a second kind of edge. Regions and nations play modules, customers and orders items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids as I
from tessera.operators import graph as G
from tessera.operators import maintenance as M
from tessera.plans.registry import query

EDGES_SQL = """
e AS (SELECT 'r:' || n_regionkey AS source_id, 'n:' || n_nationkey AS target_id, 'Contains' AS relation_kind FROM nation
      UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'Contains' FROM customer
      UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'Contains' FROM orders
      UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'ImplAssociatedItem' FROM supplier)
"""
UP_SQL = "a AS (SELECT target_id AS child, source_id AS ancestor FROM e WHERE %s UNION SELECT a.child, e.source_id FROM a JOIN e ON e.target_id = a.ancestor WHERE %s)"
CONTAINS = "relation_kind = 'Contains'"


def _edge(df: DataFrame, a: str, a_key: str, b: str, b_key: str, kind: str = "Contains") -> DataFrame:
    return df.select(F.concat(F.lit(a), a_key).alias("source_id"), F.concat(F.lit(b), b_key).alias("target_id"), F.lit(kind).alias("relation_kind"))


def edges(t) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            _edge(t.nation, "r:", "n_regionkey", "n:", "n_nationkey"),
            _edge(t.customer, "n:", "c_nationkey", "c:", "c_custkey"),
            _edge(t.orders, "c:", "o_custkey", "o:", "o_orderkey"),
            _edge(t.supplier, "n:", "s_nationkey", "s:", "s_suppkey", "ImplAssociatedItem"),
        ],
    )


def modules(t) -> DataFrame:
    root = t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("id"), F.array(F.lit("crate"), F.col("r_name")).alias("path"))
    below = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return root.unionByName(below.select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), F.array(F.lit("crate"), F.col("r_name"), F.col("n_name")).alias("path")))


def files(t) -> DataFrame:
    return t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("owner_id"), F.concat(F.lit("src/"), "r_name", F.lit(".rs")).alias("file_path"), F.col("r_name").alias("namespace"))


def nodes(t) -> DataFrame:
    kinds = F.when(F.col("c_mktsegment") == "BUILDING", "struct").otherwise("function")
    c = t.customer.select(F.concat(F.lit("c:"), "c_custkey").alias("id"), kinds.alias("node_type"), F.col("c_name").alias("name"))
    s = t.supplier.select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.lit("method").alias("node_type"), F.col("s_name").alias("name"))
    return c.unionByName(s)


PLACES_SQL = EDGES_SQL + """,
p AS (SELECT 'c:' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'struct' ELSE 'function' END AS node_type, c_name AS name,
             'n:' || n_nationkey AS module_id, ['crate', r_name, n_name] AS module_path, 'src/' || r_name || '.rs' AS file_path, r_name AS namespace
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def places(t) -> DataFrame:
    return G.item_places(nodes(t), edges(t).where("target_id not like 'o:%'"), modules(t), files(t))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT target_id AS child, source_id AS parent FROM e WHERE {CONTAINS}")
def graph_parent_of(t):
    return G.parent_of(edges(t))


@query(f"WITH RECURSIVE {EDGES_SQL}, {UP_SQL % (CONTAINS, CONTAINS)} SELECT child, ancestor FROM a")
def ancestor_closure(t):
    return G.ancestors(edges(t))


@query(f"WITH RECURSIVE {EDGES_SQL}, {UP_SQL % ('true', 'true')} SELECT child, ancestor FROM a")
def graph_closure_two_kinds(t):
    return G.ancestors(edges(t), G.PARENT_KINDS)


@query(f"WITH RECURSIVE {EDGES_SQL}, d AS (SELECT 'r:1' AS id, 0 AS depth UNION SELECT target_id, depth + 1 FROM d JOIN e ON source_id = id WHERE {CONTAINS}) SELECT id, depth::INTEGER AS depth FROM d")
def descendants(t):
    return G.reachable(edges(t), t.region.where("r_regionkey = 1").select(F.lit("r:1").alias("id")))


@query(f"WITH {PLACES_SQL} SELECT id, node_type, file_path FROM p WHERE node_type = 'struct' AND name = (SELECT min(name) FROM p WHERE node_type = 'struct') AND len(module_path) = 3")
def resolve_exact(t):
    name, path, kind = (lambda r: (r["c_name"], ["crate", r["r_name"], r["n_name"]], "struct"))(
        t.customer.where("c_mktsegment = 'BUILDING'").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("c_name").select("c_name", "r_name", "n_name").first()
    )
    return G.resolve_exact(places(t), kind, None, path, name).select("id", "node_type", "file_path")


@query(f"WITH {PLACES_SQL} SELECT id, file_path, array_to_string(module_path, '::') || '::' || name AS canon FROM p")
def canonical_paths(t):
    return G.canonical_paths(places(t))


@query(f"WITH {PLACES_SQL} SELECT id, node_type, name, module_id, array_to_string(module_path, '/') AS module, file_path, namespace FROM p")
def primary_nodes(t):
    return places(t).select("id", "node_type", "name", "module_id", F.array_join("module_path", "/").alias("module"), "file_path", "namespace")


LINKS_SQL = ", k AS (SELECT 'c:' || o_custkey AS source_id, 'c:' || (o_custkey % 97 + 1) AS target_id, 'ImportedBy' AS relation_kind FROM orders)"


@query(
    f"WITH {PLACES_SQL}{LINKS_SQL}, f AS (SELECT id FROM p WHERE node_type = 'struct'), "
    "x AS (SELECT source_id AS id, target_id AS other, relation_kind, 'outgoing' AS direction FROM k UNION SELECT target_id, source_id, relation_kind, 'incoming' FROM k) "
    "SELECT DISTINCT x.id AS source_id, a.name AS source_name, other AS target_id, b.name AS target_name, array_to_string(b.module_path, '::') || '::' || b.name AS canon_path, relation_kind, b.file_path, direction "
    "FROM x JOIN f USING (id) JOIN p a ON a.id = x.id JOIN p b ON b.id = other"
)
def resolve_edges(t):
    links = t.orders.select(F.concat(F.lit("c:"), "o_custkey").alias("source_id"), F.concat(F.lit("c:"), F.col("o_custkey") % 97 + 1).alias("target_id"), F.lit("ImportedBy").alias("relation_kind"))
    where = G.written(places(t))
    return G.resolve_edges(where, links, where.where("node_type = 'struct'"))


@query(f"WITH {EDGES_SQL} SELECT relation_kind, count(*) AS n FROM e GROUP BY relation_kind")
def count_edges_by_kind(t):
    return edges(t).groupBy("relation_kind").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL}, m AS (SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_nationkey % 4 <> 0), c AS (SELECT target_id AS id FROM e JOIN m ON source_id = m.id), g AS (SELECT id FROM m UNION SELECT id FROM c UNION SELECT target_id FROM e JOIN c ON source_id = c.id) SELECT source_id, target_id, relation_kind FROM e WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)")
def prune_unlinked(t):
    links = t.nation.where("n_nationkey % 4 = 0").select(F.lit("r:0").alias("source_id"), F.concat(F.lit("n:"), "n_nationkey").alias("target_id"), F.lit("ResolvesToDefinition").alias("relation_kind"))
    owners = modules(t).select(F.col("id").alias("owner_id"))
    found = modules(t).withColumn("path", F.slice("path", 2, 9))
    kept = G.prune_unlinked(found, edges(t).unionByName(links), owners)[1]
    return kept.where("relation_kind != 'ResolvesToDefinition'").select("source_id", "target_id", "relation_kind")


@query("SELECT conv_id::VARCHAR || ':' || turn AS id, turn::INTEGER AS path_index FROM conversations c WHERE turn <= (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id)")
def conversation_path(t):
    c = t.conversations
    id_ = F.concat_ws(":", "conv_id", "turn")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    messages = c.join(first, "conv_id").select(id_.alias("id"), F.when(F.col("turn") > F.col("first"), F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1)).alias("parent"))
    leaves = first.select(F.concat_ws(":", "conv_id", "last").alias("id"))
    return G.root_to_leaf(messages, leaves).select("id", "path_index")


@query("SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def conversation_last_user(t):
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query(
    "WITH RECURSIVE s AS (SELECT o_custkey AS id, min(o_orderkey % 50 + 1) AS nxt FROM orders GROUP BY 1), "
    "w AS (SELECT id, id AS target, 0 AS hops, [id] AS seen FROM s UNION ALL SELECT w.id, s.nxt, hops + 1, list_append(seen, s.nxt) FROM w JOIN s ON s.id = w.target WHERE NOT list_contains(seen, s.nxt)), "
    "l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1) "
    "SELECT 'c:' || l.id AS id, 'c:' || target AS target, hops, CASE WHEN s.id IS NULL THEN 'ok' ELSE 'cycle' END AS status FROM l LEFT JOIN s ON s.id = l.target"
)
def reexport_chain(t):
    # customers 1 to 50 link too, so that chains go on and some are cycles
    links = t.orders.groupBy("o_custkey").agg(F.min(F.col("o_orderkey") % 50 + 1).alias("n"))
    links = links.select(F.concat(F.lit("c:"), "o_custkey").alias("source_id"), F.concat(F.lit("c:"), "n").alias("target_id"))
    return G.follow_chain(links, links.select(F.col("source_id").alias("id")))


@query(f"WITH {EDGES_SQL} SELECT 'r:1' AS id, 'crate' AS role UNION ALL SELECT 'r:1', 'file' UNION ALL SELECT 'n:' || n_nationkey, 'node' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c:' || c_custkey, 'node' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'o:' || o_orderkey, 'node' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 's:' || s_suppkey, 'node' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def namespace_inventory(t):
    name = t.region.where("r_regionkey = 1").first()["r_name"]
    crates = t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("id"), F.col("r_name").alias("namespace"))
    return M.inventory(crates, files(t), edges(t), name)


@query("SELECT 'namespace' AS field, r_name AS value FROM region WHERE r_regionkey >= 2 UNION ALL SELECT 'root_path', '/r/' || r_regionkey FROM region WHERE r_regionkey IN (2, 3, 4) AND r_regionkey % 2 = 0")
def namespace_conflicts(t):
    crates = lambda suffix: t.region.select(F.col("r_name").alias("namespace"), F.concat(F.lit("/r/"), "r_regionkey", suffix).alias("root_path"), "r_regionkey")
    incoming = crates(F.when(F.col("r_regionkey") % 2 == 0, "").otherwise("x")).where("r_regionkey >= 2")
    return M.conflicts(crates(F.lit("")), incoming, ["namespace", "root_path"])


@query(f"WITH {EDGES_SQL} SELECT count(*) AS edges FROM e WHERE source_id NOT IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AND target_id NOT IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def namespace_removal(t):
    ids = t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"))
    return M.remove({"nodes": (nodes(t), "id")}, ids, edges(t))["edges"].agg(F.count("*").alias("edges"))


@query(f"WITH {EDGES_SQL}, i AS (SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2) SELECT DISTINCT source_id, target_id, relation_kind FROM e WHERE source_id IN (SELECT id FROM i) OR target_id IN (SELECT id FROM i)")
def edges_touching(t):
    return M.edges_touching(edges(t), t.nation.where("n_regionkey = 2").select(F.concat(F.lit("n:"), "n_nationkey").alias("id"))).select("source_id", "target_id", "relation_kind")


UUID_SQL = f"""
WITH h AS (SELECT doc_id, sha1(unhex('{I.PROJECT.hex}') || encode(lang || '::FILE::' || source || '::CONTENT::' || text)) AS x FROM documents)
SELECT doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', ('0x' || substr(x, 17, 1))::INTEGER % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS hash FROM h
"""


@query(UUID_SQL)
def tracking_uuid5(t):
    return t.documents.select("doc_id", I.tracking_hash(F.col("lang"), F.col("source"), F.col("text")).alias("hash"))


@query("SELECT p_partkey, 'emb_' || replace(replace(p_brand || '/' || p_size, '-', '_'), '/', '_slash_') || '_' || 384 AS relation FROM part")
def embedding_relation_names(t):
    return t.part.select("p_partkey", I.relation_name(F.concat_ws("/", "p_brand", "p_size"), F.lit(384)).alias("relation"))


# ---- links and access


@query("SELECT 'd:' || s_suppkey AS source_id, 'n:' || n_nationkey AS target_id, 'ResolvesToDefinition' AS relation_kind FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def declaration_links(t):
    """Nations are modules with a file, suppliers declare that of theirs."""
    defined = modules(t).where("id like 'n:%'").withColumn("module_kind", F.lit("file"))
    declared = t.supplier.join(defined, F.concat(F.lit("n:"), "s_nationkey") == F.col("id")).select(F.concat(F.lit("d:"), "s_suppkey").alias("id"), "path", F.lit("declaration").alias("module_kind"))
    return G.link_declarations(defined.unionByName(declared))


@query("SELECT 'n:' || n_nationkey AS id, 'r:' || n_regionkey AS parent FROM nation")
def module_parents(t):
    """Three quarters of the nations are contained directly, the others by way of a declaration."""
    region, nation, declared = F.concat(F.lit("r:"), "n_regionkey"), F.concat(F.lit("n:"), "n_nationkey"), F.concat(F.lit("d:"), "n_nationkey")
    direct = F.col("n_nationkey") % 4 != 0
    held = t.nation.select(region.alias("source_id"), F.when(direct, nation).otherwise(declared).alias("target_id"), F.lit("Contains").alias("relation_kind"))
    links = t.nation.where(~direct).select(declared.alias("source_id"), nation.alias("target_id"), F.lit("ResolvesToDefinition").alias("relation_kind"))
    return G.module_parent(t.nation.select(nation.alias("id")), held.unionByName(links))


@query(
    "SELECT 'c:' || o_custkey AS source_id, 'o:' || o_orderkey AS target_id, 'ImportedBy' AS relation_kind FROM orders JOIN customer ON o_custkey = c_custkey "
    "UNION ALL SELECT 'c:' || c_custkey, 's:' || s_suppkey, 'ImportedBy' FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_custkey % 3 <> 0"
)
def import_links(t):
    """Orders import their customer by its path, suppliers everything visible of their nation."""
    items = places(t).withColumn("name", F.col("id"))  # customers may share a name, and an order imports one
    items = G.written(items.withColumn("vis_kind", F.when(F.substring("id", 3, 20).cast("long") % 3 == 0, "Inherited").otherwise("Public")))
    named = G.canonical_paths(items).select(F.col("id").alias("item"), F.split("canon", "::").alias("path"))
    plain = t.orders.join(named, F.concat(F.lit("c:"), "o_custkey") == F.col("item")).select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), "path", F.lit(False).alias("is_glob"))
    below = modules(t).select(F.col("id").alias("module"), "path")
    glob = t.supplier.join(below, F.concat(F.lit("n:"), "s_nationkey") == F.col("module")).select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), "path", F.lit(True).alias("is_glob"))
    return G.import_links(plain.unionByName(glob), items, modules(t))


@query("SELECT DISTINCT 'n:' || a.n_nationkey AS source_id, 'n:' || b.n_nationkey AS target_id, b.n_nationkey % 4 < 2 OR a.n_regionkey = b.n_regionkey AS accessible FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON s_suppkey % 25 = b.n_nationkey")
def access_checks(t):
    """Nations that are public, visible in the crate, restricted to their region, or visible in their parent only."""
    kind = F.element_at(F.array(*map(F.lit, ("Public", "Crate", "Restricted", "Inherited"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    region = F.concat(F.lit("r:"), "n_regionkey")
    targets = t.nation.select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), kind.alias("vis_kind"), region.alias("restricted_to"), region.alias("parent"))
    pairs = t.supplier.select(F.concat(F.lit("n:"), "s_nationkey").alias("source_id"), F.concat(F.lit("n:"), F.col("s_suppkey") % 25).alias("target_id")).distinct()
    return G.accessible(pairs, targets, G.ancestors(edges(t).where("target_id like 'n:%'")))


@query(
    "WITH c AS (SELECT 'c:' || c_custkey AS id, c_custkey, c_name, n_name, n_nationkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "
    "SELECT id, 'crate/' || r_name || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '/' || n_name END || '/' || c_name AS path FROM c WHERE c_custkey % 7 = 0 OR c_custkey % 3 <> 0 AND n_nationkey % 5 <> 0"
)
def shortest_public_paths(t):
    """Every fifth nation is private, every third customer too; every seventh is shown by its region as well."""
    number = F.expr("try_cast(substring(id, 3) AS bigint)")
    items = G.written(places(t).withColumn("vis_kind", F.when(number % 3 == 0, "Inherited").otherwise("Public")))
    nations = t.nation.select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), F.concat(F.lit("r:"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "Inherited").otherwise("Public").alias("vis_kind"))
    regions = t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("id"), F.lit("root").alias("parent"), F.col("r_name").alias("name"), F.lit("Public").alias("vis_kind"))
    shown = items.where(number % 7 == 0).join(nations.select(F.col("id").alias("module_id"), "parent"), "module_id").select("id", F.col("parent").alias("module_id"), "name")
    found = G.shortest_public_paths(items, nations.unionByName(regions), shown, "root")
    return found.select("id", F.array_join("path", "/").alias("path"))


@query(f"WITH {PLACES_SQL}, q AS (SELECT id, file_path, array_to_string(module_path, '::') || '::' || name AS canon FROM p) SELECT id FROM q WHERE canon = (SELECT min(canon) FROM q)")
def canonical_id_lookup(t):
    from tessera.operators import indexing as N

    where = G.written(places(t))
    return N.canonical_id(where, G.canonical_paths(where).agg(F.min("canon")).first()[0])


@query(f"WITH {PLACES_SQL}, q AS (SELECT id, file_path, array_to_string(module_path, '::') || '::' || name AS canon FROM p) SELECT id, file_path FROM q WHERE canon = (SELECT max(canon) FROM q)")
def resolve_for_edit(t):
    """By a path that ends like the file's own, and by a canonical path without its crate."""
    where = G.written(places(t))
    last = G.canonical_paths(where).orderBy(F.col("canon").desc()).first()
    if G.one_for_edit(where, last["file_path"], last["canon"]) != last["id"]:
        raise AssertionError(last)
    return G.resolve_for_edit(where, "/home/x/" + last["file_path"], last["canon"].removeprefix("crate::")).select("id", "file_path")


@query("SELECT 'r:' || r_regionkey AS crate_id, lower(r_name) AS crate, 'r:' || r_regionkey AS module_id, 'src/' || r_name || '.rs' AS file_path FROM region")
def crate_files(t):
    crates = t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("id"), F.lower("r_name").alias("name"), F.col("r_name").alias("namespace"))
    return G.crate_files(modules(t), files(t), crates).select("crate_id", "crate", "module_id", "file_path")


@query("SELECT 'r:' || r_regionkey AS module_id, 'crate/' || r_name AS path, r_name AS namespace FROM region WHERE r_name = (SELECT max(r_name) FROM region)")
def modules_of_file(t):
    last = t.region.agg(F.max("r_name")).first()[0]
    return G.modules_of_file(modules(t), files(t), f"src/{last}.rs").select("module_id", F.array_join("path", "/").alias("path"), "namespace")
