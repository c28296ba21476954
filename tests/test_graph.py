import pytest

from tessera.operators import graph as G
from tessera.operators import maintenance as M
from tessera.operators import temporal as T
from pyspark.sql import functions as F

# Two namespaces: a root file module with an inline module, a declared file module, items, an impl; one loose file module.
EDGES = [
    ("ra", "ma", "Contains"), ("ra", "da", "Contains"), ("da", "fa", "ResolvesToDefinition"), ("ra", "f1", "Contains"), ("ma", "f2", "Contains"),
    ("fa", "s1", "Contains"), ("s1", "x1", "StructField"), ("fa", "i1", "Contains"), ("i1", "me1", "ImplAssociatedItem"), ("f1", "s1", "ImportedBy"),
    ("f2", "f1", "ImportedBy"), ("rb", "g1", "Contains"), ("lost", "h1", "Contains"), ("h1", "f1", "ImportedBy"),
]
NODES = [("f1", "function", "run"), ("f2", "function", "run"), ("s1", "struct", "Thing"), ("x1", "field", "x"), ("i1", "impl", "i"), ("me1", "method", "go"), ("g1", "function", "run"), ("h1", "const", "H"), ("ma", "module", "ma")]
MODULES = [("ra", ["crate"], "file"), ("ma", ["crate", "m"], "inline"), ("da", ["crate", "f"], "declaration"), ("fa", ["crate", "f"], "file"), ("rb", ["crate"], "file"), ("lost", ["crate", "lost"], "file")]
FILES = [("ra", "src/lib.rs", "A"), ("fa", "src/f.rs", "A"), ("rb", "b/lib.rs", "B"), ("lost", "src/lost.rs", "A")]


@pytest.fixture(scope="module")
def g(spark):
    edges = spark.createDataFrame(EDGES, "source_id string, target_id string, relation_kind string")
    nodes = spark.createDataFrame(NODES, "id string, node_type string, name string")
    modules = spark.createDataFrame(MODULES, "id string, path array<string>, module_kind string")
    files = spark.createDataFrame(FILES, "owner_id string, file_path string, namespace string")
    return {"edges": edges, "nodes": nodes, "modules": modules, "files": files, "places": G.written(G.item_places(nodes, edges, modules, files))}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_places_and_exact_look_up(g):
    found = {(r.id, r.file_path, "::".join(r.module_path)) for r in g["places"].collect()}
    assert found == {("f1", "src/lib.rs", "crate"), ("f2", "src/lib.rs", "crate::m"), ("ma", "src/lib.rs", "crate"), ("s1", "src/f.rs", "crate::f"), ("g1", "b/lib.rs", "crate"), ("h1", "src/lost.rs", "crate::lost")}
    one = lambda *a: [r.id for r in G.resolve_exact(g["places"], *a).collect()]
    assert one("function", "src/lib.rs", ["crate"], "run") == ["f1"]
    assert sorted(one("function", None, ["crate"], "run")) == ["f1", "g1"]
    assert one("struct", "src/lib.rs", ["crate"], "run") == []
    edit = lambda *a: sorted(r.id for r in G.resolve_for_edit(g["places"], *a).collect())
    assert edit("src/lib.rs", "crate::run") == ["f1"] and edit("lib.rs", "run") == ["f1", "g1"] and edit("f.rs", "f::Thing") == ["s1"]


def test_edges_of_a_focus_tell_their_direction(g, spark):
    focus = spark.createDataFrame([("f1",)], "id string")
    got = [(r.source_id, r.target_id, r.relation_kind, r.direction) for r in G.resolve_edges(g["places"], g["edges"], focus).collect()]
    assert sorted(got) == [("f1", "f2", "ImportedBy", "incoming"), ("f1", "h1", "ImportedBy", "incoming"), ("f1", "s1", "ImportedBy", "outgoing")]


def test_closure_of_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    assert rows(G.closure(pairs)) == sorted((x, y) for x in "abcd" for y in "abc")
    seeds = spark.createDataFrame([("d",)], "id string")
    assert rows(G.closure(pairs, seeds)) == [("d", "a"), ("d", "b"), ("d", "c")]
    assert G.closure(pairs.limit(0)).collect() == []


def test_pruning(g):
    gone, kept = G.prune_unlinked(g["modules"], g["edges"], g["files"])
    # what the loose module reaches goes too, and with it edges that touch it
    assert {r.id for r in gone.collect()} == {"lost", "h1", "f1", "s1", "x1"}
    assert not {x for r in kept.collect() for x in (r.source_id, r.target_id)} & {"lost", "h1", "f1", "s1", "x1"}


def test_links_and_parents(g):
    assert rows(G.link_declarations(g["modules"])) == [("da", "fa", "ResolvesToDefinition")]
    assert rows(G.module_parent(g["modules"], g["edges"])) == [("da", "ra"), ("fa", "ra"), ("ma", "ra")]


def test_chains(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "source_id string, target_id string")
    starts = spark.createDataFrame([("a",), ("c",), ("x",)], "id string")
    assert rows(G.follow_chain(links, starts)) == [("a", "c", 2, "ok"), ("c", "c", 0, "ok"), ("x", "y", 1, "cycle")]
    long = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "source_id string, target_id string")
    assert rows(G.follow_chain(long, spark.createDataFrame([("0",)], "id string"), most=3)) == [("0", "3", 3, "too_long")]


def test_imports_and_access(g, spark):
    imports = spark.createDataFrame([("i1", ["crate", "f", "Thing"], False), ("i2", ["crate"], True)], "id string, path array<string>, is_glob boolean")
    places = g["places"].withColumn("vis_kind", F.when(F.col("id") == "ma", "Inherited").otherwise("Public"))
    got = rows(G.import_links(imports, places, g["modules"]).select("source_id", "target_id"))
    assert got == [("f1", "i2"), ("g1", "i2"), ("s1", "i1")]
    targets = spark.createDataFrame([("t1", "Public", None, None), ("t2", "Inherited", None, "ra"), ("t3", "Restricted", "ma", None)], "id string, vis_kind string, restricted_to string, parent string")
    pairs = spark.createDataFrame([("ma", "t1"), ("ma", "t2"), ("rb", "t2"), ("ma", "t3"), ("ra", "t3")], "source_id string, target_id string")
    access = {(r.source_id, r.target_id): r.accessible for r in G.accessible(pairs, targets, G.ancestors(g["edges"])).collect()}
    assert access == {("ma", "t1"): True, ("ma", "t2"): True, ("rb", "t2"): False, ("ma", "t3"): True, ("ra", "t3"): False}


def test_shortest_public_path(spark):
    places = spark.createDataFrame([("x", "deep", "X", "Public"), ("y", "m", "Y", "Public"), ("z", "m", "Z", "Private")], "id string, module_id string, name string, vis_kind string")
    parents = spark.createDataFrame([("m", "root", "m", "Public"), ("deep", "m", "deep", "Public")], "id string, parent string, name string, vis_kind string")
    shown = spark.createDataFrame([("x", "root", "Renamed")], "id string, module_id string, name string")
    got = {r.id: r.path for r in G.shortest_public_paths(places, parents, shown, "root").collect()}
    assert got == {"x": ["crate", "Renamed"], "y": ["crate", "m", "Y"]}


def test_namespace_round_trip(g, spark):
    crates = spark.createDataFrame([("ca", "A", "a", "/a"), ("cb", "B", "b", "/b")], "id string, namespace string, name string, root_path string")
    ids = M.inventory(crates, g["files"], g["edges"], "B")
    assert {r.id for r in ids.collect()} == {"cb", "rb", "g1"}
    with pytest.raises(ValueError):
        M.inventory(crates, g["files"], g["edges"], "C")
    relations = {"nodes": (g["nodes"], "id"), "files": (g["files"], "owner_id"), "crates": (crates, "id")}
    out, left = M.export(relations, ids, g["edges"]), M.remove(relations, ids, g["edges"])
    assert rows(out["edges"]) == [("rb", "g1", "Contains")] and out["nodes"].count() == 1
    assert M.conflicts(left["crates"], out["crates"]).collect() == []
    again = M.import_rows(left, out, M.conflicts(left["crates"], out["crates"]))
    for name, (df, _) in relations.items():
        assert sorted(map(str, again[name].collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        M.import_rows(again, out, M.conflicts(again["crates"], out["crates"]))


def test_versions(spark):
    log = spark.createDataFrame([("k", 1, "a", True), ("k", 2, "a", False), ("k", 3, "b", True), ("l", 1, "c", True), ("m", 1, "d", True), ("m", 5, "d", False)], "id string, ts long, v string, is_assert boolean")
    assert rows(T.live(log, ["id"]).select("id", "v")) == [("k", "b"), ("l", "c")]
    assert rows(T.as_of(log, ["id"], F.lit(2)).select("id", "v")) == [("l", "c"), ("m", "d")]
    gone = T.retract_rows(log, spark.createDataFrame([("l",), ("m",)], "id string"), ["id"], F.lit(9))
    assert gone.count() == 7 and rows(T.live(gone, ["id"]).select("id")) == [("k",)]
    assert rows(T.history(log, ["id"])) == [("k", 3, 2), ("l", 1, 1), ("m", 2, 1)]


def test_graphs_deeper_than_a_thousand(spark):
    n = 1100
    name = lambda i: f"x{i:04d}"
    chain = [(name(i), name(i + 1)) for i in range(n)]
    # a cycle in the depth, a short cut that makes depths smaller, and a branch
    extra = [(name(n), name(n - 5)), (name(3), name(30)), (name(500), "y0"), ("y0", "y1")]
    edges = spark.createDataFrame([(a, b, "Contains") for a, b in chain + extra], "source_id string, target_id string, relation_kind string")
    depth = {name(0): 0}
    front = [name(0)]
    while front:
        front = [b for a in front for x, b in chain + extra if x == a and b not in depth and not depth.update({b: depth[a] + 1})]
    got = G.reachable(edges, spark.createDataFrame([(name(0),)], "id string")).collect()
    assert {r.id: r.depth for r in got} == depth and len(got) == len(depth) == n + 3
    pairs = G.parent_of(edges.where("target_id != 'y1'"))
    got = rows(G.closure(pairs, spark.createDataFrame([(name(n),), ("y0",)], "id string")))
    assert got == sorted([(name(n), name(i)) for i in range(n + 1)] + [("y0", name(i)) for i in range(501)])


def test_paths_longer_than_a_thousand(spark):
    messages = [(f"m{i}", f"m{i - 1}" if i else None) for i in range(1100)] + [("c1", "c2"), ("c2", "c1"), ("lost", "nowhere"), ("one", None)]
    messages = spark.createDataFrame(messages, "id string, parent string")
    leaves = spark.createDataFrame([("m1099",), ("m3",), ("c1",), ("lost",), ("one",)], "id string")
    got = rows(G.root_to_leaf(messages, leaves))
    assert got == sorted([("m1099", f"m{i}", i) for i in range(1100)] + [("m3", f"m{i}", i) for i in range(4)] + [("one", "one", 0)])


def test_canonical_paths_lead_as_far_as_they_can(spark):
    places = spark.createDataFrame([("f1", ["crate", "m"], "f"), ("f2", ["crate", "m"], "f"), ("g", ["crate", "m", "n"], "g"), ("m", ["crate"], "m")], "id string, module_path array<string>, name string")
    paths = ["crate::m::f", "crate::m::n::g", "crate::m::n", "crate::m", "crate::m::x::y", "other::m", "", None, " crate :: m :: n :: g ", "crate::m::n::g::z"]
    asked = spark.createDataFrame(list(enumerate(paths)), "query int, canon string")
    got = {}
    for r in G.walk_canonical(asked, places).collect():
        got.setdefault(r["query"], [r.status, r.matched, []])[2].append(r.id)
    assert {k: (a, b, sorted(x for x in c if x)) for k, (a, b, c) in got.items()} == {
        0: ("ambiguous", "crate::m::f", ["f1", "f2"]), 1: ("resolved", "crate::m::n::g", ["g"]), 2: ("module", "crate::m::n", []), 3: ("resolved", "crate::m", ["m"]), 4: ("partial", "crate::m", []),
        5: ("unknown", None, []), 6: ("unknown", None, []), 7: ("unknown", None, []), 8: ("resolved", "crate::m::n::g", ["g"]), 9: ("partial", "crate::m::n::g", []),
    }


def test_many_walks_of_a_shared_path_are_not_paired_with_its_items(spark):
    places = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.array(F.lit("crate"), F.lit("m")).alias("module_path"), F.lit("x").alias("name"))
    asked = spark.range(3000).select(F.col("id").alias("query"), F.lit("crate::m::x").alias("canon"))
    found = G.walk_counts(asked.unionByName(spark.createDataFrame([(-1, "crate::m::y"), (-2, None)], "query long, canon string")), places)
    got = {(r.query >= 0, r.status, r.matched, r["items"], r.first_id) for r in found.collect()}
    assert found.count() == 3002 and got == {(True, "ambiguous", "crate::m::x", 3000, "0"), (False, "partial", "crate::m", 0, None), (False, "unknown", None, 0, None)}


def test_imports_of_shared_paths_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "IMPORT_BLOCK", 2)
    modules = spark.createDataFrame([("m", ["crate", "m"]), ("n", ["crate", "m"]), ("k", ["crate", "k"])], "id string, path array<string>")
    items = [(f"i{i}", m, ["crate", "k" if m == "k" else "m"], f"x{i % 3}", "Inherited" if i == 4 else "Public") for i in range(7) for m in (("m", "n", "k") if i < 2 else ("m",))]
    places = spark.createDataFrame([*items, items[0]], "id string, module_id string, module_path array<string>, name string, vis_kind string").withColumn("file_path", F.lit("f"))
    asks = [("a", ["crate", "m"], True), ("b", ["crate", "m"], True), ("b", ["crate", "k"], True), ("b", ["crate", "m", "x0"], False), ("c", ["crate", "m", "x1"], False), ("c", ["crate", "m", "x1"], False), ("d", ["crate"], True)]
    at = {"m": ["crate", "m"], "n": ["crate", "m"], "k": ["crate", "k"]}
    want = sorted({(i, t) for t, path, glob in asks for i, m, p, name, vis in items if (at[m] == path and vis == "Public" if glob else [*p, name] == path)})
    got = G.import_links(spark.createDataFrame(asks, "id string, path array<string>, is_glob boolean"), places, modules)
    assert rows(got.select("source_id", "target_id")) == want


def test_places_ask_for_the_ancestors_of_modules_only(g, monkeypatch):
    found, closure = [], G.closure
    monkeypatch.setattr(G, "closure", lambda *a: found.append(closure(*a)) or found[-1])
    got = G.item_places(g["nodes"], g["edges"], g["modules"], g["files"])
    assert rows(got) == rows(g["places"].select(*got.columns))
    assert {r.child for df in found for r in df.collect()} <= {r.id for r in g["modules"].collect()}


def test_orders_import_their_own_customer_where_names_are_shared(spark, tmp_path):
    from tessera.plans import graphs
    from tessera.plans.registry import Tables

    tables = {
        "region": ("r_regionkey long, r_name string", [(0, "R")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "N", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long, c_mktsegment string", [(1, "same", 0, "BUILDING"), (2, "same", 0, "BUILDING"), (3, None, 0, "AUTO")]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(7, "S", 0)]),
        "orders": ("o_orderkey long, o_custkey long", [(10, 1), (11, 2), (12, 3), (13, 4)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = graphs.import_links(Tables(spark, str(tmp_path))).select("source_id", "target_id")
    assert rows(got) == [("c:1", "o:10"), ("c:1", "s:7"), ("c:2", "o:11"), ("c:2", "s:7"), ("c:3", "o:12")]
