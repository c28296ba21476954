import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import embeddings as E
from tessera.operators import graph as G
from tessera.operators import indexing as N
from tessera.operators import maintenance as M
from tessera.operators import temporal as T
from tessera.sources import files, rust_relations


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_index_lifecycle(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "addOne", "fn add_one()", "h1"), ("b", "", "fn x()", "h2")], "id string, name string, text string, tracking_hash string")
    assert N.IndexStatus.of(None).state == "uninitialized"
    index = N.build_index(nodes)
    assert N.IndexStatus.of(index) == N.IndexStatus("ready", 1) and N.IndexStatus.of(index.limit(0)).state == "empty"
    assert {r.term: r.tf for r in index.collect()} == {"add": 3, "one": 3, "fn": 1, "(": 1, ")": 1}
    assert {r.term: r.tf for r in N.build_index(nodes, boost=False).collect()} == {"add": 2, "one": 2}
    N.save_index(index, str(tmp_path / "i"))
    assert rows(N.load_index(spark, str(tmp_path / "i"))) == rows(index)
    log = N.put_doc_meta(schema.RELATIONS["bm25_doc_meta"].empty(spark), nodes, 3)
    assert [(r.id, r.token_length) for r in T.live(log, ["id"]).orderBy("id").collect()] == [("a", 5), ("b", 4)]
    assert rows(N.tracking_hash_of({"function": nodes, "other": nodes.drop("tracking_hash")}, "b")) == [("function", "h2")]


def test_units_and_changes(spark):
    edges = spark.createDataFrame([("r", "f", "Contains"), ("r", "d", "Contains"), ("d", "m", "ResolvesToDefinition"), ("m", "g", "Contains"), ("b", "h", "Contains"), ("g", "f", "ImportedBy")], "source_id string, target_id string, relation_kind string")
    files = spark.createDataFrame([("r", "src/lib.rs", "A"), ("m", "src/m.rs", "A"), ("b", "src/main.rs", "A")], "owner_id string, file_path string, namespace string")
    units = spark.createDataFrame([("lib", "src/lib.rs"), ("bin", "src/main.rs")], "cu_id string, target_root string")
    masks = N.unit_masks(units, files, edges)
    assert rows(masks.names("nodes").select("cu_id", "id")) == sorted([("lib", x) for x in "rfdmg"] + [("bin", x) for x in "bh"])
    assert rows(masks.names("files").select("cu_id", "file_path")) == [("bin", "src/main.rs"), ("lib", "src/lib.rs"), ("lib", "src/m.rs")]
    assert rows(N.unit_counts(masks)) == [("bin", 2, 1, 1), ("lib", 5, 5, 2)]
    cfgs = spark.createDataFrame([("d", False), ("f", True)], "id string, on boolean")
    assert masks.nodes.count() == 7 and rows(masks.enabled("nodes", ["bin"])) == [("b",), ("h",)] and masks.enabled("edges", []).count() == masks.enabled("edges", ["lib", "bin"]).count() == 6
    assert rows(N.unit_masks(units, files, edges, cfgs, F.col("on")).names("nodes").select("cu_id", "id")) == [("bin", "b"), ("bin", "h"), ("lib", "f"), ("lib", "r")]
    vectors, _ = E.put_vectors(schema.RELATIONS["vectors"].empty(spark), spark.createDataFrame([(x, [1.0]) for x in "fgh"], "node_id string, vector array<float>"), 1, 1, 1)
    stored = spark.createDataFrame([("src/lib.rs", "1"), ("src/m.rs", "1"), ("src/main.rs", "1")], "file_path string, hash string")
    current = spark.createDataFrame([("src/lib.rs", "1"), ("src/m.rs", "2"), ("src/main.rs", "1"), ("src/n.rs", "1")], "file_path string, hash string")
    out = N.apply_changes(stored, current, files, edges, vectors, 1, 9)
    assert rows(out["changes"]) == [("src/m.rs", "modified"), ("src/n.rs", "added")]
    assert rows(out["touched"]) == [("g",), ("m",)]
    nodes = spark.createDataFrame([(x, "function") for x in "fgh"], "id string, node_type string")
    assert rows(E.pending(nodes, out["vectors"], 1)) == [("g", "function")]
    places = spark.createDataFrame([("f", ["crate"], "run", "src/lib.rs")], "id string, module_path array<string>, name string, file_path string")
    assert rows(N.canonical_id(places, "crate::run")) == [("f",)]
    assert G.PRIMARY


def test_refresh_reads_changed_files_again(spark):
    def contents(**texts):
        return spark.createDataFrame([(f"src/{k}.rs", bytearray(v.encode())) for k, v in texts.items()], "file_path string, content binary")

    before = contents(a="fn one() { old(); }\nstruct S { x: u8 }", b="fn two() {}", c="fn three() {}")
    tables = {k: G.written(v) for k, v in rust_relations.to_tables(G.written(rust_relations.parse_rows(before)), 1).items() if k in ("function", "method", "struct", "field", "file_mod", "module", "syntax_edge", "named_type")}
    stored = G.written(files.file_hashes(before))
    nodes = tables["function"].select("id", "name", F.col("body").alias("text"))
    vectors = nodes.select(F.col("id").alias("node_id"), F.lit(1).cast("long").alias("set_id"), F.array(F.lit(1.0).cast("float")).alias("vector"), F.lit(1).cast("long").alias("ts"), F.lit(True).alias("is_assert"))
    postings = N.build_index(nodes)
    after = contents(a="fn one() { fresh(); }\nstruct S { y: u16 }", b="fn two() {}", d="fn four() {}")
    out = N.refresh(tables, stored, after, vectors, postings, 1, 5)
    assert {(r.file_path, r.change) for r in out["changes"].collect()} == {("src/a.rs", "modified"), ("src/c.rs", "removed"), ("src/d.rs", "added")}
    live = lambda name: T.live(out[name], schema.RELATIONS[name].keys)
    assert sorted((r.name, r.body) for r in live("function").collect()) == [("four", "{}"), ("one", "{ fresh(); }"), ("two", "{}")]
    assert [r.name for r in live("field").collect()] == ["y"] and live("file_mod").count() == 3
    assert {r.name for r in nodes.join(T.live(out["vectors"], ["node_id", "set_id"]), F.col("node_id") == F.col("id"), "left_semi").collect()} == {"two"}
    terms = {r.term for r in out["postings"].select("term").distinct().collect()}
    assert {"fresh", "four", "two"} <= terms and not {"old", "three"} & terms


def test_namespaces_with_workspaces(spark):
    crates = lambda *rows: spark.createDataFrame(list(rows), "namespace string, name string, root_path string")
    spaces = lambda root, *members: spark.createDataFrame([(root, list(members))], "root_path string, members array<string>")
    existing = {"crates": crates(("n1", "a", "/w/a")), "workspaces": spaces("/w", "n1")}
    out, stale = M.import_namespace(existing, {"crates": crates(("n2", "b", "/w/b")), "workspaces": spaces("/w", "n2", "n1")})
    assert stale == {"sparse", "dense"} and out["crates"].count() == 2
    assert [(r.root_path, r.members) for r in out["workspaces"].collect()] == [("/w", ["n1", "n2"])]
    for wrong, space in ((("n2", "a", "/w/b"), "/w"), (("n2", "b", "/x/b"), "/x")):
        with pytest.raises(ValueError):
            M.import_namespace(existing, {"crates": crates(wrong), "workspaces": spaces(space, "n2")})
    own = spark.createDataFrame([("k1", "n1"), ("k2", "n2")], "id string, namespace string")
    files_ = spark.createDataFrame([("f1", "x.rs", "n1"), ("f2", "y.rs", "n2")], "owner_id string, file_path string, namespace string")
    edges = spark.createDataFrame([("f1", "i1", "Contains"), ("f2", "i2", "Contains"), ("i2", "i1", "Uses")], "source_id string, target_id string, relation_kind string")
    nodes = spark.createDataFrame([("i1",), ("i2",)], "id string")
    left, stale = M.remove_namespace({"nodes": (nodes, "id")}, own, files_, edges, out["workspaces"], "n1")
    assert [r.id for r in left["nodes"].collect()] == ["i2"] and left["edges"].count() == 1 and left["files"].count() == 1 and stale
    assert [r.members for r in left["workspaces"].collect()] == [["n2"]]


def test_masks_of_many_units_are_one_row_a_node(spark):
    """150 units, each with a root of its own that leads into a shared chain at some place."""
    chain = [(f"n{i}", f"n{i + 1}", "Contains") for i in range(12)]
    edges = spark.createDataFrame([*chain, ("n12", "n5", "Contains"), *((f"r{u}", f"n{u % 9}", "Contains") for u in range(150))], "source_id string, target_id string, relation_kind string")
    files = spark.createDataFrame([(f"r{u}", f"f{u}", "A") for u in range(150)], "owner_id string, file_path string, namespace string")
    units = spark.createDataFrame([(f"u{u:03d}", f"f{u}") for u in range(150)], "cu_id string, target_root string")
    masks = N.unit_masks(units, files, edges)
    want = {(f"u{u:03d}", f"r{u}") for u in range(150)} | {(f"u{u:03d}", f"n{i}") for u in range(150) for i in range(min(u % 9, 5), 13) if i >= u % 9 or i >= 5}
    assert set(rows(masks.names("nodes").select("cu_id", "id"))) == want
    assert masks.nodes.where("id = 'n12'").count() == 3  # pages of 64 units
    assert {r.cu_id: r.nodes for r in N.unit_counts(masks).collect()} == {u: sum(a == u for a, _ in want) for u, _ in want}
    assert set(rows(masks.enabled("nodes", ["u000", "u149"]))) == {(i,) for u, i in want if u in ("u000", "u149")}
