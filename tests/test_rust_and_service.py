import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schema, service
from tessera.operators import embeddings as E
from tessera.operators import graph as G
from tessera.operators import temporal as T
from tessera.sources import rust

LIB = '''//! docs { not a brace
use std::{fmt, io};
pub const LIMIT: [u8; 2] = { [1, 2] };
mod declared;
pub mod inline {
    pub(crate) fn helper<'a>(s: &'a str) -> &'a str { if s == "}" { s } else { "{" } }
    struct Unit;
}
/* fn hidden() {} */
pub struct Thing { pub a: u32 }
impl Thing {
    pub fn go(&self) -> char { '{' }
    async unsafe fn more() {}
}
trait Run { fn run(&self); fn twice(&self) { self.run(); } }
macro_rules! mac { ($x:expr) => { fn inner() {} }; }
pub async fn é_last() { let r = r#"fn no() {"#; }
enum E { A, B { x: i32 } }
type Alias = Thing;
'''


def test_items_of_a_file():
    items = rust.parse("src/lib.rs", LIB)
    got = [(i["node_type"], i["name"], "::".join(i["path"])) for i in items[1:]]
    assert got[:6] == [("import", "std", "crate"), ("const", "LIMIT", "crate"), ("module", "declared", "crate::declared"), ("module", "inline", "crate::inline"), ("function", "helper", "crate::inline"), ("struct", "Unit", "crate::inline")]
    assert [x[:2] for x in got[6:]] == [("struct", "Thing"), ("impl", "Thing"), ("method", "go"), ("method", "more"), ("trait", "Run"), ("method", "run"), ("method", "twice"), ("macro", "mac"), ("function", "é_last"), ("enum", "E"), ("type_alias", "Alias")]
    raw = LIB.encode()
    text = {i["name"]: raw[i["span_start"] : i["span_end"]].decode() for i in items[1:]}
    assert text["helper"].startswith("pub(crate) fn") and text["helper"].endswith('"{" } }') and text["mac"].endswith("}; }")
    assert text["é_last"].startswith("pub async") and text["LIMIT"].endswith("};")
    changed = rust.parse("src/lib.rs", LIB.replace("a: u32", "a:  u32 /* x */"))
    assert [i["tracking_hash"] for i in changed if i["name"] == "Thing"] == [i["tracking_hash"] for i in items if i["name"] == "Thing"]
    assert len({i["id"] for i in items}) == len(items)
    assert rust.module_path("a/src/m/mod.rs") == ["crate", "m"] and rust.parse("x.rs", "")[0]["node_type"] == "module"


def test_parsed_files_make_a_graph(spark):
    files = spark.createDataFrame([("src/lib.rs", bytearray(LIB.encode())), ("src/bad.rs", bytearray(b"\xff"))], "file_path string, content binary")
    parsed = rust.parse_files(files)
    assert [r.file_path for r in parsed.where("error is not null").collect()] == ["src/bad.rs"]
    r = {k: G.written(v) for k, v in rust.to_relations(parsed).items()}
    places = G.item_places(r["nodes"], r["edges"], r["modules"], r["files"])
    assert {x.name for x in G.resolve_exact(places, "function", "src/lib.rs", ["crate", "inline"], "helper").collect()} == {"helper"}


def test_embedding_sets(spark):
    sets = schema.RELATIONS["embedding_set"].empty(spark)
    sets = E.register_set(E.register_set(sets, "p", "m/x-1", 3, 1), "p", "m/x-1", 3, 2)
    one = T.live(sets, ["id"]).collect()
    assert len(one) == 1 and one[0].rel_name == "emb_m_slash_x_1_3"
    log = schema.RELATIONS["vectors"].empty(spark)
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0]), ("c", []), ("d", [float("nan"), 0.0, 0.0]), ("e", [0.0, 1.0, 0.0])], "node_id string, vector array<float>")
    log, bad = E.put_vectors(log, rows, one[0].id, 3, 5)
    assert sorted(map(tuple, bad.collect())) == [("b", "dimensions"), ("c", "empty"), ("d", "not finite")]
    nodes = spark.createDataFrame([("a", "function"), ("b", "method"), ("e", "struct"), ("z", "impl")], "id string, node_type string")
    assert {r.id for r in E.pending(nodes, log, one[0].id).collect()} == {"b"}
    edges = spark.createDataFrame([("m", "a", "Contains"), ("k", "e", "Contains")], "source_id string, target_id string, relation_kind string")
    log = E.retract_changed(log, one[0].id, spark.createDataFrame([("m",)], "id string"), edges, 9)
    assert {r.id for r in E.pending(nodes, log, one[0].id).collect()} == {"a", "b"}
    assert [(r.node_id, r.op) for r in E.changes_since(log, 5).collect()] == [("a", "retract")]
    assert sorted(map(tuple, E.status(nodes, log, one[0].id).collect())) == [("function", 1, 0), ("impl", 1, 0), ("method", 1, 0), ("struct", 1, 1)]
    chosen = spark.createDataFrame([("A", None), ("B", 7)], "namespace string, set_id long")
    assert sorted(map(tuple, E.active_set(chosen, T.live(sets, ["id"]), log).collect())) == [("A", one[0].id), ("B", 7)]


def test_provider_calls(spark):
    assert E.check_response([1, 0], [[1, 2], [3, 4]], 2, 2) == [[3.0, 4.0], [1.0, 2.0]]
    for bad in (([0], [[1, 2]], 2, 2), ([0, 0], [[1, 2], [1, 2]], 2, 2), ([0, 5], [[1, 2], [1, 2]], 2, 2), ([0, 1], [[1, 2], [1]], 2, 2), ([0, 1], [[1, 2], [1, float("inf")]], 2, 2)):
        with pytest.raises(ValueError):
            E.check_response(*bad)

    def provider(texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("down")
        return list(range(len(texts)))[::-1], [[float(len(t)), 1.0] for t in texts][::-1]

    rows = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "fail"), (4, "x")], "id long, t string").coalesce(1)
    got = {r.id: (r.vector, r.error) for r in E.embed(rows, F.col("t"), provider, 2, batch=2, wait=0.01).collect()}
    assert got == {1: ([2.0, 1.0], None), 2: ([3.0, 1.0], None), 3: (None, "down"), 4: (None, "down")}


def test_schema_registers_every_relation(spark):
    schema.register(spark, {})
    assert spark.sql("SELECT * FROM syntax_edge").columns[:3] == ["source_id", "target_id", "relation_kind"]
    for r in schema.RELATIONS.values():
        assert set(r.keys) <= set(r.schema.fieldNames())


def test_retriever(spark):
    rng = np.random.default_rng(3)
    texts = ["fn add_one(x: i32) -> i32", "fn compute_answer() -> u8", "struct Point", "fn parse_json(s: &str)", "enum Color"]
    nodes = spark.createDataFrame([(f"n{i}", "function", t.split()[1].split("(")[0], f"f{i % 2}.rs", f"crate::x{i}", "AB"[i % 2], t) for i, t in enumerate(texts)], "id string, node_type string, name string, file_path string, canon string, namespace string, text string")
    v = rng.normal(size=(5, 4)) / 10
    vectors = spark.createDataFrame([(f"n{i}", x.tolist(), "function", "AB"[i % 2]) for i, x in enumerate(v)], "id string, vector array<double>, node_type string, namespace string")
    r = service.Retriever(nodes, vectors)
    queries = spark.createDataFrame([("q1", "compute", v[2].tolist()), ("q2", "json parse", v[3].tolist())], "query string, text string, vector array<double>")
    assert {x["query"]: x.id for x in r.search_bm25(queries, 1).collect()} == {"q1": "n1", "q2": "n3"}
    assert {x["query"]: x.id for x in r.search_dense(queries, 1).collect()} == {"q1": "n2", "q2": "n3"}
    assert {x.id for x in r.search_dense(queries, 9, namespace="A").collect()} == {"n0", "n2", "n4"}
    assert {x["query"]: x.id for x in r.hybrid(queries, 1).collect()}["q2"] == "n3"
    out = r.get_context(queries, 1000).collect()
    assert {x.canon for x in out if x["query"] == "q2" and x.admitted} >= {"crate::x3"}
    assert r.get_context(queries, 1000, diversify=True).count() == len(out)
