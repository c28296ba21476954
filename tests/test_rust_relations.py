import pytest

from tessera import schema
from tessera.operators import graph as G
from tessera.sources import rust_relations as R

LIB = '''//! file docs
use std::{fmt::{self, Display as Show}, io::*};
pub use crate::inner::Point;

/// A point.
/// Of two numbers.
#[derive(Debug, Clone)]
#[cfg(feature = "geo")]
pub struct Point<'a, T: Copy + Show, const N: usize> {
    /// across
    pub x: T,
    pub(crate) y: &'a mut [u8; 4],
    z: Vec<Option<T>>,
}
pub struct Pair(pub u32, (u8, i8));
pub enum Shape { Empty, Dot(u32), Line { from: u8, to: u8 } = 7, }
static mut COUNT: u32 = 0;
const NAMES: &[&str] = &["a, b", "c"];
type Call = unsafe fn(u8, &str) -> !;
impl<T: Copy> Show for Point<'_, T, 3> where T: Send {
    #[inline]
    pub fn go<U>(&mut self, mut n: usize, f: Box<dyn Fn(u8) -> u8 + Send>) -> Result<U, ()> { loop {} }
}
pub(in crate::a) trait Walk { fn step(self); const K: u8 = 1; }
macro_rules! m { () => {} }
mod other;
'''


@pytest.fixture(scope="module")
def rows():
    out = {}
    for relation, values in R.rows_of("src/lib.rs", LIB):
        out.setdefault(relation, []).append(values)
    return out


def test_every_row_fits_its_relation(spark, rows):
    for relation, found in rows.items():
        columns = [c for c in schema.RELATIONS[relation].schema.names if c not in ("ts", "is_assert")]
        for r in found:
            assert set(r) == set(columns), relation
        keys = [tuple(r[k] for k in schema.RELATIONS[relation].keys) for r in found]
        assert len(set(keys)) == len(keys), relation


def test_structs_enums_and_generics(rows):
    point, pair = rows["struct"]
    assert (point["name"], point["docstring"], point["cfgs"], point["vis_kind"]) == ("Point", "A point.\nOf two numbers.", ['feature = "geo"'], "Public")
    fields = [(f["owner_id"] == point["id"], f["index"], f["name"], f["vis_kind"]) for f in rows["field"]]
    assert fields[:3] == [(True, 0, "x", "Public"), (True, 1, "y", "Crate"), (True, 2, "z", "Inherited")]
    assert [(f["index"], f["name"]) for f in rows["field"] if f["owner_id"] == pair["id"]] == [(0, "0"), (1, "1")]
    assert [v["name"] for v in rows["variant"]] == ["Empty", "Dot", "Line"] and rows["variant"][2]["discriminant"] == "7"
    assert [f["name"] for f in rows["field"] if f["owner_id"] == rows["variant"][2]["id"]] == ["from", "to"]
    assert [(g["name"], g["bounds"]) for g in rows["generic_type"]][:1] == [("T", ["Copy", "Show"])]
    assert rows["generic_lifetime"][0]["name"] == "'a" and rows["generic_const"][0] | {"id": 0, "owner_id": 0} == {"id": 0, "owner_id": 0, "name": "N", "bounds": ["usize"]}
    names = [(a["owner_id"] == point["id"], a["name"], a["args"]) for a in rows["attribute"]]
    assert (True, "derive", ["Debug", "Clone"]) in names and (False, "inline", []) in names


def test_functions_types_and_imports(rows):
    method = next(m for m in rows["method"] if m["name"] == "go")
    assert method["owner_id"] == rows["impl"][0]["id"] and method["body"] == "{ loop {} }"
    assert [(p["name"], p["is_mutable"]) for p in rows["param"] if p["function_id"] == method["id"]] == [("&mut self", False), ("n", True), ("f", False)]
    types = {t["type_id"]: (k, t) for k, v in rows.items() if k.endswith("_type") and "type_id" in v[0] for t in v}
    kind, alias = types[rows["type_alias"][0]["type_id"]]
    assert kind == "function_type" and alias["is_unsafe"] and types[alias["return_type"]][0] == "never_type"
    y = next(f for f in rows["field"] if f["name"] == "y")
    kind, y = types[y["type_id"]]
    assert kind == "reference_type" and y["lifetime"] == "'a" and y["is_mutable"] and types[y["references_type"]][1]["size"] == 4
    assert {t["trait_bounds"][0] for t in rows["trait_object_type"]} == {"Fn(u8) -> u8"}
    assert types[rows["impl"][0]["trait_type"]][1]["path"] == ["Show"]
    assert [(i["path"], i["name"], i["is_glob"], i["is_reexport"]) for i in rows["import"]] == [(["std", "fmt"], "fmt", False, False), (["std", "fmt", "Display"], "Show", False, False), (["std", "io"], "*", True, False), (["crate", "inner", "Point"], "Point", False, True)]
    assert rows["static"][0]["is_mutable"] and rows["static"][0]["value"] == "0"
    assert rows["trait"][0]["vis_path"] == ["crate", "a"] and len(rows["trait"][0]["methods"]) == 1
    assert [m["module_kind"] for m in rows["module"]] == ["file", "declaration"] and rows["macro"][0]["name"] == "m"


def test_tables(spark):
    files = spark.createDataFrame([("src/lib.rs", bytearray(LIB.encode())), ("src/b.rs", bytearray(b"pub fn f(x: u32) -> u32 { x }")), ("src/bad.rs", bytearray(b"\xff")), ("src/none.rs", None)], "file_path string, content binary")
    parsed = G.written(R.parse_rows(files))
    assert [r.file_path for r in parsed.where("relation = 'error'").collect()] == ["src/bad.rs"]
    tables = R.to_tables(parsed, 5)
    assert set(tables) == set(schema.RELATIONS)
    assert tables["function"].select("name", "ts", "is_assert").collect()[0] == ("f", 5, True)
    ids = [r.type_id for r in tables["named_type"].collect()]
    assert len(ids) == len(set(ids)) and tables["file_mod"].count() == 3 and tables["embedding_set"].count() == 0


def test_files_of_one_partition_are_parsed_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "FILES_PER_TASK", 5)
    monkeypatch.setattr(R, "BATCH_ROWS", 4)  # less than a task's rows
    source = [(f"src/p{i}.rs", bytearray(f"pub struct P{i} {{ a: u8 }}".encode())) for i in range(60)] + [("src/bad.rs", bytearray(b"\xff"))]
    files = spark.createDataFrame(source, "file_path string, content binary").coalesce(1)
    found = R.parse_rows(files)
    assert found.rdd.getNumPartitions() >= 12
    got = found.groupBy("file_path").pivot("relation", ["struct", "field", "error"]).count().collect()
    assert sorted((r.file_path, r.struct, r.field, r.error) for r in got) == sorted([(p, 1, 1, None) for p, _ in source[:-1]] + [("src/bad.rs", None, None, 1)])
