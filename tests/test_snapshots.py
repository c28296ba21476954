"""Stores whose relations change as one."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import manifests, shared
from tessera.operators import adjacency
from tessera.sources import snapshots as S


@pytest.fixture
def store(spark):
    out = S.SnapshotStore(spark, shared.scratch(spark, "store"))
    out.save(
        {
            "crates": spark.createDataFrame([("ca", "a", "a", "/a"), ("cb", "b", "b", "/b")], "id string, namespace string, name string, root_path string"),
            "files": spark.createDataFrame([("ma", "a.rs", "a"), ("mb", "b.rs", "b")], "owner_id string, file_path string, namespace string"),
            "edges": spark.createDataFrame([("ma", "fa", "Contains"), ("mb", "fb", "Contains"), ("fa", "fb", "ImportedBy")], "source_id string, target_id string, relation_kind string"),
            "workspaces": spark.createDataFrame([("/w", ["a", "b"])], "root_path string, members array<string>"),
            "function": spark.createDataFrame([("fa", "one"), ("fb", "two")], "id string, name string"),
            "vectors": spark.createDataFrame([("fa", 1.0), ("fb", 2.0)], "node_id string, v double"),
        }
    )
    return out


def rows(relations, name, column):
    return sorted(r[column] for r in relations[name].collect())


def test_export_removal_and_import(spark, store):
    keys = {"vectors": "node_id"}
    artefact = S.SnapshotStore(spark, shared.scratch(spark, "artefact"))
    S.export_namespace(store, "a", artefact, keys)
    out = artefact.read()
    assert rows(out, "function", "id") == ["fa"] and rows(out, "vectors", "node_id") == ["fa"] and rows(out, "crates", "id") == ["ca"]
    assert out["edges"].count() == 2 and out["workspaces"].first()["members"] == ["a"]
    with pytest.raises(ValueError, match="namespace=a"):
        S.import_namespace(store, artefact)
    assert store.manifest.read()[0] == 1
    assert S.remove_namespace(store, "a", keys) == S.INDEXES
    now = store.read()
    assert rows(now, "function", "id") == ["fb"] and rows(now, "edges", "target_id") == ["fb"] and now["workspaces"].first()["members"] == ["b"] and rows(now, "vectors", "node_id") == ["fb"]
    assert S.import_namespace(store, artefact) == S.INDEXES
    now = store.read()
    assert rows(now, "function", "id") == ["fa", "fb"] and now["workspaces"].first()["members"] == ["a", "b"] and rows(now, "edges", "target_id") == ["fa", "fb", "fb"]
    assert rows(store.read(1), "function", "id") == ["fa", "fb"] and rows(store.read(2), "function", "id") == ["fb"]
    store.vacuum()
    assert rows(store.read(), "function", "id") == ["fa", "fb"]
    with pytest.raises(ValueError):
        S.export_namespace(store, "nowhere", artefact, keys)


def test_an_import_that_fails_half_way_changes_nothing(spark, store, monkeypatch):
    artefact = S.SnapshotStore(spark, shared.scratch(spark, "artefact"))
    S.export_namespace(store, "a", artefact, {"vectors": "node_id"})
    S.remove_namespace(store, "a", {"vectors": "node_id"})
    before, folders = store.manifest.read(), store.folders()
    real, calls = S.Change.append, []

    def failing(self, name, df):
        calls.append(name)
        if len(calls) == 3:
            raise OSError("disk full")
        real(self, name, df)

    monkeypatch.setattr(S.Change, "append", failing)
    with pytest.raises(OSError):
        S.import_namespace(store, artefact)
    assert store.manifest.read() == before and rows(store.read(), "function", "id") == ["fb"]
    left = {x.getPath().getName() for x in store.manifest._fs.listStatus(store.manifest._hadoop.Path(store.manifest.path))}
    assert left - {"_versions"} == {f.rsplit("/", 1)[1] for f in folders | store.folders(1)}


def test_of_two_changes_one_wins(spark, store):
    other = S.SnapshotStore(spark, store.manifest.path)
    fresh = spark.createDataFrame([("fc", "three")], "id string, name string")

    def make(change):
        other.change(lambda c: c.append("function", fresh))  # somebody is faster
        change.drop("function")

    with pytest.raises(manifests.Conflict):
        store.change(make)
    assert rows(store.read(), "function", "id") == ["fa", "fb", "fc"]


def parse(contents):
    lines = contents.select("file_path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("n", "line"))
    return {"line": lines, "head": lines.where("n = 0").select("file_path", "line")}


def test_refresh_writes_the_parts_of_changed_files_only(spark):
    store = S.SnapshotStore(spark, shared.scratch(spark, "files"))
    texts = {f"f{i}": f"first {i}\nsecond" for i in range(60)}
    frame = lambda x: spark.createDataFrame([(k, v.encode()) for k, v in x.items()], "file_path string, content binary")
    parsed = []

    def counting(contents):
        parsed.append(contents.count())
        return parse(contents)

    assert S.refresh(store, frame(texts), counting, 16).groupBy("change").count().collect()[0]["count"] == 60
    before = store.manifest.read()[1]["relations"]
    assert S.refresh(store, frame(texts), counting, 16).count() == 0 and store.manifest.read()[0] == 1
    now = {k: v for k, v in texts.items() if k != "f7"} | {"f3": "changed", "new": ""}
    changes = {r.file_path: r.change for r in S.refresh(store, frame(now), counting, 16).collect()}
    assert changes == {"f7": "removed", "f3": "modified", "new": "added"} and parsed == [60, 2]
    want = sorted((k, n, x) for k, v in now.items() for n, x in enumerate(v.split("\n")))
    assert sorted(tuple(r) for r in store.read()["line"].collect()) == want
    assert rows(store.read(), "head", "file_path") == sorted(now) and rows(store.read(1), "head", "file_path") == sorted(texts)
    after = store.manifest.read()[1]["relations"]
    for name in ("line", "head", S.HASHES):
        fresh = {p for p in after[name]["parts"] if after[name]["parts"][p] != before[name]["parts"].get(p)}
        assert len(fresh) <= 3 and len(after[name]["parts"]) > 10


@pytest.mark.parametrize("named", [adjacency.MOST_NAMED, 0])
def test_adjacency_is_joined_without_moving_edges(spark, monkeypatch, named):
    monkeypatch.setattr(adjacency, "MOST_NAMED", named)
    edges = [(f"a{i}", f"a{i + 1}", "Contains") for i in range(6)] + [("a6", "a2", "Contains"), ("a1", "b", "ImportedBy"), ("b", "a0", "Contains"), ("a0", "a1", "Contains"), (None, "b", "Contains")]
    frame = spark.createDataFrame(edges, "source_id string, target_id string, relation_kind string")
    stored = adjacency.Adjacency(spark, f"adj_{named}", 4).save(frame)
    ids = spark.createDataFrame([("a1",), ("b",), (None,), ("nowhere",), ("a1",)], "id string")
    got = sorted(tuple(r[c] or "" for c in ("source_id", "target_id", "relation_kind")) for r in stored.touching(ids).collect())
    assert got == sorted({(a or "", b, k) for a, b, k in edges if a in ("a1", "b") or b in ("a1", "b")})
    depths = {r.id: r.depth for r in stored.reachable(spark.createDataFrame([("a3",)], "id string")).collect()}
    assert depths == {"a3": 0, "a4": 1, "a5": 2, "a6": 3, "a2": 4}
    assert {r.id for r in stored.reachable(spark.createDataFrame([("a1",)], "id string"), back=True).collect()} == {"a1", "a0", "b"}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = stored.step(ids, ["Contains"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    if named:
        assert "Exchange" not in plan
        # files of other buckets than those of the ids are not opened: they may be gone
        one = spark.createDataFrame([("a1",)], "id string")
        held = {r[0] for r in stored.by_source().where("source_id = 'a1'").select(F.input_file_name()).distinct().collect()}
        others = [f for f in stored.by_source().inputFiles() if f not in held]
        assert len(held) == 1 and others
        for f in others:
            os.remove(f.removeprefix("file:").replace("///", "/"))
        assert [r.next for r in stored.step(one, ["Contains"]).collect()] == ["a2"]
    else:
        # the one exchange is that of the ids
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    stored.drop()


def test_rows_of_a_part_that_stay_are_written_where_they_are_read(spark, tmp_path, monkeypatch):
    store, moved = S.SnapshotStore(spark, str(tmp_path / "s")), []
    texts = {f"f{i}": f"a{i}\nb" for i in range(40)}
    frame = lambda x: spark.createDataFrame([(k, v.encode()) for k, v in x.items()], "file_path string, content binary")
    parse = lambda c: {"line": c.select("file_path", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))}
    write = S.Change._write

    def watched(self, name, rows, by=None, dealt=False):
        moved.append((name, dealt, rows.count()))
        return write(self, name, rows, by, dealt)

    S.refresh(store, frame(texts), parse, 4)
    monkeypatch.setattr(S.Change, "_write", watched)
    now = texts | {"f3": "x\ny\nz", "new": "n"}
    del now["f5"]
    S.refresh(store, frame(now), parse, 4)
    assert sorted(tuple(r) for r in store.read()["line"].collect()) == sorted((k, x) for k, v in now.items() for x in v.split("\n"))
    assert ("line", False, 4) in moved and sum(n for name, dealt, n in moved if name == "line" and dealt) > 4
    S.refresh(store, frame({"new": "n"}), parse, 4)  # parts that have no row left
    assert [tuple(r) for r in store.read()["line"].collect()] == [("new", "n")]
