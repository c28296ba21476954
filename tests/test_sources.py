import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.streaming import streams as ST


def test_source_files_and_members(spark, tmp_path):
    for name in ("a/x.rs", "a/b/y.rs", "a/z.txt", "crates/one/Cargo.toml", "crates/two/Cargo.toml", "crates/note"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("fn f() {}")
    assert sorted(os.path.basename(r.path) for r in S.source_files(spark, str(tmp_path / "a")).collect()) == ["x.rs", "y.rs"]
    assert S.workspace_members(str(tmp_path), ["a", "crates/*", "crates/t*", "none/*"]) == ["a", "crates/one", "crates/two", "crates/two"]


def test_snippets(spark):
    body = "fn é() {}\n".encode()
    contents = spark.createDataFrame([("a", bytearray(body))], "file_path string, content binary")
    good = S.file_hashes(contents).first()["hash"]
    requests = [(0, "a", 0, 2, good), (1, "a", 3, 5, good), (2, "a", 4, 6, good), (3, "a", 5, 5, good), (4, "a", 0, 99, good), (5, "a", 0, 2, "old"), (6, "b", 0, 2, good)]
    got = S.read_snippets(spark.createDataFrame(requests, "pos int, file_path string, start_byte long, end_byte long, file_hash string"), contents).orderBy("pos").collect()
    assert [(r.status, r.snippet) for r in got] == [("ok", "fn"), ("ok", "é"), ("not_text", None), ("out_of_range", None), ("out_of_range", None), ("hash_mismatch", None), ("missing", None)]


def test_read_text(spark):
    text = "one\ntwo é\nthree 日本\nfour"
    contents = spark.createDataFrame([("a", bytearray(text.encode()))], "file_path string, content binary")
    assert S.read_text(contents).first()["text"] == text
    assert S.read_text(contents, 2, 3).first()["text"] == "two é\nthree 日本"
    for n in range(1, len(text.encode())):
        row = S.read_text(contents, max_bytes=n).first()
        assert row.truncated and row.text == text.encode()[:n].decode("utf-8", "ignore")


def test_listing_and_paths(spark):
    entries = spark.createDataFrame([("b", 1, 5), ("a", 2, 5), (".h", 3, 9)], "name string, mtime long, size long")
    assert S.list_folder(entries, False, "name", 5) == (["a", "b"], False)
    assert S.list_folder(entries, True, "mtime", 2) == ([".h", "a"], True)
    assert S.list_folder(entries, False, "size", 5) == (["a", "b"], False)
    assert S.path_in_roots("/w/a/../b", ["/w"]) and not S.path_in_roots("/w/../x", ["/w"]) and not S.path_in_roots("w/a", ["/w"])


def test_snapshot_round_trip(spark, tmp_path):
    relations = {"n": spark.range(3).toDF("id"), "e": spark.createDataFrame([("a", "b")], "s string, t string")}
    S.save_snapshot(relations, str(tmp_path / "s"))
    back = S.load_snapshot(spark, str(tmp_path / "s"))
    assert {k: sorted(map(tuple, v.collect())) for k, v in back.items()} == {k: sorted(map(tuple, v.collect())) for k, v in relations.items()}
    assert set(S.load_snapshot(spark, str(tmp_path / "s"), skip=["e"])) == {"n"}


def test_prompts(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"prompt": "x", "k": 3, "radius": 1.5}, {"prompt": "y"}]')
    rows = S.read_prompts(spark, str(tmp_path / "p.json")).collect()
    assert [(r.prompt, r.k, r.radius) for r in rows] == [("x", 3, 1.5), ("y", None, None)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for extra in (False, True):
        if extra:
            spark.createDataFrame([(3, "c a")], "doc_id long, text string").write.mode("append").parquet(src)
        ST.index_stream(stream, F.split("text", " "), out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select("doc", "term", "tf").collect())) == [(1, "a", 2), (1, "b", 1), (2, "b", 1), (3, "a", 1), (3, "c", 1)]
    assert tuple(ST.finalize(got).first()) == (3, 2.0)


def test_debounce_on_a_stream(spark, tmp_path):
    rows = [("p", "2024-01-01 00:00:00.000", "Modified"), ("p", "2024-01-01 00:00:00.200", "Removed"), ("p", "2024-01-01 00:00:01.000", "Created"), ("q", "2024-01-01 00:00:00.100", "Other"), ("z", "2024-01-02 00:00:00.000", "Other")]
    frame = spark.createDataFrame(rows, "path string, at string, kind string").withColumn("at", F.to_timestamp("at"))
    frame.write.parquet(str(tmp_path / "in"))
    batch = ST.debounce(frame, "path", "at", "kind", ST.kind_rank(F.col("kind")))
    want = [("p", 1, "Created"), ("p", 2, "Removed"), ("q", 1, "Other")]
    assert sorted(tuple(r) for r in batch.where("path != 'z'").select("path", "events", "kind").collect()) == want
    stream = ST.debounce(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "path", "at", "kind", ST.kind_rank(F.col("kind")), late="1 second")
    query = stream.writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("debounced").select("path", "events", "kind").collect()) == want


@pytest.mark.parametrize("name", ["bm25_topk_documents", "knn_l2_topk", "context_strict_budget"])
def test_registered_queries_run(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
