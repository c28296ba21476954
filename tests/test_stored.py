"""The stored sparse index, manifests, the index registry, and edits that are accepted."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import manifests, shared
from tessera.functions import text as X
from tessera.operators import maintenance as M
from tessera.operators import neighbour_graph as N
from tessera.operators import retrieval as R
from tessera.operators import sparse_index as SI
from tessera.operators import vector_index as V
from tessera.service import Retriever

SCHEMA = "doc_id long, text string, lang string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(n))


def plain(spark, docs, terms, k, scope=None):
    """The same search by a scan of all texts."""
    rows = spark.createDataFrame([(i, t, s) for i, (t, s) in docs.items()], SCHEMA)
    scored = R.bm25_scores(rows, X.word_tokens(F.col("text")), terms.where("term is not null").distinct(), scope=None if scope is None else F.col("lang") == scope)
    return sorted((r.query, r["rank"], r.doc, r.score) for r in R.top_k(scored.withColumn("score", F.round("score", SI.DIGITS)), k, ["query"]).collect())


@pytest.mark.parametrize("named", [SI.MOST_NAMED, 1])
def test_searches_equal_a_scan_after_every_change(spark, monkeypatch, named):
    monkeypatch.setattr(SI, "MOST_NAMED", named)
    rng = random.Random(named)
    index = SI.SparseIndex(spark, shared.scratch(spark, "sparse"), bucket=8, merge=2)
    terms = spark.createDataFrame([("a", "alpha"), ("a", "w1"), ("b", "w7"), ("b", "w2"), ("c", "nowhere"), ("b", "w7"), ("d", None)], "query string, term string")
    assert index.status() == ("uninitialized", 0) and index.search(terms, 3).collect() == []
    docs = {}
    for turn in range(3 if named > 1 else 1):
        fresh = {i: (words(rng, rng.choice([0, 3, 30, 90])), rng.choice(["en", "fr", None])) for i in rng.sample(range(120), 50)}
        rows = [(i, t, s) for i, (t, s) in fresh.items()] + [(None, "alpha", "en")]
        index.upsert(spark.createDataFrame(rows, SCHEMA), X.word_tokens(F.col("text")), scope=F.col("lang"))
        docs |= fresh
        if turn == 1:
            gone = rng.sample(sorted(docs), 10)
            index.remove(spark.createDataFrame([(i,) for i in [*gone, 999]], "doc long"))
            docs = {i: x for i, x in docs.items() if i not in gone}
        if turn == 2:
            before = index.manifest.read()[0]
            index.merge()
            orders = [x["docs"].bit_length() for x in index.manifest.read()[1]["segments"]]
            assert len(set(orders)) == len(orders) and index.manifest.read(before)[1]["marks"]
        assert index.status() == ("ready", len(docs))
        for scope in (None, "en"):
            got = sorted((r.query, r["rank"], r.doc, r.score) for r in index.search(terms, 4, scope).collect())
            assert got == plain(spark, docs, terms, 4, scope)
    index.vacuum()
    assert sorted((r.query, r["rank"], r.doc, r.score) for r in index.search(terms, 4).collect()) == plain(spark, docs, terms, 4)
    index.remove(spark.createDataFrame([(i,) for i in docs], "doc long"))
    assert index.status() == ("empty", 0) and index.search(terms, 3).collect() == []


def test_an_upsert_writes_its_own_segment_only_and_a_search_reads_few_blocks(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 20) + (" needle" * (1 + i % 9) if i % 3 == 0 else ""), "en") for i in range(900)]
    index = SI.SparseIndex(spark, shared.scratch(spark, "sparse"), bucket=16)
    index.upsert(spark.createDataFrame(rows, SCHEMA), X.word_tokens(F.col("text")))
    first = index.manifest.read()[1]["segments"][0]["folder"]
    files = {x: spark.read.parquet(f"{first}/blocks").inputFiles() for x in range(1)}[0]
    index.upsert(spark.createDataFrame(rows[:5], SCHEMA), X.word_tokens(F.col("text")))
    now = index.manifest.read()[1]
    assert [s["docs"] for s in now["segments"]] == [895, 5] and spark.read.parquet(f"{first}/blocks").inputFiles() == files
    read, of_terms, every = index.blocks_read(spark.createDataFrame([("q", "needle")], "query string, term string"), 5)
    assert 0 < read <= of_terms / 2 and of_terms < every / 20
    # a term's folder alone is opened, and in it only row groups that may hold the term
    plan = index._blocks(now["segments"][:1], ["needle"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(term,needle)" in plan


def test_of_two_writers_one_wins_and_nothing_is_half_written(spark):
    path = shared.scratch(spark, "manifest")
    one, two = manifests.Manifest(spark, path), manifests.Manifest(spark, path)
    assert one.read() == (0, {})
    base, _ = two.read()
    assert one.commit(0, {"x": 1}) == 1
    with pytest.raises(manifests.Conflict):
        two.commit(base, {"x": 2})
    assert two.read() == (1, {"x": 1}) and two.commit(1, {"x": 3}) == 2 and one.read(1) == (1, {"x": 1})
    assert one.versions() == [1, 2]


def test_an_index_that_is_replaced_answers_until_the_new_one_is_there(spark, monkeypatch):
    path = shared.scratch(spark, "vectors")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0], "a" if i % 2 else "b") for i in range(60)], "id long, vector array<double>, namespace string")
    indexes = V.VectorIndexes(spark, path)
    assert indexes.create(1, vectors) and not indexes.create(1, vectors)
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query string, vector array<double>")
    monkeypatch.setattr(V, "build", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        indexes.create(1, vectors, replace=True)
    monkeypatch.undo()
    again = V.VectorIndexes(spark, path)  # as after a restart
    assert again.registered(1) and [r.id for r in again.search(1, asked, 3, exact=True).orderBy("rank").collect()] == [0, 5, 10]
    assert [r.id for r in again.search(1, asked, 3, exact=True, where=F.col("namespace") == "a").orderBy("rank").collect()] == [5, 15, 25]
    assert again.create(1, vectors.where("id < 4"), replace=True) and indexes.search(1, asked, 9, exact=True).count() == 4
    assert indexes.drop(1) and not again.registered(1) and not again.drop(1)


def accepted(rows):
    """Every proposal against all that were accepted."""
    taken, out = [], {}
    by_id = {}
    for i, at, f, a, b in rows:
        by_id.setdefault(i, []).append((at, f, a, b))
    newest = lambda own: max((at for at, *_ in own if at is not None), default=None)
    for i, own in sorted(by_id.items(), key=lambda x: (newest(x[1]) is not None, newest(x[1]) or 0, x[0]), reverse=True):
        spans = [(f, min(a, b), max(a, b) + (a == b)) for _, f, a, b in own if None not in (f, a, b)]
        free = not any(f == g and lo < h and l < hi for f, lo, hi in spans for g, l, h in taken)
        taken += spans if free else []
        out[i] = "Accepted" if free else "Stale"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_accepted_edits_equal_brute_force_with_nulls(spark, seed):
    rng = random.Random(seed)
    rows = [
        (f"p{rng.randrange(70)}", rng.choice([None, *range(5)]), rng.choice(["f", "g", "h", None]), rng.choice([None, *range(0, 200)]), rng.choice([None, *range(0, 200)]))
        for _ in range(120 if seed else 30)
    ]
    rows = [(i, at, f, a, a + 3 if seed == 2 and a is not None else b) for i, at, f, a, b in rows]
    frame = spark.createDataFrame(rows, "id string, proposed_at long, file string, start long, end long")
    got = M.accept_greedily(frame).collect()
    assert {r.id: r.status for r in got} == accepted(rows) and len(got) == len(accepted(rows))


def test_a_hot_file_of_ranges_that_all_overlap(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("proposed_at"), F.lit("f").alias("file"), F.col("id").alias("start"), (F.col("id") + 30_000).alias("end"))
    got = M.accept_greedily(rows).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"Accepted": 1, "Stale": 19_999}


def test_files_without_a_hash_are_not_added(spark):
    stored = spark.createDataFrame([("a", None), ("b", "1"), ("c", None), ("d", "1"), ("e", "1")], "file_path string, hash string")
    current = spark.createDataFrame([("a", "1"), ("b", None), ("c", None), ("d", "1"), ("f", None)], "file_path string, hash string")
    got = {r.file_path: r.change for r in M.scan_changes(stored, current).collect()}
    assert got == {"a": "modified", "b": "modified", "e": "removed", "f": "added"}


@pytest.mark.parametrize("block", [R.QUERY_BLOCK, 7])
def test_queries_meet_vectors_in_blocks(spark, monkeypatch, block):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(6)) for _ in range(3)] if i % 11 else None, rng.choice("ab")) for i in range(150)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    queries = vectors.where("id % 5 = 0").select(F.concat(F.lit("q"), "id").alias("query"), "vector")
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 40)
    got = {(r.query, r.label, r["rank"]): (r.id, r.distance) for r in R.knn(queries, vectors, 3, by=["label"]).collect()}
    want = {}
    for i, v, _ in rows:
        for label in "ab" if i % 5 == 0 and v else ():
            near = sorted((sum((x - y) ** 2 for x, y in zip(u, v)), j) for j, u, of in rows if u and of == label)[:3]
            want |= {(f"q{i}", label, n): (j, d) for n, (d, j) in enumerate(near, 1)}
    assert got == want


def test_a_refined_graph_finds_nearly_all_neighbours(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], "a") for i in range(900)]
    rows += [(1000 + i, [1.0] * 16, "b") for i in range(60)] + [(2000, None, "a"), (2001, [1.0], "a"), (2002, [0.0] * 16, "c"), (None, [0.0] * 16, "a"), (5, rows[5][1], "a")]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    monkeypatch.setattr(N, "PART", 40)
    begun, built = (N.build(vectors, 5, "label", rounds=r) for r in (0, N.ROUNDS))
    by = {i: (v, g) for i, v, g in rows if i is not None and v is not None and len(v) == 16}
    exact = [(i, n) for i, (v, g) in by.items() for _, n in sorted((sum((x - y) ** 2 for x, y in zip(u, v)), j) for j, (u, h) in by.items() if h == g and j != i and g == "a")[:5]]
    want = spark.createDataFrame(exact, "id long, neighbour long")
    assert N.recall(built, want) >= 0.95 > 0.9 > N.recall(begun, want)
    found = built.collect()
    assert all(by[r.id][1] == by[r.neighbour][1] and r.id != r.neighbour for r in found)
    assert all(abs(r.distance - sum((x - y) ** 2 for x, y in zip(by[r.id][0], by[r.neighbour][0]))) < 1e-9 for r in found)
    counts = {i: sum(r.id == i for r in found) for i in (0, 1000, 2002)}
    assert counts == {0: 5, 1000: 5, 2002: 0} and {r["rank"] for r in found} == {1, 2, 3, 4, 5}
    assert N.build(vectors.limit(0), 5).collect() == []


def test_a_retriever_reads_its_stored_indexes(spark):
    rng = random.Random(6)
    rows = [(f"n{i}", "function", f"fn_{i}", "a.rs", f"crate::fn_{i}", rng.choice("xy"), words(rng, 12), [rng.random() for _ in range(4)]) for i in range(80)]
    nodes = spark.createDataFrame(rows, "id string, node_type string, name string, file_path string, canon string, namespace string, text string, vector array<double>")
    plain_, stored = (Retriever(nodes.drop("vector"), nodes.select("id", "vector", "node_type", "namespace")) for _ in range(2))
    stored.index(shared.scratch(spark, "retriever"))
    queries = spark.createDataFrame([("q", "alpha w1", [0.1, 0.2, 0.3, 0.4])], "query string, text string, vector array<double>")
    for namespace in (None, "x"):
        one, two = ([(r.id, round(r.score, 6)) for r in x.search_bm25(queries, 5, namespace).orderBy("rank").collect()] for x in (plain_, stored))
        assert one == two
        assert all(r.id in {x[0] for x in rows if namespace in (None, x[5])} for r in stored.search_dense(queries, 5, namespace).collect())
    stored.nodes = stored.nodes.limit(0)  # the index answers
    assert stored.search_bm25(queries, 5).count() == 5
    stored.sparse.remove(nodes.select(F.col("id").alias("doc")))
    with pytest.raises(RuntimeError):
        stored.search_bm25(queries, 5, strict=True)


def test_blocks_are_written_by_the_tasks_of_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SI, "TASK_TOKENS", 40)
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 9)) or None) for i in range(60)] + [(5, "w1 again"), (5, "w1")]
    index = SI.SparseIndex(spark, str(tmp_path / "i"), bucket=8)
    index.upsert(spark.createDataFrame(docs, "doc_id long, text string"), F.split(F.coalesce("text", F.lit("")), " "))
    blocks = index._blocks(index.manifest.read()[1]["segments"])
    by_bucket = {}
    for r in blocks.select("bucket", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task")).collect():
        by_bucket.setdefault(r.bucket, set()).add(r.task)
    assert {len(x) for x in by_bucket.values()} == {1} and len(by_bucket) >= 7 and len(set.union(*by_bucket.values())) > 1
    assert blocks.groupBy("term", "bucket").count().where("count > 1").count() == 0
    held = {(r.doc, r.term): r.tf for r in blocks.select("term", F.explode("held").alias("h")).select("h.doc", "h.tf", "term").collect()}
    want = {}
    for i, text in docs:
        for w in (text or "").split(" "):
            want[i, w] = want.get((i, w), 0) + 1
    assert held == want


def test_an_exact_graph_of_groups_that_are_cut(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 8)
    monkeypatch.setattr(N, "EXACT_BLOCK", 32)
    rng = random.Random(9)
    table = [(i, [float(rng.randrange(6)) if i % 5 else 1.0 for _ in range(8)], i % 2) for i in range(200)]  # every fifth is a copy
    built = N.build(spark.createDataFrame(table, "id long, vector array<float>, label int"), 3, "label", rounds=0, exact=True)
    want = set()
    for i, x, label in table:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y, other in table if other == label and j != i)[:3]
        want |= {(i, j, d, n + 1) for n, (d, j) in enumerate(near)}
    assert {tuple(r) for r in built.select("id", "neighbour", "distance", "rank").collect()} == want


def test_blocks_are_made_a_bucket_at_a_time_and_words_by_compiled_code(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a  B", None), (2, None, "x"), (3, "--", "y")], SCHEMA)
    words_ = frame.select(X.word_tokens(F.col("text")).alias("w"))
    assert "lambda" not in words_._jdf.queryExecution().optimizedPlan().toString().lower() and [r.w for r in words_.collect()] == [["a", "b"], [], []]
    rows = pa.table({"bucket": [3, 3, 3], "position": [24, 30, 24], "doc": [1, 2, 1], "len": [4, 2, 4], "scope": [None, "x", None], "term": pa.array([["b", "a", None, "b"], ["a", "a"], ["b"]], pa.list_(pa.string()))})
    one = pa.struct([("position", pa.int64()), ("doc", pa.int64()), ("tf", pa.int64()), ("len", pa.int64()), ("scope", pa.string())])
    types = pa.schema([("term", pa.string()), ("bucket", pa.int64()), ("n", pa.int64()), ("max_tf", pa.int64()), ("min_len", pa.int64()), ("held", pa.list_(one))])
    made = {r["term"]: r for r in SI._make_blocks(rows, 8, types).to_pylist()}
    assert {t: (r["bucket"], r["n"], r["max_tf"], r["min_len"]) for t, r in made.items()} == {"b": (3, 1, 3, 4), "a": (3, 2, 2, 2)}
    assert [(h["position"], h["doc"], h["tf"], h["scope"]) for h in made["a"]["held"]] == [(24, 1, 1, None), (30, 2, 2, "x")]
    assert len(SI._make_blocks(rows.slice(0, 0), 8, types)) == 0


@pytest.mark.parametrize("small", [False, True])
def test_many_terms_are_scored_in_tiles_and_make_no_row_for_a_pair_and_term(spark, monkeypatch, small):
    monkeypatch.setattr(SI, "MOST_NAMED", 5)
    monkeypatch.setattr(SI.SparseIndex, "_scores", lambda *a: pytest.fail("a row for each query, document and term"))
    for name, value in dict(TILE_TOKENS=400, TILE_DOCS=30, ASKED_TERMS=200, ASKED=12, PACKED_BLOCKS=50, CELLS=70, PAIRS=8, MOST_DENSE=2).items() if small else ():
        monkeypatch.setattr(SI, name, value)
    rng = random.Random(5)
    index = SI.SparseIndex(spark, shared.scratch(spark, "sparse"), bucket=8, merge=2)
    copy = words(rng, 40)
    docs = {}
    for turn in range(2):
        fresh = {i: (copy if i % 4 == 0 else words(rng, rng.choice([0, 3, 30, 90])), rng.choice(["en", "fr", None])) for i in rng.sample(range(150), 70)}
        index.upsert(spark.createDataFrame([(i, t, s) for i, (t, s) in fresh.items()], SCHEMA), X.word_tokens(F.col("text")), scope=F.col("lang"))
        docs |= fresh
        if turn:
            gone = rng.sample(sorted(docs), 15)
            index.remove(spark.createDataFrame([(i,) for i in gone], "doc long"))
            docs = {i: x for i, x in docs.items() if i not in gone}
        asked = [(f"q{i}", w) for i in sorted(docs)[::9] for w in docs[i][0].split()] + [("few", "nowhere"), ("few", "w7"), ("none", "nowhere"), (None, "alpha"), ("few", None)]
        terms = spark.createDataFrame(asked, "query string, term string")
    for scope in (None, "fr"):
        got = sorted((r.query, r["rank"], r.doc, r.score) for r in index.search(terms, 4, scope).collect())
        assert got == plain(spark, docs, terms.where("query is not null"), 4, scope)
    index.remove(spark.createDataFrame([(i,) for i in docs], "doc long"))
    assert index.search(terms, 4).collect() == []


def test_turns_of_many_queries_read_the_postings_once(spark, monkeypatch):
    for name, value in dict(MOST_NAMED=5, TILE_DOCS=30, ASKED=4, QUERIES=3, CELLS=40).items():
        monkeypatch.setattr(SI, name, value, raising=False)
    read, materialize = [], SI.materialize
    monkeypatch.setattr(SI, "materialize", lambda df, name: read.append((name, any("/blocks/" in x for x in df.inputFiles()))) or materialize(df, name))
    rng = random.Random(6)
    docs = {i: (words(rng, rng.choice([3, 40])), None) for i in range(80)}
    index = SI.SparseIndex(spark, shared.scratch(spark, "sparse"), bucket=8)
    index.upsert(spark.createDataFrame([(i, t, s) for i, (t, s) in docs.items()], SCHEMA), X.word_tokens(F.col("text")), scope=F.col("lang"))
    terms = spark.createDataFrame([(f"q{i}", w) for i in range(0, 80, 6) for w in docs[i][0].split()], "query string, term string")
    got = sorted((r.query, r["rank"], r.doc, r.score) for r in index.search(terms, 3).collect())
    assert got == plain(spark, docs, terms, 3)
    assert len([x for x in read if x[0] == "best"]) > 2 and [name for name, blocks in read if blocks and name != "weights"] == ["tiles"]


def test_a_stored_posting_does_not_repeat_what_its_document_has(spark):
    index = SI.SparseIndex(spark, shared.scratch(spark, "sparse"))
    index.upsert(spark.createDataFrame([(1, "a b a", "x"), (2, "a", None)], SCHEMA), X.word_tokens(F.col("text")), scope=F.col("lang"))
    assert index._blocks(index.manifest.read()[1]["segments"]).schema["held"].dataType.elementType.names == ["position", "doc", "tf"]
    terms = spark.createDataFrame([("q", "a")], "query string, term string")
    assert [r.doc for r in index.search(terms, 2, scope="x").collect()] == [1] and [r.doc for r in index.search(terms, 2).collect()] == [2, 1]
