import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import context as C
from tessera.operators import maintenance as M
from tessera.operators import retrieval as R
from tessera.operators import vector_index as V


def test_bm25_ranks_and_scopes(spark):
    docs = spark.createDataFrame([(1, "fn add_one(x: i32)", "A"), (2, "fn compute_answer()", "A"), (3, "compute compute", "B")], "doc_id long, text string, ns string")
    terms = spark.createDataFrame([("q", "compute"), ("p", "add")], "query string, term string")
    tokens = X.code_tokens(F.col("text"))
    best = {r.query: r.doc for r in R.top_k(R.bm25_scores(docs, tokens, terms), 1, ["query"]).collect()}
    assert best == {"q": 3, "p": 1}
    scoped = R.top_k(R.bm25_scores(docs, tokens, terms, scope=F.col("ns") == "A"), 1, ["query"]).collect()
    assert {r.query: r.doc for r in scoped} == {"q": 2, "p": 1}
    assert R.bm25_scores(docs.limit(0), tokens, terms).collect() == []
    fresh = R.postings(spark.createDataFrame([(2, "other")], "doc_id long, text string"), X.code_tokens(F.col("text")))
    assert {r.term for r in R.upsert_docs(R.postings(docs, tokens), fresh).where("doc = 2").collect()} == {"other"}


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, size=(200, 3)).astype(float)  # many ties
    vectors = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(999, None, 0)], "id long, vector array<double>, label int").repartition(5)
    queries = spark.createDataFrame([("a", v[0].tolist()), ("b", v[7].tolist())], "query string, vector array<double>")
    d = {q: ((v - v[i]) ** 2).sum(1) for q, i in (("a", 0), ("b", 7))}
    brute = lambda q, ids, k: sorted((d[q][i], i) for i in ids)[:k]
    got = R.knn(queries, vectors, 12).collect()
    for q in "ab":
        assert [(r.distance, r.id) for r in sorted(got, key=lambda r: r.rank) if r["query"] == q] == brute(q, range(200), 12)
    by = R.knn(queries, vectors, 4, by=["label"]).collect()
    assert all([(r.distance, r.id) for r in sorted(by, key=lambda r: r.rank) if (r["query"], r.label) == (q, k)] == brute(q, range(k, 200, 3), 4) for q in "ab" for k in range(3))
    assert {r.id for r in R.knn(queries, vectors, 12, post_filter=F.col("label") == 1).where("query = 'a'").collect()} == {i for _, i in brute("a", range(200), 12) if i % 3 == 1}
    assert all(r.distance <= 2 for r in R.knn(queries, vectors, 50, radius=2.0).collect())
    graph = R.knn_graph(vectors.where("vector is not null"), 3, "label").collect()
    for i in (0, 5, 199):
        want = sorted((((v[i] - v[j]) ** 2).sum(), j) for j in range(i % 3, 200, 3) if j != i)[:3]
        assert [(r.distance, r.neighbour) for r in sorted(graph, key=lambda r: r.rank) if r.id == i] == want


def test_reciprocal_ranks_known_case(spark):
    make = lambda ids: spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "query string, doc string, rank int")
    got = R.top_k(R.rrf([(make(["A", "B"]), 1.0), (make(["B", "C"]), 1.0)]), 9, ["query"]).orderBy("rank").collect()
    assert [r.doc for r in got] == ["B", "A", "C"]
    assert np.allclose([r.score for r in got], [1 / 62 + 1 / 61, 1 / 61, 1 / 62])


def mmr_plain(items, k, weight, pool):
    items = sorted({i: (i, r, v) for i, r, v in sorted(items, key=lambda x: (x[1], -x[0]))}.values(), key=lambda x: (-x[1], x[0]))[:pool]
    cos = lambda a, b: 0.0 if a is None or b is None or not np.any(a) or not np.any(b) else float(np.dot(a / np.linalg.norm(a), b / np.linalg.norm(b)))
    out = []
    while items and len(out) < k:
        best = min(items, key=lambda x: (-(weight * x[1] - (1 - weight) * max([0.0, *(cos(x[2], y[2]) for y in out)])), x[0]))
        items.remove(best)
        out.append(best)
    return [x[0] for x in out]


def test_mmr_equals_plain_choice(spark):
    rng = np.random.default_rng(2)
    rows = [("q", i, float(rng.integers(0, 10)) / 10, None if i % 9 == 0 else (np.zeros(4) if i % 7 == 0 else rng.normal(size=4)).tolist()) for i in range(40)]
    ranked = spark.createDataFrame(rows, "query string, doc long, score double, vector array<double>")
    got = [r.doc for r in R.mmr(ranked, 10, pool=25).orderBy("rank").collect()]
    assert got == mmr_plain([(i, s, None if v is None else np.array(v)) for _, i, s, v in rows], 10, 0.7, 25)


def test_fallback():
    asked = []

    def status(*states):
        left = list(states)
        return lambda: asked.append(1) or left.pop(0)

    assert R.search_with_fallback("s", "d", status(("ready", 3)), True) == "s"
    assert R.search_with_fallback("s", "d", status(("building", 0), ("empty", 0), ("ready", 1)), False) == "s"
    assert R.search_with_fallback("s", "d", status(*[("empty", 0)] * 3), False) == "d" and len(asked) == 7
    with pytest.raises(RuntimeError):
        R.search_with_fallback("s", "d", status(("building", 0)), True)


def test_vector_index_recall_and_exact_search(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(30, 16)) * 3)[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    x[:900] = x[0]  # a third are alike
    monkeypatch.setattr(V, "BLOCK", 200)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 100)] + [(-1, None)], "query long, vector array<double>")
    indexes = V.VectorIndexes(spark, str(tmp_path))
    with pytest.raises(KeyError):
        indexes.search(1, asked, 5)
    assert indexes.create(1, vectors) and not indexes.create(1, vectors) and indexes.registered(1)
    want = {(q, int(i)) for q in range(0, 3000, 100) for i in np.lexsort((np.arange(3000), ((x - x[q]) ** 2).sum(1)))[:10]}
    assert {(r["query"], r.id) for r in indexes.search(1, asked, 10, exact=True).collect()} == want
    assert len({(r["query"], r.id) for r in indexes.search(1, asked, 10).collect()} & want) >= 0.9 * len(want)
    assert indexes.create(1, vectors.limit(0), replace=True) and indexes.search(1, asked, 10).count() == 0
    assert indexes.drop(1) and not indexes.drop(1) and not (tmp_path / "set-1").exists()


def test_recall_of_the_vector_index_on_the_tables(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    x = np.array([r.vector for r in vectors.orderBy("id").collect()], float)
    ids = np.array([r.id for r in vectors.orderBy("id").collect()])
    V.build(vectors, str(tmp_path / "index"))
    asked = vectors.where("id % 100 = 0").withColumnRenamed("id", "query")
    at = np.flatnonzero(ids % 100 == 0)
    want = {(int(ids[q]), int(i)) for q in at for i in ids[np.lexsort((ids, ((x - x[q]) ** 2).sum(1)))[:20]]}
    got = {(r["query"], r.id) for r in V.search(spark, str(tmp_path / "index"), asked, 20).collect()}
    assert len(got & want) >= 0.9 * len(want)


def budget_plain(parts, max_total, per_file, per_part, strict):
    total, used, out, stopped = 0, {}, [], False
    for p in parts:
        n = min(-(-len(p["text"]) // 4), per_part)
        stopped = stopped or (not strict and n > max_total)
        ok = not stopped and (not per_file or used.get(p["file_path"], 0) + n <= per_file) and (not strict or total + n <= max_total)
        if ok:
            total += n
            used[p["file_path"]] = used.get(p["file_path"], 0) + n
        out.append((p["id"], ok))
    return out


def test_context_budget_equals_plain_loop(spark):
    rng = random.Random(4)
    rows = [{"query": rng.choice("ab"), "id": i, "file_path": rng.choice("xyz"), "kind": "function", "text": "t" * rng.randrange(0, 400), "score": rng.randrange(20) / 10} for i in range(120)]
    parts = spark.createDataFrame(pd.DataFrame(rows))
    for policy in ("score", "file"):
        for total, file, part, strict in ((500, 200, 60, True), (500, 0, 60, True), (50, 200, 90, False), (10**6, 300, 100, False)):
            got = C.assemble(parts, policy, total, file, part, strict).collect()
            for q in "ab":
                key = (lambda r: (-r["score"], r["id"])) if policy == "score" else (lambda r: (r["file_path"], -r["score"], r["id"]))
                own = sorted((r for r in rows if r["query"] == q), key=key)
                assert [(r.id, r.admitted) for r in sorted(got, key=lambda r: r.position) if r["query"] == q] == budget_plain(own, total, file, part, strict)


def test_leases_equal_plain_loop(spark):
    rng = random.Random(6)
    rows = [(i % 3, f"m{i}", i, rng.choice([None, 1, 2]), rng.randrange(3), rng.randrange(1, 60), rng.choice([None, 0, 2])) for i in range(60)]
    frame = spark.createDataFrame(rows, "conv int, id string, path_index int, last_included int, include_count int, tokens long, ttl int")
    got = {r.id: (r.included, r.reason) for r in C.select_leased(frame, 100).collect()}
    for conv in range(3):
        order = sorted((r for r in rows if r[0] == conv and not (r[6] is not None and r[6] <= 0)), key=lambda r: (-(r[3] or 0), -r[4], -r[2], r[1]))
        total, kept = 0, []
        for r in order:
            if not kept or total + r[5] <= 100:
                total, kept = total + r[5], [*kept, r[1]]
        for r in rows:
            if r[0] == conv:
                expired = r[6] is not None and r[6] <= 0
                assert got[r[1]] == (r[1] in kept and not expired, "TtlExpired" if expired else None if r[1] in kept else "Budget")


def test_greedy_acceptance_equals_plain_loop(spark):
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(25):02d}", 0, f"f{rng.randrange(12)}", rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    rows = [(p, int(p[1:]) // 3, f, a, b) for p, _, f, a, b in rows]
    got = {r.id: r.status for r in M.accept_greedily(spark.createDataFrame(rows, "id string, proposed_at long, file string, start long, end long")).collect()}
    taken, want = {}, {}
    for p in sorted({(r[1], r[0]) for r in rows}, reverse=True):
        spans = [(f, min(a, b), max(a, b) + (a == b)) for i, _, f, a, b in rows if i == p[1]]
        free = all(not (lo < h and l < hi) for f, lo, hi in spans for l, h in taken.get(f, []))
        want[p[1]] = "Accepted" if free else "Stale"
        for f, lo, hi in spans if free else ():
            taken.setdefault(f, []).append((lo, hi))
    assert got == want


def test_cfg_predicates(spark):
    row = spark.range(1)
    atoms = {"unix": F.lit(True), 'feature="x"': F.lit(False), "test": F.lit(True)}
    for text, want in (("unix", True), ('feature = "x"', False), ('all(unix, not(feature = "x"))', True), ("any()", False), ("all()", True), ("any(windows, test,)", True), ("not(unix", False), ("weird(unix)", False), ("", False)):
        assert row.select(M.cfg_column(text, atoms)).first()[0] is want, text


def test_admission_in_many_rounds_and_positions_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)  # a few rows a round
    rng = random.Random(9)
    rows = [{"query": rng.choice(["a", None]), "id": i, "file_path": rng.choice(["x", "y", None]), "kind": "function", "text": rng.choice([None, "", "t" * rng.randrange(0, 300)]), "score": rng.choice([None, *range(9)])} for i in range(90)]
    parts = spark.createDataFrame([tuple(r.values()) for r in rows], "query string, id long, file_path string, kind string, text string, score long")
    for total, file, part, strict in ((300, 120, 60, True), (90, 0, 60, True), (10**6, 150, 50, False)):
        got = C.assemble(parts, "score", total, file, part, strict).collect()
        for q in ("a", None):
            own = sorted((r for r in rows if r["query"] == q), key=lambda r: (r["score"] is None, -(r["score"] or 0), r["id"]))
            said = sorted((r for r in got if r["query"] == q), key=lambda r: r.position)
            assert [r.position for r in said] == list(range(1, len(own) + 1)) and [r.id for r in said] == [r["id"] for r in own]
            texts = [r for r in own if r["text"] is not None]
            want = dict(budget_plain(texts, total, file, part, strict))
            assert [r.admitted for r in said] == [want.get(r["id"], False) for r in own]


@pytest.mark.parametrize("most", [R.MOST_REPEATED, 0])
def test_postings_stay_with_their_rows_and_repeated_keys_add_up(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_REPEATED", most)
    rows = [(1, "b a b"), (2, "a"), (2, "a"), (2, "a c"), (None, "a"), (None, "a"), (3, ""), (4, None)]
    got = R.postings(spark.createDataFrame(rows, "doc_id long, text string"), X.word_tokens(F.col("text")))
    want = [(1, "a", 1, 3), (1, "b", 2, 3), (2, "a", 1, 2), (2, "a", 2, 1), (2, "c", 1, 2), (None, "a", 2, 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    nulls = R.postings(spark.createDataFrame([(1, ["x", None, "x", None])], "doc_id long, t array<string>"), F.col("t"))
    assert sorted(map(tuple, nulls.collect()), key=str) == [(1, "x", 2, 4), (1, None, 2, 4)] or sorted(map(tuple, nulls.collect()), key=str) == [(1, None, 2, 4), (1, "x", 2, 4)]
    alone = R._postings_of_rows(spark.createDataFrame(rows[:2], "doc_id long, text string"), X.word_tokens(F.col("text")), "doc_id")
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
