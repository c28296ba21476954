"""Queries over small tables of their own, against plain Python."""

import numpy as np
import pytest

import __spark_entry__
from tessera.operators import retrieval as R


@pytest.fixture
def run(spark, tmp_path):
    """run(name, table=(rows, schema), ...): the rows of a query over these tables."""

    def call(name, **tables):
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return __spark_entry__.queries()[name](spark, str(tmp_path)).collect()

    return call


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["plain ascii text that is long enough", "short", "", "über den Fluß und durch die Wälder", "eins zwö drei vier fünf sechs", "日本語のテキストはここにあります", "abc é defghijklmnopqrstuvw", "ascii head, then später ein Umlaut", "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk", "ÄÖ", None]


def docs(texts):
    return [(i, x, "de" if i % 2 else "en", f"s{i % 3}", None if x is None else len(x)) for i, x in enumerate(texts)]


def whole(b):
    try:
        return b.decode()
    except UnicodeDecodeError:
        return None


def test_splices_and_snippets_of_all_documents(run):
    table = (docs(TEXTS), DOCS)
    raw = {i: None if x is None else x.encode() for i, x in enumerate(TEXTS)}
    want = {i: None if b is None or len(b) < 12 else whole(b"<" + b[4:8] + b"##" + b[10:]) for i, b in raw.items()}
    assert {r.doc_id: r.text for r in run("splice_edits", documents=table)} == want
    assert want[5] is None and want[6] and want[7] and sum(x is not None for x in want.values()) >= 4

    def snippet(i, b):
        if b is None:
            return "missing", None
        if i % 7 == 0:
            return "hash_mismatch", None
        if len(b) < 20:
            return "out_of_range", None
        return ("ok", whole(b[4:14])) if whole(b[4:14]) is not None else ("not_text", None)

    got = {r.doc_id: (r.status, r.snippet) for r in run("snippet_batch", documents=table)}
    assert got == {i: snippet(i, b) for i, b in raw.items()}
    assert {s for s, _ in got.values()} == {"ok", "missing", "hash_mismatch", "out_of_range", "not_text"}


def test_context_budgets_of_long_texts(run):
    texts = ["x" * n for n in (10, 900, 2000, 5000, 790, 3, 12_000, 2400, 300, 801, 44, 2100)] * 3 + [None]
    rows = [(i, x, "de" if i % 2 else "en", f"s{i % 3}", 0 if x is None else len(x)) for i, x in enumerate(texts)]
    table, talk = (rows, DOCS), ([(i // 3, i % 3, "user" if i % 2 else "assistant", "w" * i) for i in range(24)], "conv_id long, turn int, role string, text string")
    size = lambda x, most=200: min(-(-len(x) // 4), most)

    def admitted(own, most):
        """Ids in order that still fit, and their tokens."""
        ids, total = [], 0
        for i, x, *_ in sorted(own, key=lambda r: (-r[4], r[0])):
            if x is not None and total + size(x) <= most:
                ids.append(i)
                total += size(x)
        return ids, total

    budget = run("context_budget", documents=table)
    assert {(r.id, r.tokens, r.truncated, r.admitted) for r in budget} == {(i, None if x is None else size(x), x is not None and len(x) > 800, x is not None) for i, x, *_ in rows}
    strict = run("context_strict_budget", documents=table)
    for lang in ("de", "en"):
        assert [r.id for r in sorted(strict, key=lambda r: (-rows[r.id][4], r.id)) if r.query == lang and r.admitted] == admitted([x for x in rows if x[2] == lang], 3000)[0]
    assert len(strict) == len(rows)
    stats = {r.query: r for r in run("context_stats", documents=table)}
    for lang in ("de", "en"):
        own = [x for _, x, l, *_ in rows if l == lang and x is not None]
        assert (stats[lang].total_tokens, stats[lang].parts, stats[lang].truncated_parts) == (sum(map(size, own)), len(own), sum(len(x) > 800 for x in own))
    for r in run("context_plan", documents=table, conversations=talk):
        own = [x for x in rows if str(x[0] % 4) == r.query]
        ids, total = admitted(own, 3000)
        said = sum(size(x, 10**9) for c, _, role, x in talk[0] if str(c % 4) == r.query and role == "user")
        assert (r.part_tokens, r.excluded_parts, r.message_tokens, r.estimated_tokens) == (total, len(own) - len(ids), said, said + total)


def test_searches_for_every_hundredth_vector(run, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)  # more queries than a block holds
    v = np.random.default_rng(3).integers(-9, 9, size=(501, 4)).astype(float)
    table = ([(i, x.tolist(), i % 5) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    d = ((v[:, None] - v) ** 2).sum(2)
    near = lambda q, ids, k: sorted((d[q, i], i) for i in ids)[:k]
    queries, threes = range(0, 501, 100), range(3, 501, 5)
    rows = lambda name: run(name, embeddings=table)
    assert {(r["query"], r["rank"], r.distance, r.id) for r in rows("knn_l2_topk")} == {(q, n + 1, *x) for q in queries for n, x in enumerate(near(q, range(501), 20))}
    assert {(r["query"], 1 - r.score, r.id) for r in rows("knn_prefilter_label")} == {(q, *x) for q in queries for x in near(q, threes, 20)}
    assert {(r["query"], r["rank"], r.distance, r.id) for r in rows("knn_postfilter_label")} == {(q, n + 1, *x) for q in queries for n, x in enumerate(near(q, range(501), 100)) if x[1] % 5 == 3}
    assert {(r["query"], r.distance, r.id) for r in rows("radius_search")} == {(q, *x) for q in queries for x in near(q, range(501), 50) if x[0] <= 100}
    assert {(r["query"], r.label, r["rank"], r.distance, r.id) for r in rows("multi_prompt_knn")} == {(q, g, n + 1, *x) for q in queries for g in range(5) for n, x in enumerate(near(q, range(g, 501, 5), 3))}


def test_edits_proposals_and_units_of_all_rows(run):
    rows = [(i, i % 3) for i in range(240)]
    table = (rows, "event_id long, user_id long")

    def span(i):
        lo = i * 37 % 1000
        return lo, max(lo + i % 9, lo + 1)

    meet = lambda a, b: a % 3 == b % 3 and span(a)[0] < span(b)[1] and span(b)[0] < span(a)[1]
    want = {(str(a), str(b)) for a, _ in rows for b, _ in rows if str(a) < str(b) and meet(a, b)}
    assert {(r.a, r.b) for r in run("overlapping_edits", events=table)} == want and want
    taken = []
    for i in range(239, -1, -1):
        if not any(meet(i, x) for x in taken):
            taken.append(i)
    got = {r.id: r.status for r in run("accepted_edits", events=table)}
    assert got == {str(i): "Accepted" if i in taken else "Stale" for i, _ in rows} and len(taken) < 240
    assert {(r.event_id, r.state) for r in run("proposal_states", events=table)} == {(i, "denied" if i % 2 else "approved") for i, _ in rows}
    units = run("cu_cross_product", part=([(i,) for i in range(120)], "p_partkey long"))
    assert sorted(tuple(r) for r in units) == sorted((i, a, b, c) for i in range(120) for a in ("x86", "arm") for b in ("dev", "release") for c in ("", "a,b"))


def test_lines_and_texts_come_back_whole(run):
    lines = [f"{i} " + "long line " * 9 + ("License" if i == 5 else "") for i in range(12)]
    texts = ["\n".join(lines), "y" * 2048, "z" * 2049, None]
    table = (docs(texts), DOCS)
    assert {(r.doc_id, r.n, r.line) for r in run("unified_diff_filter", documents=table)} == {(0, i + 1, lines[i]) for i in range(3, 8)}
    assert {r.doc_id: r.text for r in run("truncate_for_model", documents=table)} == {0: texts[0], 1: texts[1], 2: None, 3: None}


def test_links_paths_and_chains_of_all_rows(run):
    orders = [(k, c) for k, c in enumerate([1, 2, 3, 60, 61, 7, 7, 9, 49, 12, 13, 70], 1)]
    nxt = {}
    for k, c in orders:
        nxt[c] = min(nxt.get(c, 99), k % 50 + 1)

    def follow(at):
        seen = [at]
        while seen[-1] in nxt and nxt[seen[-1]] not in seen:
            seen.append(nxt[seen[-1]])
        return f"c:{at}", f"c:{seen[-1]}", len(seen) - 1, "cycle" if seen[-1] in nxt else "ok"

    table = (orders, "o_orderkey long, o_custkey long")
    want = {follow(c) for c in nxt}
    assert {tuple(r) for r in run("reexport_chain", orders=table)} == want
    assert {x[3] for x in want} == {"ok", "cycle"} and max(x[2] for x in want) > 1

    talk = [(c, n, "user", "x") for c in range(9) for n in range(c + 1)]
    got = run("conversation_path", conversations=(talk, "conv_id long, turn int, role string, text string"))
    assert {tuple(r) for r in got} == {(f"{c}:{n}", n) for c, n, *_ in talk} and len(got) == len(talk)

    names = [f"C{i}" for i in range(99)]
    customers = [(i, names[i], i % 2, "BUILDING" if i % 3 == 0 else "OTHER") for i in range(99)]
    got = run(
        "resolve_edges", orders=table, customer=(customers, "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"), supplier=([], "s_suppkey long, s_name string, s_nationkey long"),
        nation=([(0, "N0", 0), (1, "N1", 0)], "n_nationkey long, n_name string, n_regionkey long"), region=([(0, "R")], "r_regionkey long, r_name string"),
    )
    links = {(c, c % 97 + 1) for _, c in orders}
    ends = {(a, b, "outgoing") for a, b in links} | {(b, a, "incoming") for a, b in links}
    assert {(r.source_id, r.target_id, r.direction) for r in got} == {(f"c:{a}", f"c:{b}", x) for a, b, x in ends if a % 3 == 0}
