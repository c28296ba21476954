import random
from itertools import permutations

from tessera.llm import filter_audit

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, labels):
    """Every document walks through every order of the filters."""
    import re

    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        rows.append((part or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        found = {}
        for order in permutations("ABCDE"):
            alive = own
            for step, name in enumerate(order, 1):
                gone = [r for r in alive if name in r[1]]
                found["".join(order), step] = [
                    len(alive) - len(gone), len(gone), sum(name in r[1] for r in own) - len(gone), sum(r[1] == {name} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                removed_by[name] += len(gone)
                alive = [r for r in alive if name not in r[1]]
        for (order, step), row in found.items():
            out[part, order, step] = (*row, removed_by[order[step - 1]])
    return out


def result(spark, docs, labels):
    rows = spark.createDataFrame([(i, t, None, p, 0) for i, t, p in docs], COLUMNS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(rows, known).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_equal_to_every_document_walking_through_every_order(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "Bc", "déf", "g#", "H", "ijk", "l" * rng.randrange(1, 9)])
    texts = [" ".join(rng.choice([word(), str(rng.random())]) for _ in range(rng.choice([0, 5, 199, 200, 260]))) for _ in range(30)]
    texts += [None, "", "x\x0by\x85z", " ", "A" * 3000]
    docs = [(rng.choice([None, *range(50)]), rng.choice(texts), rng.choice(["p", "q", None, ""])) for _ in range(120)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    assert result(spark, docs, labels) == brute(docs, labels)


def test_one_text_and_one_source_of_all_rows(spark):
    docs = [(i, "same words here", "hot") for i in range(300)] + [(300, "other", "cold")]
    got = result(spark, docs, [(i, 1, 0) for i in range(0, 300, 3)])
    assert got["hot", "EABCD", 1][:2] == (1, 299) and got["hot", "EABCD", 1][4] == 99
    assert len(got) == 1200


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, [], []) == {}
    rows = spark.createDataFrame([(1, "a", "s", 1, "x", 2)], "doc_id long, text string, source string, n long, part string, mask long")
    known = spark.createDataFrame([(1, 1, 1, "s")], "doc_id long, quality int, toxic int, source string")
    assert filter_audit.audit(rows, known).where("removed = 1").count() == 120


def test_survivors_of_each_subset(spark):
    rng = random.Random(5)
    masks = {m: rng.randrange(0, 9) for m in range(32) if m % 3}
    counts = spark.createDataFrame([("p", m, n, 0, 0) for m, n in masks.items()], "part string, mask int, n long, good long, toxic long")
    row = filter_audit.survivors(counts).first()
    assert list(row.alive.n) == [sum(n for m, n in masks.items() if not m & s) for s in range(32)]
    assert list(row.exact.n) == [masks.get(m, 0) for m in range(32)]
