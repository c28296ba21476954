import random
import zlib
from collections import Counter

import pytest

from tessera.llm import join_view


def brute_join(left, right, how):
    """The join of two bags of (key, part) as a bag."""
    out = Counter()
    lk, rk = Counter(k for k, _ in left.elements()), Counter(k for k, _ in right.elements())
    for (k, a), n in left.items():
        for (j, b), m in right.items():
            if k is not None and k == j:
                out[k, a, b] += n * m
    if how in ("right", "full"):
        out.update({(k, "-", b): m for (k, b), m in right.items() if k is None or not lk[k]})
    if how in ("left", "full"):
        out.update({(k, a, "-"): n for (k, a), n in left.items() if k is None or not rk[k]})
    return +out


def frame(spark, bag):
    return spark.createDataFrame([(k, p, n) for (k, p), n in bag.items()], "key long, part string, weight long")


@pytest.mark.parametrize("how", ["right", "full", "inner"])
def test_changes_of_every_batch_are_the_difference_of_whole_joins(spark, how, monkeypatch):
    monkeypatch.setattr(join_view, "MOST_TABLES", 2)  # states are merged on the way
    rng = random.Random(how)
    view = join_view.JoinView(how)
    bags = {"left": Counter(), "right": Counter()}
    before = Counter()
    for t in range(5):
        deltas = {}
        for side, bag in bags.items():
            delta = Counter()
            for _ in range(0 if t == 3 and side == "left" else 25):
                row = (rng.choice([None, 1, 1, 1, 2, 3, 4, 5, 6]), rng.choice(["x", "y", None]))
                delta[row] += 1 if rng.random() < 0.5 or bag[row] + delta[row] <= 0 else -1
            deltas[side] = Counter({r: n for r, n in delta.items() if n})
            bag.update(deltas[side])
        got = view.apply(frame(spark, deltas["left"]), frame(spark, deltas["right"])).collect()
        after = brute_join(bags["left"], bags["right"], how)
        want = {r: (after[r] - before[r], after[r]) for r in {*after, *before} if after[r] != before[r]}
        assert {(r.key, r.left_part, r.right_part): (r.weight, r.total) for r in got} == want and len(got) == len(want)
        before = after
    assert all(len(x) <= 2 for x in view.state.values())


def crc(*x):
    return zlib.crc32(":".join("null" if v is None else str(v) for v in x).encode())


def brute(docs, labels, batches=2):
    """Rows replayed one by one, and both joins in full."""
    out, before = set(), None
    history = {}
    for kind, rows in (("d", docs), ("l", labels)):
        for n, row in enumerate(rows):
            present, updates, states = crc(kind, row[0], 0) % 3 != 0, 0, []
            states.append((present, updates))
            for t in range(1, batches + 1):
                c = crc(kind, row[0], t) % 19
                updates += present and c == 1
                present = present != (c == 0)
                states.append((present, updates))
            history[kind, n] = states
    text = lambda v: "null" if v is None else str(v)
    for t in range(batches + 1):
        left, right = Counter(), Counter()
        for n, (i, lang) in enumerate(docs):
            present, updates = history["d", n][t]
            left[None if i is None else i // 3 + updates, text(lang)] += present
        for n, (i, quality, toxic) in enumerate(labels):
            present, updates = history["l", n][t]
            q = 1 - quality if updates % 2 and quality is not None else quality
            right[None if i is None else i // 3, f"{text(q)},{text(toxic)}"] += present
        after = brute_join(+left, +right, "right")
        if t:
            out |= {(t, *r, after[r] - before[r], after[r]) for r in {*after, *before} if after[r] != before[r]}
        before = after
    return out


def got(spark, docs, labels):
    rows = spark.createDataFrame([(i, lang, "x", 1) for i, lang in docs], "doc_id long, lang string, key string, weight long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in join_view.maintain(rows, known).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_documents_and_labels_replayed_row_by_row(spark):
    rng = random.Random(1)
    docs = [(rng.choice([None, *range(400)]), rng.choice(["en", "fr", None])) for _ in range(500)]
    labels = [(rng.choice([None, *range(400)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(400)]
    found = got(spark, docs, labels)
    assert found == brute(docs, labels) and len(found) > 50


def test_one_key_of_most_rows_and_empty_tables(spark):
    changing = next(i for i in range(1, 3000) if crc("d", i, 0) % 3 and crc("d", i, 1) % 19 == 0)
    docs = [(changing, "en")] * 400 + [(5, "fr")]
    labels = [(changing, 1, 0)] * 300
    found = got(spark, docs, labels)
    assert found == brute(docs, labels)
    assert got(spark, [], []) == set()
    assert got(spark, docs, []) == set()
    assert got(spark, [], labels) == brute([], labels)
