import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import toxicity as tx


def maximal(scores):
    """Plain recursion: the best segment (shortest on ties), then the same left and right of it."""

    def best(lo, hi):
        found = [(sum(scores[a:b]), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        top = max(found, key=lambda x: (x[0], -(x[2] - x[1]), -x[1]), default=(0, 0, 0))
        return [] if top[0] <= 0 else best(lo, top[1]) + [top] + best(top[2], hi)

    return best(0, len(scores))


@settings(deadline=None)
@given(st.lists(st.sampled_from([-7, -3, 1, 2, 5, 11]), max_size=14), st.integers(0, 1000))
def test_segments_equal_plain_recursion(scores, seed):
    rng = random.Random(seed)
    scores = [s + rng.random() / 1000 for s in scores]  # no ties
    got = tx.segments(scores)
    want = maximal(scores)
    assert [x[1:] for x in got] == [x[1:] for x in want]
    assert np.allclose([x[0] for x in got], [x[0] for x in want])


def corpus(n=600):
    rng = random.Random(5)
    words = ["".join(p) for p in itertools.product(["th", "er", "on", "an"], repeat=3)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(3, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grumbly", "Snark!", "vileness", "vequ" + rng.choice(words)]))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_rejection(spark):
    docs, labels = corpus()
    docs += [(9000, None, None), (9001, "", "x"), (9002, "!?", "x"), (9003, "ther " * 50_000 + "snark grumbly", "x"), (9003, "ther", "y"), (None, "on", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels + [(None, 0, 1), (3, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = tx.predictions(frame, marks).collect()
    assert len(rows) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    low = {str(r.doc_id): r.predicted for r in rows if r.doc_id in (9000, 9001, 9002, None)}
    assert set(low.values()) == {0}
    assert max(r.predicted for r in rows if r.doc_id == 9003) == 1
    kept = tx.reject(frame, marks)
    assert kept.columns == frame.columns and kept.count() == sum(1 - r.predicted for r in rows)
    found = tx.passages(frame, tx.fit(frame, marks)).collect()
    assert {"snark grumbly"} <= {r.passage for r in found if r.doc_id == 9003}


def test_no_labels_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in tx.predictions(frame, none).collect()] == [0]
    assert tx.predictions(frame.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in tx.predictions(frame, one).collect()] == [0]


def units_of(text):
    """(kind, unit) of a text's words."""
    words = {w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())}
    whole = {(0, w if len(w) <= tx.LONG else b"\0" + hashlib.sha256(w).digest()) for w in words}
    return whole | {(k, w[:k]) for k in tx.PREFIXES for w in words if len(w) >= k}


PAIR = ["documentdocument", "oqhp4xe0s6a0zbro"]  # of one hash, eight bytes at a time


def test_units_and_log_odds_equal_brute_force(spark):
    docs, labels = corpus(80)
    texts = [(t, x) for (_, t, _), (_, _, x) in zip(docs, labels)] + [(PAIR[0], 1), (f"{PAIR[1]} Éa y" + "x" * 90, 0), ("y" + "x" * 90, 1), (None, 0)]
    got = tx.log_odds(tx.count_units(spark.createDataFrame(texts, "text string, __toxic int")), 22, 62).collect()
    want = {}
    for text, toxic in texts:
        for unit in units_of(text):
            want.setdefault(unit, [0, 0])[1 - toxic] += 1
    assert {(r.kind, bytes(r.unit)): [r.y1, r.y0] for r in got} == want
    assert want[0, PAIR[0].encode()] == [1, 0] and want[0, PAIR[1].encode()] == [0, 1]
    for r in got:
        a = tx.PRIOR * (r.y1 + r.y0)
        odds = math.log((r.y1 + a) / (22 + tx.PRIOR * 84)) - math.log((r.y0 + a) / (62 + tx.PRIOR * 84))
        assert abs(r.odds - odds) < 1e-9 and abs(r.z - odds / math.sqrt(1 / (r.y1 + a) + 1 / (r.y0 + a))) < 1e-9


def test_lambda_k_and_scores_equal_brute_force(spark):
    docs, labels = corpus(300)
    texts = [(t, x) for (_, t, _), (_, _, x) in zip(docs, labels)]
    units = {0: pa.array([b"grumbly", b"snark", b"ther"], pa.large_binary()), 4: pa.array([b"vequ", b"onan"], pa.large_binary())}
    model = tx.Model(units, {0: np.array([4.0, 3.5, -2.0]), 4: np.array([3.0, 1.5])})
    known = {b"grumbly": 4.0, b"snark": 3.5, b"ther": tx.GAP}

    def scores(text):
        for w in re.findall("[a-z]+", text.lower()):
            yield known.get(w.encode(), {"vequ": 3.0, "onan": 1.5}.get(w[:4], tx.GAP))

    tokens = [s for t, x in texts if not x for s in scores(t)]
    loss, first = tx.calibrate(model, spark.createDataFrame(texts, "text string, __toxic int"))[0]
    counts = {s: tokens.count(s) + 0.5 for s in (tx.GAP, 1.5, 3.0, 3.5, 4.0)}
    assert abs(sum(n * math.exp(first.scale * s) for s, n in counts.items()) / sum(counts.values()) - 1) < 1e-6
    beyond = sum(first.scale * s >= tx.TAIL for t, x in texts if not x for s, _, _ in tx.segments(list(scores(t))))
    assert abs(first.k - max(tx.LEAST_K, (beyond + 0.5) / (len(tokens) * math.exp(-tx.TAIL)))) < 1e-9
    text = texts[0][0] + " snark grumbly"
    (evidence, _), *_ = tx._evidence(first, pa.array([text]))
    own = list(scores(text))
    words = re.findall("[a-z]+", text.lower())
    parts = {" ".join(words[i:j]): first.scale * s - math.log(max(1, first.k * len(own) / first.chance)) for s, i, j in tx.segments(own)}
    assert abs(evidence - sum(max(0, x) for x in parts.values())) < 1e-9 and evidence > 0
    p = [1 / (1 + math.exp(-(first.slope * math.log1p(next(tx._evidence(first, pa.array([t])))[0]) + first.base))) for t, _ in texts]
    assert abs(loss - np.mean([math.log(q if x else 1 - q) for q, (_, x) in zip(p, texts)])) < 1e-6


def test_constants_do_not_look_at_held_out_labels(spark):
    docs, labels = corpus(400)
    frame = spark.createDataFrame(docs, "doc_id long, text string, x string")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (tx.fit(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert (one.scale, one.k, one.chance, one.slope, one.base) == (two.scale, two.k, two.chance, two.slope, two.base)
