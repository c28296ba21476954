import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import minhash as mh
from tessera.llm import textvec as tv

SCHEMA = "doc_id long, text string, class_id string, size string"


def shingles(text):
    words = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(rows, least=0.8):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and similarity(a, b) >= least:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["th", "er", "é", "an", "X"], k=3))
    texts = [[word() for _ in range(rng.randrange(1, 160))] for _ in range(60)]
    base = [word() for _ in range(150)]
    for _ in range(40):  # a group of near copies, some beyond the limit
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    passage = [word() for _ in range(60)]
    texts += [passage + [word() for _ in range(rng.randrange(5, 120))] for _ in range(40)]
    for t in rng.sample(texts, 30):
        texts.append(list(t))
    rows = [(i * 2, " ".join(t), "x", None) for i, t in enumerate(texts)]
    rows += [(1001, None, "x", None), (1003, "", "x", None), (1005, "!!", None, "y"), (1007, "a b", "x", None), (1009, "A, b.", "x", None)]
    rows += [(1011, "one two three four five six " * 20_000, None, None), (1013, "one two three four five six " * 20_001, None, None)]
    return rows + [(0, rows[0][1], "x", None), (None, rows[0][1], "x", None)]


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    other = base[:240] + [f"v{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(other), "a b c", "a a a a a a a a"]
    key = tv.run_key(mh.WORDS)
    (_, _, regions, owner, fixed, first), *_ = mh.sets_of(pa.array(texts), key)
    k = 4000
    s = mh.signatures(fixed, owner, len(texts), k)
    assert (s > 0).all()
    want = similarity(shingles(texts[0]), shingles(texts[1]))
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    a, b = (set(regions[first[i] : first[i + 1]].tolist()) for i in (0, 1))
    assert abs(len(a & b) / len(a | b) - want) < 1e-12
    alone = [next(iter(mh.sets_of(pa.array([t]), tv.run_key(mh.WORDS)))) for t in texts]
    assert all((mh.signatures(f, o, 1, k)[0] == s[i]).all() for i, (_, _, _, o, f, _) in enumerate(alone))


@pytest.mark.parametrize("block", [mh.BLOCK, 2000, 150])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mh, "BLOCK", block)  # small ones deal clusters to blocks
    rows = corpus(block)
    got = mh.classes(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute(rows)
    assert [r.class_id for r in got if r.doc_id is None] == [None]


@pytest.mark.parametrize("block", [mh.BLOCK, 3000])
def test_a_group_most_of_whose_members_are_too_far(spark, monkeypatch, block):
    monkeypatch.setattr(mh, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        t = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5])):
            t[k] = f"v{rng.randrange(100_000)}"
        rows.append((i, " ".join(t), None, None))
    rows = [r for r in rows if shingles(r[1]) != shingles(" ".join(base))]
    got = {r.doc_id: r.class_id for r in mh.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and 10 < len(set(got.values())) < 110


def test_words_whose_linear_hashes_collide():
    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    (_, _, regions, _, _, first), *_ = mh.sets_of(pa.array([f"{a} {a} {a} x y z", f"{b} {b} {b} x y z"]), tv.run_key(mh.WORDS))
    x, y = (set(regions[first[i] : first[i + 1]].tolist()) for i in (0, 1))
    assert len(x) == len(y) == 2 and not x & y


#: Two words that an invertible hash of eight bytes at a time took for one, and ones that differ in their last byte only.
ALIKE = [("documentdocument", "oqhp4xe0s6a0zbro"), ("ab", "ac"), ("x" * 500 + "a", "x" * 500 + "b")]


@pytest.mark.parametrize("pair", ALIKE)
def test_different_words_are_different_texts(spark, pair):
    rng = random.Random(9)
    rest = [f"w{rng.randrange(9)}" for _ in range(30)]
    rows = [(i, " ".join(w if k % 3 else word for k, w in enumerate(rest)), None, None) for i, word in enumerate(pair)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert brute(rows) == {0: 0, 1: 1}
    assert {r.doc_id: r.class_id for r in mh.classes(frame).collect()} == {0: 0, 1: 1}
    assert mh.deduplicate(frame).count() == 2


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = [r for r in corpus(2) if r[0] is not None]
    got = mh.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "class_id", "size"]
    want = brute(rows)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, *_ in rows if want[i] == i)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mh.classes(empty).collect() == [] and mh.deduplicate(empty).collect() == []


@pytest.mark.parametrize("edges", [mh.EDGES, 9])
def test_components_of_a_path_and_a_star(spark, monkeypatch, edges):
    monkeypatch.setattr(mh, "EDGES", edges)  # few for a task: rounds
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)]
    random.Random(0).shuffle(edges)
    got = {r.id: r["class"] for r in mh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert np.all([v <= k for k, v in got.items()])
