import random
import re
from collections import Counter

from tessera.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, n string, item_id string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def grams(w, width):
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]


def brute(docs, bench):
    best = {}
    for item_id, text in bench:
        w = words(text)
        if not w:
            continue
        width = min(5, len(w))
        item = Counter(grams(w, width))
        n = sum(item.values())
        for doc_id, body, *_ in docs:
            g = grams(words(body), width)
            for start in range(max(1, len(g) - n + 1)) if g else ():
                window = Counter(g[start : start + n])
                s = sum((item & window).values()) / sum((item | window).values())
                if s >= 0.8 - 1e-9:
                    key = (doc_id, item_id)
                    best[key] = max(best.get(key, (0, 0)), (round(s, 9), -start))
    return sorted((str(k[0]), k[1], s, -b) for k, (s, b) in best.items())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["th", "er", "É", "an", "x"], k=3))
    bench = [(i, " ".join(word() for _ in range(rng.randrange(12, 58)))) for i in range(12)]
    bench += [(100, "Two words"), (101, None), (102, "..."), (103, "one"), (104, "la la la la la la la la la la la la"), (105, " ".join(word() for _ in range(90)))]
    docs = []
    for i in range(120):
        body = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            w = words(bench[rng.randrange(12)][1])
            for _ in range(rng.randrange(0, 3)):
                k = rng.choice([0, 1, len(w) - 1, len(w) - 2, rng.randrange(len(w))])
                w[k : k + 1] = rng.choice([[], [word()], [word(), word()]])
            if i % 10 == 1:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() if rng.random() < 0.2 else x for x in w]
        docs.append((i, rng.choice([" ", ", "]).join(body), "x", None))
    docs += [(500, None, "x", "y"), (501, "", "x", "y"), (502, "say two, words", "x", "y"), (503, bench[17][1], "", ""), (504, "w " * 20_000 + bench[0][1], "", "")]
    docs += [(505, "la " * 10, "", ""), (506, "la " * 30, "", ""), (507, "one", "", ""), (508, "one", "", ""), (508, "One!", "", ""), (None, bench[1][1], "", "")]
    docs += [(600 + k, " ".join(words(bench[2][1])[k:]), "", "") for k in range(4)]
    return docs, bench


def test_matches_equal_brute_force(spark):
    for seed in (0, 1):
        docs, bench = corpus(seed)
        got = dc.matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()
        assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.word_start) for r in got) == brute(docs, bench)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ANCHORS", 150)
    docs, bench = corpus(2)
    got = dc.matches(spark.createDataFrame(docs[:40], SCHEMA), spark.createDataFrame(bench[:9], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.word_start) for r in got) == brute(docs[:40], bench[:9])


def test_fingerprint_is_the_majority(spark):
    rng = random.Random(0)
    for n in (1, 2, 7, 53, 63, 200):
        hashes = [rng.getrandbits(64) - 2**63 for _ in range(n)]
        lanes = 8 if n <= dc.NARROW else 16
        row = spark.createDataFrame([(hashes,)], "h array<long>").selectExpr(f"{dc.fingerprint('h', lanes)} AS f").first()
        want = sum((sum(h >> i & 1 for h in hashes) * 2 > n) << i for i in range(64))
        assert row.f % 2**64 == want


def test_clean_and_empty(spark):
    docs, bench = corpus(3)
    frame, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    bad = {r[0] for r in brute(docs, bench)}
    kept = dc.clean(frame, items)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] is None or str(d[0]) not in bad)
    assert dc.matches(frame.limit(0), items).collect() == []
    assert dc.matches(frame, items.limit(0)).collect() == [] and dc.clean(frame, items.limit(0)).count() == len(docs)


def test_items_that_repeat_or_lack_an_id_and_clashing_columns(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = [(1, f"before {a} behind", 7, "x"), (2, b.upper(), 7, "x"), (2, "none of it", 7, "x"), (None, a, 7, "x")]
    bench = [(5, a, 1, "y"), (5, b, 1, "y"), (None, a, 1, "y"), (5, a, 1, "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id long, similarity string")
    items = spark.createDataFrame(bench, "item_id long, text string, doc_id long, similarity string")
    got = dc.matches(frame, items).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.similarity, r.word_start) for r in got) == [("1", "5", 1.0, 1), ("1", "None", 1.0, 1), ("2", "5", 1.0, 0), ("None", "5", 1.0, 0), ("None", "None", 1.0, 0)]
    kept = dc.clean(frame, items)
    assert kept.columns == frame.columns and sorted(r.text for r in kept.collect()) == [a]
