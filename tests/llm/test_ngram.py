import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ngram

SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + [None]


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 if doc_id is not None else 2


def corpus(n=300):
    rng = random.Random(7)
    vocabulary = [f"W{i}é" if i % 3 else f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary)]
        while rng.random() < 0.95:
            words.append(vocabulary[(vocabulary.index(words[-1]) * 7 + rng.choice([1, 1, 1, 5, rng.randrange(60)])) % 60])
        out.append((i, rng.choice([" ", "\n", "\t "]).join(words), "x"))
    return out + [(1000, None, "x"), (1001, "", None), (1002, "  ", "x"), (1003, "w1 " * 30_000, "x"), (0, "w3", "y"), (None, "w3 unseen", "x")]


def want(rows):
    train = Counter(t for i, x, _ in rows if fold(i) for t in tokens(x))
    total, distinct = sum(train.values()), len(train)
    for i, x, _ in rows:
        own = tokens(x)
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        yield str(i), fold(i) == 0, len(own), sum(train[t] > 0 for t in own), total, round(base, 6)


class Counts:
    """Words, pairs and triples of the texts of some folds."""

    def __init__(self, rows, folds):
        self.grams, self.begins = [Counter(), Counter(), Counter()], 0
        for i, x, _ in rows:
            if fold(i) in folds:
                own = ["^", "^", *tokens(x)]
                self.begins += 1
                for k in range(3):
                    self.grams[k].update(tuple(own[j - k : j + 1]) for j in range(2, len(own)))
        self.total, self.distinct = sum(self.grams[0].values()), len(self.grams[0])

    def probabilities(self, text, weights):
        own = ["^", "^", *tokens(text)]
        for j in range(2, len(own)):
            one = self.begins if j == 2 else self.grams[0][(own[j - 1],)]
            two = self.begins if j == 2 else self.grams[1][tuple(own[j - 2 : j])]
            w = weights[ngram.LEVELS + two.bit_length() if two else one.bit_length()]
            estimates = [self.grams[2][tuple(own[j - 2 : j + 1])] / max(two, 1), self.grams[1][tuple(own[j - 1 : j + 1])] / max(one, 1), self.grams[0][(own[j],)] / self.total]
            yield sum(a * p for a, p in zip(w, estimates)) + w[3] / (self.distinct + 1)


def brute_score(rows, weights):
    counts = Counts(rows, range(1, 10))
    for i, x, _ in rows:
        yield str(i), len(tokens(x)), round(sum(map(math.log10, counts.probabilities(x, weights))), 6)


PAIR = ["documentdocument", "oqhp4xe0s6a0zbro"]  # of one hash, eight bytes at a time


@pytest.mark.parametrize("bucket,fan", [(ngram.BUCKET, ngram.FAN), (9000, ngram.FAN), (20_000, 7)])
def test_counts_and_scores_equal_brute_force(spark, monkeypatch, bucket, fan):
    held, trained = (next(i for i in range(5000, 6000) if (fold(i) == 0) == out) for out in (True, False))
    rows = corpus() + [(trained, f"{PAIR[0]} x", ""), (held, f"{PAIR[1]} w1 {PAIR[0]}", ""), (trained + 1, "x" * 3000 + " " + "x" * 3001, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    learned = []
    real = ngram.learn
    monkeypatch.setattr(ngram, "learn", lambda *a: learned.append(real(*a)) or learned[-1])
    got = ngram.score(docs, 500, bucket, fan).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want(rows))
    assert np.allclose(learned[0].sum(1), 1)
    a = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    b = sorted(brute_score(rows, learned[0]))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_maximise_held_likelihood(spark, monkeypatch):
    rows = corpus(120)
    learned = []
    real = ngram.learn
    monkeypatch.setattr(ngram, "learn", lambda *a: learned.append(real(*a)) or learned[-1])
    ngram.score(spark.createDataFrame(rows, SCHEMA), size=10**6).collect()
    counts = Counts(rows, range(2, 10))

    def likelihood(weights):
        return sum(math.log(p) for i, x, _ in rows if fold(i) == 1 for p in counts.probabilities(x, weights))

    best = likelihood(learned[0])
    exact = exact_em(counts, [x for i, x, _ in rows if fold(i) == 1], learned[0])
    assert best > likelihood(exact) - 0.002 * abs(best)  # what the bins cost
    for other in ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 1, 1)):
        near = 0.9 * learned[0] + 0.1 * np.array(other) / sum(other)
        near[0] = learned[0][0]
        assert likelihood(near) < best + 0.002 * abs(best)


def exact_em(counts, texts, start):
    """Expectation-maximisation over every held token with its own estimates."""
    terms = {}
    for x in texts:
        own = ["^", "^", *tokens(x)]
        for j in range(2, len(own)):
            one = counts.begins if j == 2 else counts.grams[0][(own[j - 1],)]
            two = counts.begins if j == 2 else counts.grams[1][tuple(own[j - 2 : j])]
            level = ngram.LEVELS + two.bit_length() if two else one.bit_length()
            estimates = [counts.grams[2][tuple(own[j - 2 : j + 1])] / max(two, 1), counts.grams[1][tuple(own[j - 1 : j + 1])] / max(one, 1), counts.grams[0][(own[j],)] / counts.total]
            terms.setdefault(level, []).append([*estimates, 1 / (counts.distinct + 1)])
    out = start.copy()
    for level, p in terms.items():
        p, w = np.array(p), np.full(4, 0.25)
        for _ in range(300):
            share = p * w
            w = (share / share.sum(1, keepdims=True)).mean(0)
        out[level] = w
    return out


def test_empty(spark):
    assert ngram.score(spark.createDataFrame([], SCHEMA)).collect() == []
