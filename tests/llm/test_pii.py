import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            holds = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if holds[kind]:
                out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.examples([]))


def test_base_is_what_the_patterns_find():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", "é", " ", "-", "+", "1", "12", "255", "256", "007", "4111111111111111", "5555 5555 5555 4444", "(", ")", "x@y.z", "1.2.3.4", "+49 30 1234567", "_", "%", "\n", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_forward_sums_and_gradient_are_those_of_all_segmentations():
    rng = np.random.default_rng(0)
    texts = ["tel 212-555-1234 1.2.3.4", "a@b.c d", "no"]
    field = pii.Field(rng.normal(0, 0.3, (len(pii._NAMES), 4)), rng.normal(0, 0.5, (4, 4)))
    tokens = pii.Tokens.of(texts)
    s, e, allowed, matrix = pii.candidates(tokens)
    row, y = np.nonzero(allowed)
    spans = (s[row], e[row], y, row, matrix)
    scores = (matrix @ field.weights)[row, y]

    def all_ways(t, end):
        """Every segmentation from token t on, as lists of candidates."""
        if t == end:
            yield []
            return
        for rest in all_ways(t + 1, end):
            yield [None, *rest]
        for c in np.flatnonzero(spans[0] == t):
            for rest in all_ways(int(spans[1][c]), end):
                yield [int(c), *rest]

    total = 0.0
    for i in range(len(texts)):
        own = np.flatnonzero(tokens.window == i)
        values = []
        for way in all_ways(own[0], own[-1] + 1):
            pairs = zip(way, way[1:])
            values.append(sum(scores[c] for c in way if c is not None) + sum(field.next_to[y[a], y[b]] for a, b in pairs if a is not None and b is not None))
        total += np.log(np.exp(values).sum())
    gold = np.zeros(len(s[row]))
    none = np.zeros((2, 0), int)
    value, weights, next_to = pii.likelihood(field, spans, gold, none, tokens)
    assert abs(value + total) < 1e-4
    for name, gradient in (("weights", weights), ("next_to", next_to)):
        for at in [(0, 0), (1, 3), (3, 3), (2, 1)]:
            x, step = getattr(field, name), 1e-4
            old = x[at]
            x[at] = old + step
            up = pii.likelihood(field, spans, gold, none, tokens)[0]
            x[at] = old - step
            down = pii.likelihood(field, spans, gold, none, tokens)[0]
            x[at] = old
            assert abs((up - down) / (2 * step) - gradient[at]) < 1e-2


def test_decoding_is_the_best_of_all_segmentations():
    rng = np.random.default_rng(1)
    text = "+1 212 555 1234 1.2.3.4 a@b.c 4111111111111111"
    for _ in range(20):
        field = pii.Field(rng.normal(0, 1, (len(pii._NAMES), 4)), rng.normal(0, 2, (4, 4)))
        tokens = pii.Tokens.of([text])
        s, e, allowed, matrix = pii.candidates(tokens)
        scores = matrix @ field.weights
        best: dict = {(0, None): 0.0}  # (token, kind that ended there): score
        for t in range(len(tokens.kind)):
            for (at, last), value in list(best.items()):
                if at != t:
                    continue
                best[t + 1, None] = max(best.get((t + 1, None), -np.inf), value)
                for c in np.flatnonzero(s == t):
                    for k in np.flatnonzero(allowed[c]):
                        key = (int(e[c]), int(k))
                        best[key] = max(best.get(key, -np.inf), value + scores[c, k] + (field.next_to[last, k] if last is not None else 0))
        want = max(v for (t, _), v in best.items() if t == len(tokens.kind))
        spans = pii.decode(field, [text], [[]])[0]
        got, before = 0.0, None
        index = {(int(tokens.begin[a]), int(tokens.end[b - 1])): i for i, (a, b) in enumerate(zip(s, e))}
        for kind, a, b in spans:
            k = pii.KINDS.index(kind)
            got += scores[index[a, b], k] + (field.next_to[before[0], k] if before and before[1] == a else 0)
            before = (k, b)
        assert abs(got - want) < 1e-6


def test_the_field_adds_what_patterns_miss_and_leaves_the_rest(field):
    seen = lambda text: [(k, text[a:b]) for k, a, b in pii.find_in(field, [text])[0][1]]
    assert seen("call (212) 555-1234 now") == [("phone", "(212) 555-1234")]
    assert seen("write to josé@example.com today") == [("email", "josé@example.com")]
    assert seen("mail jo.do (at) example.com please") == [("email", "jo.do (at) example.com")]
    for clean in ["on 2024-01-05 we met", "Version 2.0 of 1999", "about 123,456,789 of them", "token = 2abc3ff2ca8fb1e4", "see 10:30:15", "ip 256.1.1.1", "card 4111111111111112"]:
        assert seen(clean) == [], clean


def test_results_do_not_hang_on_what_is_decoded_together(field, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["tel", "212-555-1234", "a@b.cd", "1.2.3.4", "word", "4111 1111 1111 1111", "(at)", "7"]) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    alone = [pii.find_in(field, [t])[0] for t in texts]
    monkeypatch.setattr(pii, "BLOCK", 50)
    assert pii.find_in(field, texts) == alone


def test_find_over_a_table(spark, field):
    phone = "+1 (017) 555-7713"
    texts = [None, "", "no data", f"a {phone} b x.y@z.org c", "x" * 200_000 + " 10.0.0.1 " + "1" * 200_000, f"a {phone} b x.y@z.org c", "é" * 50 + "ab@cd.ef"]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip long")
    rows = {r.doc_id: r for r in pii.find(docs, field).collect()}
    for i, text in enumerate(texts):
        row, base = rows[i if i != 5 else None], brute_base(text) if i != 4 else [("ip", 200_001, 200_009)]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert row.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(row.spans.split(","))
    redacted = {r.doc_id: r for r in pii.redact(docs, field).collect()}
    assert redacted[3].text == "a <phone> b <email> c" and redacted[0].text is None and redacted[3].n_ip == 1
    assert pii.find(docs.limit(0), field).count() == 0


def test_training_on_a_table_and_on_an_empty_one(spark):
    docs = spark.createDataFrame([(i, f"word {i} a{i}@example.com and") for i in range(40)], "doc_id long, text string")
    assert {r.n_email for r in pii.audit(docs).collect()} == {1}
    assert pii.audit(docs.limit(0)).collect() == []
