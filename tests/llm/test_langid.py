import random

import numpy as np

from tessera.llm import langid as li

WORDS = {"en": "the and of house river water thinking", "de": "der und das haus wasser nicht über", "fr": "le et maison rivière être où"}
SCHEMA = "doc_id long, text string, lang string, score string"


def corpus(n=400):
    rng = random.Random(4)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(1, 60))).capitalize() + ".", lang, "x"))
    return out


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["Abc, d", "", "12", "é", " x  y ", "abc d"]
    every = [(f, o) for f, o in li.grams(texts)]
    for i, t in enumerate(texts):
        alone = [f.tolist() for f, _ in li.grams([t])]
        assert [f[o == i].tolist() for f, o in every] == alone


def test_sums_equal_plain_tf_idf():
    rng = np.random.default_rng(1)
    model = li.Model(["a", "b"], rng.random(1 << li.BITS), rng.normal(size=(1 << li.BITS, 2)), np.array([0.1, -0.2]), 1.7)
    text = "Plain words, twice: plain words"
    f = np.concatenate([x for x, _ in li.grams([text])])
    at, n = np.unique(f, return_counts=True)
    v = n * model.idf[at]
    logits = ((li.SCALE * v / v.sum()) @ model.weights[at] + model.base) / 1.7
    want = np.exp(logits) / np.exp(logits).sum()
    assert np.allclose(li.probabilities(model, ["x", text, ""])[1], want, atol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = corpus()
    odd = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "12 !?", "de", "x"), (1003, "der und " * 60_000, None, "x"), (1003, "the", None, None), (None, "le et où", None, "x")]
    rows = li.predictions(spark.createDataFrame(docs + odd, SCHEMA)).collect()
    truth = {d[0]: d[2] for d in docs}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by = {(str(r.doc_id), r.lang_pred) for r in rows}
    assert {("1000", "und"), ("1001", "und"), ("1002", "und"), ("1003", "de"), ("1003", "en"), ("None", "fr")} <= by
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(docs) + len(odd)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, "x")], SCHEMA)
    assert [r.lang_pred for r in li.predictions(docs).collect()] == ["und"]
    assert li.predictions(docs.limit(0)).collect() == []
    one = spark.createDataFrame([(i, "abc", "en", "x") for i in range(9)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in li.predictions(one).collect()} == {("en", 1.0)}


def test_a_rare_language_is_learned(spark):
    docs = corpus(300) + [(5000 + i, "zażółć gęślą jaźń łódź źrebię", "pl", "x") for i in range(3)]
    train = spark.createDataFrame(docs, SCHEMA)
    model = li.fit(train, 12)
    assert model.langs == ["de", "en", "fr", "pl"] and np.abs(model.weights[:, 3]).sum() > 0
    assert li.fit(train, 2).langs == model.langs
