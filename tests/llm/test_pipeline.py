import random

import corpus_pipeline
from tests.llm import test_decontaminate, test_minhash


def tables(spark, path):
    """Documents of every kind that a stage drops, and clean ones; tells which have to stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "sh"], k=4))
    clean = {i: " ".join(word() for _ in range(rng.randrange(30, 90))) for i in range(300)}
    docs, labels = [(i, t) for i, t in clean.items()], [(i, 1, 0) for i in range(0, 300, 2)]
    for i in range(300, 400):
        words = [word() for _ in range(50)]
        for _ in range(4):
            words.insert(rng.randrange(50), rng.choice(["grumbly", "snark", "vileness"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, 1))
    copies = {400 + k: k for k in range(20)}
    docs += [(i, clean[k]) for i, k in copies.items()]
    near = {}
    for i in range(420, 440):
        words = clean[i - 320].split()
        near[i] = i - 320
        docs.append((i, " ".join([*words, word()])))
    passages = [" ".join(word() for _ in range(25)) for _ in range(5)]
    docs += [(440 + k, f"{clean[200 + k].upper()} {word()} {word()}, {p} {word()} {word()}") for k, p in enumerate(passages)]
    rng.shuffle(docs)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(docs), list(enumerate(passages))


def test_stages_drop_what_they_should_and_keep_the_rest(spark, tmp_path):
    texts, bench = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = docs.columns, set(texts)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = before - kept["toxicity"]
    assert toxic == set(range(300, 400))
    by_text = {}
    for i in sorted(kept["toxicity"]):
        by_text[texts[i]] = i
    assert kept["exact_dedup"] == set(by_text.values())
    want = test_minhash.brute([(i, texts[i]) for i in kept["exact_dedup"]])
    assert kept["near_dedup"] == {i for i in want if want[i] == i}
    bad = {int(r[0]) for r in test_decontaminate.brute([(i, texts[i]) for i in kept["near_dedup"]], bench)}
    assert bad and kept["decontamination"] == kept["near_dedup"] - bad
    assert kept["packing"] == kept["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["packing"]
