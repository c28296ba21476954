import hashlib

import pytest

from tessera.llm import sharding as sh


def test_table_is_full_and_even():
    names = [f"s{i}" for i in range(7)]
    table = sh.lookup_table(names, 1009)
    counts = [table.count(i) for i in range(7)]
    assert sum(counts) == 1009 and max(counts) - min(counts) <= 1
    fewer = sh.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 1009


def test_table_equals_plain_turns():
    names = ["a", "b", "c"]
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    orders = [[(number(f"offset:{n}") % 101 + j * (number(f"skip:{n}") % 100 + 1)) % 101 for j in range(101)] for n in names]
    owner = {}
    while len(owner) < 101:
        for i, order in enumerate(orders):
            free = [s for s in order if s not in owner]
            if free:
                owner[free[0]] = i
    assert sh.lookup_table(names, 101) == [owner[s] for s in range(101)]


def test_bad_parameters():
    for names, slots in ((["a", "a"], 11), ([], 11), (["a"], 12), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sh.lookup_table(names, slots)


def test_assign(spark, tmp_path):
    rows = [(i, "x" * (i % 5), None, "clash") for i in range(500)] + [(None, None, None, "c"), (None, None, 1, "c"), (3, "", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, source string")
    names = [f"s{i}" for i in range(4)]
    got = sh.assign(df, "doc_id", names, 101)
    assert got.columns == ["doc_id", "text", "source", "slot", "shard"]
    table = sh.lookup_table(names, 101)
    for r in got.collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r.shard == table[r.slot]
    assert got.count() == len(rows) and sh.assign(df.limit(0), "doc_id", names, 101).collect() == []
    sh.write_shards(df.drop("slot"), "doc_id", names, str(tmp_path / "out"), files=2, slots=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 4
