import hashlib

from tessera.llm.exact_dedup import bits_for, deduplicate, decisions

SCHEMA = "doc_id long, text string, sha string, suspect int, bitmap string"


def rows():
    texts = ["a", "b", "a", None, "", "c" * 300_000, "c" * 300_000, "A"] + [f"t{i}" for i in range(300)] + ["hot"] * 200
    return [(i, t, "s", None, f"m{i}") for i, t in enumerate(texts)] + [(None, "a", None, 1, None), (7, "A", "s", None, "m7")]


def want(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in data:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((str(i), keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def test_decisions_equal_brute_force_at_any_filter_size(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    for bits in (1 << 15, 1 << 30):
        got = [(str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in decisions(docs, bits).collect()]
        assert sorted(got) == want(data)


def test_deduplicate_keeps_one_whole_row(spark):
    data = rows()
    got = deduplicate(spark.createDataFrame(data, SCHEMA)).collect()
    best = {}
    for r in data:
        key = r[1] or ""
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, best.values()))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert decisions(empty).collect() == [] and deduplicate(empty).collect() == []
    assert bits_for(0) == 1 << 15 and bits_for(10**12) == 1 << 30
