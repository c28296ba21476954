import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokenfile as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@settings(deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=2, max_size=200))
def test_lengths_are_optimal_and_limited(counts):
    table = dict(enumerate(counts))
    free = tf.code_lengths(table, 16)
    if max(free.values()) < 16:
        assert sum(table[s] * n for s, n in free.items()) == huffman_cost(counts)
    for most in (8, 16):
        lengths = tf.code_lengths(table, most)
        assert max(lengths.values()) <= most
        assert sum(2.0**-n for n in lengths.values()) == 1


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 1500), st.integers(1, 400), st.integers(0, 99))
def test_codes_round_trip(n, ids, seed):
    rng = np.random.default_rng(seed)
    x = (rng.zipf(1.3, n) % ids).astype(np.uint32)
    counts = {int(a): int(b) for a, b in zip(*np.unique(np.r_[x, 7], return_counts=True))}
    book = tf.Codebook(tf.code_lengths(counts))
    bits, checkpoints = book.encode(x)
    assert book.decode(bits, checkpoints, n).tolist() == x.tolist()
    k = len(checkpoints) // 2  # a stretch alone
    if n:
        part = x[k * tf.CHECK :]
        assert book.decode(bits, checkpoints[k:], len(part)).tolist() == part.tolist()


def want(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_file_round_trip(spark):
    rng = random.Random(3)
    rows = [(i * 3, " ".join(rng.choices(["the", "été", "x1", "\n", "Zß"], k=rng.randrange(80)))) for i in range(300)]
    rows += [(10_000, None), (10_001, ""), (10_002, "long " * 40_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int").repartition(5)
    encoded = tf.encode_documents(docs, PATH, 2)
    path = tf.scratch(spark, "test")
    tf.write(encoded, tf.code_lengths(tf.id_counts(encoded)), path, part=5000, block=700)
    got = tf.digest(spark, path).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want(rows)
    ids = {r.doc_id: r.ids for r in tf.decode_documents(spark, path, with_ids=True).collect()}
    assert ids[10_001] == [2] and len(ids[10_002]) > 40_000


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert tf.digest(spark, tf.write_documents(spark.createDataFrame([], schema), PATH, 2)).collect() == []
    docs = spark.createDataFrame([(4, "a"), (4, "a"), (None, "b c")], schema)
    got = tf.digest(spark, tf.write_documents(docs, PATH, 2)).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in got) == [("4", 3, 2), ("4", 5, 2), ("None", 0, 3)]


def test_vocabularies_beyond_two_bytes():
    counts = {i: 1 + (i % 997) ** 2 for i in range(70_000)}
    lengths = tf.code_lengths(counts)
    assert tf.MAX_BITS < max(lengths.values()) <= 17 and sum(2.0 ** -x for x in lengths.values()) <= 1
    book = tf.Codebook(lengths)
    ids = np.random.default_rng(0).integers(0, 70_000, 5000).astype(np.uint32)
    bits, checkpoints = book.encode(ids)
    assert (book.decode(bits, checkpoints, len(ids)) == ids).all()
