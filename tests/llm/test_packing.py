import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import first_fit, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_equals_plain_scan(lengths):
    room, want = [], []
    for n in lengths:
        i = next((i for i, r in enumerate(room) if r >= n), None)
        if i is None:
            room.append(50)
            i = len(room) - 1
        want.append((i, 50 - room[i]))
        room[i] -= n
    assert list(zip(*first_fit(lengths, 50))) == want


def check(rows, texts, size):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return by_sequence


def test_pieces_and_sequences(spark):
    texts = [(i, "word " * (i * 7 % 90) + "é") for i in range(200)] + [(1000, None), (1001, ""), (1002, "x y " * 5000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, length string")
    sequences = check(pack_documents(docs, PATH, size=128, group=64).collect(), texts, 128)
    used = sum(r.length for own in sequences.values() for r in own)
    assert used / (128 * len(sequences)) > 0.9


def test_empty_repeated_and_null(spark):
    schema = "doc_id long, text string"
    assert pack_documents(spark.createDataFrame([], schema), PATH).collect() == []
    rows = pack_documents(spark.createDataFrame([(5, "a b")] * 3 + [(None, "c")], schema), PATH).collect()
    assert sorted((str(r.doc_id), r.start, r.length) for r in rows) == [("5", 0, 3)] * 3 + [("None", 0, 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
