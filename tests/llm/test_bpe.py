import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.bpe import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "'s", "'re", "'ll", "'LL", "s", "ve", " ", "  ", "\n", "\t", " ", "　", "the", "Été", "12", "½", "...", "!", "é", "日本", "😀", "\r\n", "don't", "''s", "<|endoftext|>", "́", "x'", "_"]


def check(texts):
    tokenizer = Tokenizer.from_file(PATH)
    ids, first = Encoder.at(PATH).encode(texts)
    assert len(first) == len(texts) + 1
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_equal_to_library_on_random_texts():
    rng = random.Random(1)
    check(["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(4000)])
    check(["".join(rng.choices(PARTS[:-4] + ["?"], k=rng.randrange(14))) for _ in range(4000)])


def test_empty_and_long():
    check([])
    check(["", "", " ", "a"])
    check(["word " * 300_000, "", "tail's"])


def test_table_starts_afresh(monkeypatch):
    import tessera.llm.bpe as bpe

    monkeypatch.setattr(bpe, "MOST_PIECES", 50)
    monkeypatch.setattr(bpe, "MOST_BYTES", 50)
    encoder = Encoder(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    for _ in range(5):
        texts = [" ".join("".join(rng.choices("abcdé", k=4)) for _ in range(30)) for _ in range(3)]
        ids, first = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, first[1:-1])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_before_an_ending():
    every = [chr(c) for r in (range(0xD800), range(0xE000, 0x20000), range(0x2FF00, 0x31400), range(0xE0000, 0xE0200)) for c in r]
    tokenizer = Tokenizer.from_file(PATH)
    encoder = Encoder(PATH)
    for lo in range(0, len(every), 20_000):
        for texts in (["\n".join(f"{c}'d a{c}b {c}1" for c in every[lo : lo + 20_000])],):
            ids, _ = encoder.encode(texts)
            assert ids.tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_random_unicode_texts():
    rng = random.Random(3)
    blocks = [(0x20, 0x7F), (0x20, 0x7F), (0xA0, 0x250), (0x300, 0x600), (0x600, 0x1200), (0x2000, 0x2100), (0x3000, 0x3400), (0x10000, 0x20000), (0xE0000, 0xE0100)]

    def text():
        return "".join(chr(rng.randrange(*rng.choice(blocks))) if rng.random() < 0.6 else rng.choice(PARTS[:-4]) for _ in range(rng.randrange(14)))

    texts = [text() for _ in range(30_000)]
    ids, first = Encoder(PATH).encode(texts)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, first[1:-1])] == want


def test_words_whose_linear_hashes_collide():
    for size in (1024, 2048, 4096):
        a = "".join("ab"[i.bit_count() % 2] for i in range(size))
        check([a, a.translate(str.maketrans("ab", "ba")), "x" + a])


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Some Words, it's 12", "", "more   of it"]
    ids, first = Encoder(path).encode(texts)
    assert [x.tolist() for x in np.split(ids, first[1:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
