"""Vectorised text scanning over Arrow string columns: word spans, words and shingles for whole batches.

Which words of a slice are equal is decided by their bytes (an Arrow dictionary); across slices a word stands for its
128-bit BLAKE2b digest, or for a keyed one. Runs of words are told apart by strongly universal hashing of their words'
128 bits (multilinear: the upper halves of sums of 32-bit pieces, each times a 64-bit multiplier) with multipliers drawn
for each run of a job: whatever the texts, two different runs have the same 64-bit number with a probability of 2**-64,
and nobody can choose texts for which they have, as the multipliers are not there yet. Keyed words are hashed in the same
way, to 128 bits. Hashes for the search of candidates alone take fixed multipliers, so that it finds the same ones always.

Chunks hashes eight bytes at a time, for tables that compare bytes afterwards. Arrays are built for a bounded slice of the
batch at a time; a single text longer than the slice forms a slice of its own.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20
#: Texts handled at once.
SLICE_ROWS = 2048
#: Bytes of a word that are hashed by chunks, at most.
LONG = 64

#: Separators of plain tokens: space and the ASCII controls 0x09 to 0x0D.
BLANKS = np.ones(256, np.uint8)
BLANKS[[0x20, *range(0x09, 0x0E)]] = 0
#: Word bytes: ASCII letters and digits, and every byte of a character outside ASCII.
ALNUM = np.zeros(256, np.uint8)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Byte values with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a chunk.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = np.array(x, np.uint64, copy=True, ndmin=1)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Yield (first row, end row, bytes, starts) over a string column; null counts as empty. starts has one entry
    more than there are rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1), lo + SLICE_ROWS)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, starts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of word bytes, and for each text the index of its first run (one entry more)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(starts), np.int64)
    is_word = word[data]
    before = np.empty_like(is_word)
    before[0], before[1:] = 0, is_word[:-1]
    before[starts[starts < n]] = 0
    begin = np.flatnonzero(is_word > before)
    after = np.empty_like(is_word)
    after[-1], after[:-1] = 0, is_word[1:]
    after[starts[starts > 0] - 1] = 0
    end = np.flatnonzero(is_word > after) + 1
    return begin, end, np.searchsorted(begin, starts)


class Chunks:
    """The eight bytes from every position of a slice, from which spans are hashed."""

    def __init__(self, data: np.ndarray, values: np.ndarray | None = LOWER):
        self.data = np.zeros(len(data) + 8, np.uint8)
        self.data[: len(data)] = data if values is None else values[data]
        self.view = np.ndarray((len(data) + 1,), "<u8", self.data.data, strides=(1,))

    def at(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first size bytes from begin, 8 at most, as numbers; zeros behind them."""
        return self.view[begin] & _FIRST[np.minimum(size, 8)]

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        with np.errstate(over="ignore"):
            out = mix(self.at(begin, size) ^ (size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
            for k in range(8, LONG, 8):
                more = np.flatnonzero((size > k) & (size <= LONG))
                if not len(more):
                    break
                out[more] = mix((out[more] * np.uint64(0xE7037ED1A0B428DB)) ^ self.at(begin[more] + k, size[more] - k))
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[begin[i] : end[i]])
        return out


def distinct_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each span the number of its word, and the different words, as bytes. Spans do not overlap."""
    if not len(begin):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    marks = np.zeros(len(data) + 1, np.int8)
    np.add.at(marks, begin, 1)
    np.add.at(marks, end, -1)
    own = np.ascontiguousarray(data[np.cumsum(marks[:-1], dtype=np.int8) > 0])
    offsets = np.r_[0, np.cumsum(end - begin)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(own)])
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def digests(words: pa.Array) -> np.ndarray:
    """128-bit BLAKE2b of each word, as two columns of numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words.to_pylist()), "<u8").reshape(-1, 2)


_UPPER, _HALF = np.uint64(0xFFFFFFFF00000000), np.uint64(32)


def secret(*shape: int) -> np.ndarray:
    """Multipliers that nobody knows beforehand."""
    return np.frombuffer(os.urandom(8 * int(np.prod(shape))), "<u8").reshape(shape)


def run_key(size: int, fixed: bool = False) -> np.ndarray:
    """Multipliers for runs of up to so many words, and for their length: for each, two lanes of four pieces. Fixed ones
    are the same always."""
    shape = (size + 1, 2, 4)
    return mix(np.arange(1, 1 + int(np.prod(shape)), dtype=np.uint64)).reshape(shape) if fixed else secret(*shape)


def word_key() -> np.ndarray:
    """Multipliers of the pieces of a word of LONG bytes, and of its length: four lanes each."""
    return secret(LONG // 4 + 1, 4)


def keyed_words(words: pa.Array, key: np.ndarray) -> np.ndarray:
    """128 bits for each word, as two columns of numbers, by multipliers of word_key(); words beyond LONG bytes by way of
    their BLAKE2b digests."""
    if not len(words):
        return np.zeros((0, 2), np.uint64)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    chunks = Chunks(np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8), None)
    begin, size = offsets[:-1], np.diff(offsets)
    with np.errstate(over="ignore"):
        sums = size.astype(np.uint64)[:, None] * key[-1]
        for i in range(LONG // 4):
            more = np.flatnonzero((size > 4 * i) & (size <= LONG))
            if not len(more):
                break
            piece = chunks.at(begin[more] + 4 * i, np.minimum(size[more] - 4 * i, 4))
            sums[more] += piece[:, None] * key[i]
        for i in np.flatnonzero(size > LONG).tolist():
            pieces = np.frombuffer(hashlib.blake2b(words[i].as_py(), digest_size=16).digest(), "<u4").astype(np.uint64)
            sums[i] += (pieces[:, None] * key[:4]).sum(0, dtype=np.uint64)
    return np.ascontiguousarray((sums >> _HALF).astype("<u4")).view("<u8")


def word_sums(of_words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What each word (its 128 bits) adds to the two lanes of a run at the place that key (lanes x pieces) is for."""
    pieces = np.ascontiguousarray(of_words).view("<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([sum(pieces[:, p] * key[lane, p] for p in range(4)) for lane in range(2)], 1)


def run_number(lanes: np.ndarray, length, key: np.ndarray) -> np.ndarray:
    """A run's number from the sums of its words."""
    with np.errstate(over="ignore"):
        a, b = (lanes[:, i] + np.uint64(length) * key[-1, i, 0] for i in range(2))
    return mix((a & _UPPER) | (b >> _HALF))


def shingles(of_words: np.ndarray, index: np.ndarray, first: np.ndarray, keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of all runs of words for each of the keys, and each text's first (one entry more). Words are given by their
    numbers and what these stand for (128 bits each). A run is as long as keys have rows for. A text of fewer words, but
    at least one, gives one run of them all."""
    counts, width, n = np.diff(first), len(keys[0]) - 1, len(index)
    owner = np.repeat(np.arange(len(counts)), counts)
    runs = max(0, n - width + 1)
    whole = owner[:runs] == owner[width - 1 :] if runs else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < width))
    made = np.maximum(counts - width + 1, 0)
    made[short] = 1
    out_first = np.r_[0, np.cumsum(made)]
    long_ = np.ones(out_first[-1], bool)
    long_[out_first[short]] = False
    outs = []
    with np.errstate(over="ignore"):
        for key in keys:
            lanes = np.zeros((runs, 2), np.uint64)
            sums = [word_sums(of_words, k) for k in key[:-1]]
            for i, values in enumerate(sums):
                lanes += values[index[i : i + runs]]
            out = np.empty(out_first[-1], np.uint64)
            out[long_] = run_number(lanes, width, key)[whole]
            for t in short.tolist():
                own = sum(sums[i][w] for i, w in enumerate(index[first[t] : first[t + 1]].tolist()))
                out[out_first[t]] = run_number(own[None], int(counts[t]), key)[0]
            outs.append(out)
    return outs, out_first
