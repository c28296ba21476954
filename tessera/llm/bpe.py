"""Whole texts to token ids, with the tokenizers library called once for each distinct piece.

A byte-level BPE vocabulary splits a text into pieces (a word with its leading space, a run of digits, of other
signs, of white space) and never merges across them. Encoder finds the pieces of a batch with array operations,
looks them up in a bounded table that holds their bytes, and hands only pieces it has not met to the library. What
kind of character a code point is, is asked of the tokenizer's own splitter when it first occurs. Ids equal those of
``Tokenizer.encode(text, add_special_tokens=False)``; a text that contains the string of an added token goes to the
library whole, and so do all texts if the vocabulary splits in another way.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from tessera.llm.common import KEPT
from tessera.llm.textvec import Chunks, mix

#: Characters handled at once.
SLICE_CHARS = 1 << 18
#: Pieces, and bytes of long ones, after which the table starts afresh.
MOST_PIECES = 1 << 20
MOST_BYTES = 1 << 23
#: Bytes of pieces that are compared as two numbers; longer ones are looked up by their bytes.
SHORT = 16
_LETTER, _NUMBER, _OTHER, _BLANK, _UNKNOWN = range(5)


def pieces(chars: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Begin of every piece in code points of the given kinds; starts are the texts' first characters. The rule, for
    runs of one kind: white space before something else leaves its last character to it if that is a space, else on
    its own; an apostrophe alone takes the s, t, re, ve, m, ll or d that follows."""
    n = len(chars)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    begin = change | edge[:n]
    run_start = begin.copy()
    blank = kind == _BLANK
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    begin[last] = True
    joined = last[chars[last] == 32]
    begin[joined + 1] = False
    quote = np.flatnonzero((chars[:-1] == 39) & begin[:-1] & (kind[1:] == _LETTER) & ~edge[1:n]) if n > 1 else []
    for q in quote:
        if not run_start[q]:
            continue
        rest = "".join(map(chr, chars[q + 1 : q + 3]))
        if len(rest) > 1 and edge[q + 2]:
            rest = rest[0]
        take = 1 if rest[:1] in ("s", "t", "m", "d") else 2 if rest in ("re", "ve", "ll") else 0
        if take:
            begin[q + 1] = False
            after = q + 1 + take
            if after < n and not edge[after]:
                if kind[after] == _LETTER:
                    begin[after] = True
    return np.flatnonzero(begin)


def _plain(piece: str) -> bool:
    """Latin letters, perhaps after one space."""
    word = piece[1:] if piece[0] == " " else piece
    return word.isalpha() and (word.isascii() or max(word) < "ɐ")


def _split_by_pieces(tokenizer: Tokenizer) -> bool:
    """Whether the vocabulary splits by the pattern that pieces() follows."""
    made = json.loads(tokenizer.to_str())
    split, model = made["pre_tokenizer"] or {}, made["model"]
    by_bytes = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return by_bytes and not made["normalizer"] and model["type"] == "BPE" and not model.get("dropout") and not made.get("truncation") and not made.get("padding")


class Encoder:
    """Ids of whole texts, with a bounded table of pieces met before. One for each Python worker."""

    _own: dict = {}

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = _split_by_pieces(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        if self.by_pieces:
            # a line break is a piece, and a token, of its own between a letter or sign and a space
            (self.stop,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        """Forget all pieces."""
        self.count, self.bytes = 0, 0
        self.where = np.full(1 << 16, -1, np.int32)
        self.one, self.two, self.size = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.int64)
        self.first = np.zeros(1025, np.int64)  # of each piece's ids in pool
        self.pool = np.zeros(4096, np.uint32)
        self.long: dict[bytes, int] = {}

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        kind = self.kinds[chars]
        unknown = kind == _UNKNOWN
        if unknown.any():
            self._ask(np.unique(chars[unknown]).tolist())
            kind = self.kinds[chars]
        return kind

    def _ask(self, codes: list[int]) -> None:
        """Learn the kind of code points: those that the tokenizer leaves in one piece with a letter, digit or sign."""
        for lo in range(0, len(codes), 4096):
            some = codes[lo : lo + 4096]
            self.kinds[some] = _BLANK
            for kind, before in ((_LETTER, "x"), (_NUMBER, "1"), (_OTHER, "!")):
                text = "\n".join(before + chr(c) for c in some)
                begins = np.zeros(len(text) + 1, bool)
                begins[[a for _, (a, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]] = True
                joined = np.flatnonzero(~begins[1 : 3 * len(some) : 3])
                self.kinds[np.array(some)[joined]] = kind

    def _find(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each short piece by its bytes; -1 if unknown."""
        out = np.full(len(one), -1, np.int32)
        left = np.arange(len(one))
        slot = self._slot(one, two, size)
        while len(left):
            at = self.where[slot]
            hit = (at >= 0) & (self.one[at] == one) & (self.two[at] == two) & (self.size[at] == size)
            out[left[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at >= 0))
            left, one, two, size, slot = left[more], one[more], two[more], size[more], (slot[more] + 1) & (len(self.where) - 1)
        return out

    def _slot(self, one, two, size) -> np.ndarray:
        return (mix(one ^ mix(two + size.astype(np.uint64))) & np.uint64(len(self.where) - 1)).astype(np.int64)

    def _insert(self, number: np.ndarray) -> None:
        """Put pieces that are in no slot into slots."""
        slot = self._slot(self.one[number], self.two[number], self.size[number])
        while len(number):
            free = np.flatnonzero(self.where[slot] < 0)
            _, index = np.unique(slot[free], return_index=True)
            chosen = free[index]
            self.where[slot[chosen]] = number[chosen]
            left = np.ones(len(number), bool)
            left[chosen] = False
            number, slot = number[left], (slot[left] + 1) & (len(self.where) - 1)

    def _add(self, found: list[bytes]) -> None:
        """Encode pieces that are not in the table, all different, and put them there."""
        order, ids, counts = self._encode_pieces([x.decode("utf-8") for x in found])
        n, end = self.count + len(found), int(self.first[self.count])
        if n > len(self.one):
            more = max(n, 2 * len(self.one))
            self.one, self.two, self.size, self.first = (np.resize(x, more + k) for x, k in ((self.one, 0), (self.two, 0), (self.size, 0), (self.first, 1)))
        if end + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(end + len(ids), 2 * len(self.pool)))
        self.pool[end : end + len(ids)] = ids
        self.first[self.count + 1 : n + 1] = end + np.cumsum(counts)
        own = [found[i] for i in order.tolist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        begin = np.cumsum(size) - size
        chunks = Chunks(np.frombuffer(b"".join(own) + bytes(8), np.uint8), None)
        number = np.arange(self.count, n)
        self.one[number], self.two[number], self.size[number] = chunks.at(begin, size), chunks.at(begin + 8 * (size > 8), np.maximum(size - 8, 0)), size
        for i in np.flatnonzero(size > SHORT).tolist():
            self.long[own[i]] = self.count + i
            self.bytes += len(own[i]) + 100
        self.count = n
        short = number[size <= SHORT]
        if 2 * n > len(self.where):
            self.where = np.full(1 << (3 * n).bit_length(), -1, np.int32)
            short = np.flatnonzero(self.size[:n] <= SHORT)
        self._insert(short)

    def _encode_pieces(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order in which pieces were encoded, their ids after each other, and how many each has. Pieces of plain
        letters are put in one text, parted by line breaks."""
        order, ids, counts = [], [], []
        plain, rest = [], []
        for i, x in enumerate(found):
            (plain if _plain(x) else rest).append(i)
        for lo in range(0, len(plain), 4000):
            group = plain[lo : lo + 4000]
            made = np.array(self.tokenizer.encode_batch_fast(["\n".join([found[i] for i in group])], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(made == self.stop)
            if len(cuts) == len(group) - 1:
                order += group
                ids.append(np.delete(made, cuts))
                counts.append(np.diff(np.r_[-1, cuts, len(made)]) - 1)
            else:
                rest += group
        if rest:
            made = [e.ids for e in self.tokenizer.encode_batch_fast([found[i] for i in rest], add_special_tokens=False)]
            order += rest
            ids.append(np.array([y for x in made for y in x], np.uint32))
            counts.append(np.array([len(x) for x in made]))
        return np.array(order), np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first (one entry more)."""
        all_ids, counts = [], []
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            alone = self._for_library(texts[lo])
            while not alone and hi < len(texts) and size + len(texts[hi]) <= SLICE_CHARS and not self._for_library(texts[hi]):
                size += len(texts[hi])
                hi += 1
            ids, n = self._by_library(texts[lo]) if alone else self._encode(texts[lo:hi])
            all_ids.append(ids)
            counts.append(n)
            lo = hi
        ids = np.concatenate(all_ids) if all_ids else np.zeros(0, np.uint32)
        return ids, np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64) if counts else np.zeros(1, np.int64)

    def _for_library(self, text: str) -> bool:
        return not self.by_pieces or any(a in text for a in self.added)

    def _by_library(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.array([len(ids)], np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.count > MOST_PIECES or self.bytes > MOST_BYTES:
            self.clear()
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.r_[0, np.cumsum(lengths)]
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = pieces(chars, self._kinds(chars), starts[:-1][lengths > 0])
        of_text = np.searchsorted(begin, starts)
        raw = joined.encode("utf-8")
        if len(raw) > len(chars):  # from code points to bytes
            wide = np.ones(len(chars) + 1, np.int64)
            for limit in (0x80, 0x800, 0x10000):
                wide[1:] += chars >= limit
            wide[0] = 0
            begin = np.cumsum(wide)[begin]
        size = np.diff(np.r_[begin, len(raw)])
        chunks = Chunks(np.frombuffer(raw, np.uint8), None)
        one, two = chunks.at(begin, size), chunks.at(begin + 8 * (size > 8), np.maximum(size - 8, 0))
        found = self._find(one, two, size)
        far = np.flatnonzero(size > SHORT).tolist()
        found[far] = [self.long.get(raw[begin[i] : begin[i] + size[i]], -1) for i in far]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            names = [raw[b : b + n] for b, n in zip(begin[missing].tolist(), size[missing].tolist())]
            new = {x: i for i, x in enumerate(dict.fromkeys(names))}
            self._add(list(new))
            short = size[missing] <= SHORT
            found[missing[short]] = self._find(one[missing[short]], two[missing[short]], size[missing[short]])
            found[missing[~short]] = [self.long[names[i]] for i in np.flatnonzero(~short).tolist()]
        first = self.first[found]
        count = self.first[found + 1] - first
        total = np.r_[0, np.cumsum(count)]
        ids = self.pool[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        return ids, np.diff(total[of_text])


KEPT["bpe"] = Encoder._own.clear
