"""Trigram language model by deleted interpolation, counted and scored without moving texts.

Documents become segments of a bounded number of tokens, written once: a segment's distinct words, and for every token
the number of its word. Counting asks, for every distinct word, pair and triple of words of a segment, how often the
training corpus holds it: by their hashes they go to buckets, one for each BUCKET tokens of the corpus; each adds up what
all segments say about a word or run and answers each of them in the order it asked. So a frequent word sends one number
a segment, and what moves follows the distinct triples, not the tokens. A segment and bucket share one row, and none if
the segment has nothing there, so rows are never more than distinct triples. The bucket of a frequent word hears from
every segment: beyond FAN of them, groups of FAN segments are summed up first, and answered through their group.

Words are counted by their bytes. Pairs and triples are told apart by universal hashing of their words with secret
multipliers (see textvec).

P(w | g h) = l3 c(g h w) / c(g h) + l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1), the weights by the context's frequency
(buckets of powers of two): that of g h if training holds it, else that of h, where l3 is 0. They are learned by
expectation-maximisation on a tenth of the training documents, held out from the counts that they are weighed with; the
final counts take all of them. Both cover the whole corpus. For learning, tokens whose three estimates lie in the same
bins (FINE to a factor of two) are added up and stand for the means of their estimates.

Defined cases: a null or empty text has the end alone. A null doc_id counts as a training document. Rows that repeat a
doc_id are scored each for itself. A corpus without training tokens gives every token a probability of one half or
less by l0 alone. An empty table gives no rows. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as tv
from tessera.llm.common import mapped, materialize, release, swept

#: Tokens of a segment at least, unless a partition ends.
SEGMENT = 3 << 18
#: Tokens of the corpus for each bucket of hashes.
BUCKET = 1 << 20
#: Bins a factor of two, of the probabilities that weights are learned from.
FINE = 1
#: Segments that one task adds up.
FAN = 1 << 10
#: Levels of a context's frequency: of one word, and behind them of two.
LEVELS = 65
ROUNDS = 100
#: The end's word is empty, which no other is. What stands before a text has a digest of its own.
END = b""
BEGIN = np.array([[0x9E6C63D0876A9A47, 0x2545F4914F6CDD1D]], np.uint64)

#: A learning segment's number is odd.
SEGMENTS = "segment long, learning boolean, doc_ids array<long>, folds array<int>, sizes array<long>, lengths binary, words binary, tokens binary"
ASKED = "bucket long, segment long, lengths binary, keys binary, counts binary, held binary"
ANSWERED = "segment long, bucket long, counts binary, held binary, sums array<long>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), kind)


def _pack_planes(x: np.ndarray) -> bytes:
    """Numbers, all lowest bytes first, then all next ones: the highest are mostly alike."""
    return _pack(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)


def _unpack_planes(blob: bytes, kind: str) -> np.ndarray:
    planes = _unpack(blob, "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _narrow(x: np.ndarray) -> bytes:
    """Counts with the least bytes they need; the first byte tells how many."""
    kind = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or int(x.max()) < 1 << 8 * k)
    return bytes([kind]) + _pack(x.astype(f"<u{kind}"))


def _wide(blob: bytes) -> np.ndarray:
    return _unpack(blob[1:], f"<u{blob[0]}").astype(np.int64)


def _pack_keys(keys: pa.Array | np.ndarray) -> tuple[bytes, bytes]:
    """Words (as their lengths and bytes), or ascending numbers."""
    if isinstance(keys, np.ndarray):
        return b"", _pack_planes(np.diff(keys, prepend=np.uint64(0)))
    return _narrow(pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)), _pack(np.frombuffer(b"".join(keys.to_pylist()), np.uint8))


def _unpack_keys(lengths: bytes, keys: bytes) -> pa.Array | np.ndarray:
    if not lengths:
        return np.cumsum(_unpack_planes(keys, "<u8"), dtype=np.uint64)
    offsets = np.r_[0, np.cumsum(_wide(lengths))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(_unpack(keys, "u1"))])


def _merged(parts: list[pa.Array | np.ndarray]) -> tuple[np.ndarray, pa.Array | np.ndarray]:
    """The number of each key in all parts, and the different keys: numbers ascending, words in the order of their bytes."""
    if isinstance(parts[0], np.ndarray):
        keys, index = np.unique(np.concatenate(parts), return_inverse=True)
        return index, keys
    encoded = pa.concat_arrays(parts).dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[encoded.indices.to_numpy()], encoded.dictionary.take(pa.array(order))


def segments(docs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """See SEGMENTS; folds holds crc32 of the id as text modulo 10, and learning segments those where it is 1."""

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: dict[bool, list] = {False: [], True: []}
        tokens = {False: 0, True: 0}

        def flush(learning: bool):
            nonlocal number
            own, held[learning], tokens[learning], number = held[learning], [], 0, number + 1
            index, words = _merged([x[3] for x in own])  # of each slice's words
            ends = np.r_[0, np.cumsum([len(x[3]) for x in own])]
            index = np.concatenate([index[lo + x[4]] for lo, x in zip(ends, own)])
            lengths, words = _pack_keys(words)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 24 | number) << 1 | learning], pa.int64()),
                    pa.array([learning]),
                    pa.array([[i for x in own for i in x[0]]], pa.list_(pa.int64())),
                    pa.array([[i for x in own for i in x[1]]], pa.list_(pa.int32())),
                    pa.array([np.concatenate([x[2] for x in own]).tolist()], pa.list_(pa.int64())),
                    *(pa.array([x], pa.binary()) for x in (lengths, words, _pack_planes(index.astype("<u4")))),
                ],
                ["segment", "learning", "doc_ids", "folds", "sizes", "lengths", "words", "tokens"],
            )

        for batch in batches:
            doc_ids, folds = batch.column("doc_id").to_pylist(), np.array(batch.column("fold").to_pylist(), np.int64)
            for lo, hi, data, starts in tv.slices(batch.column("text")):
                begin, end, first = tv.spans(data, starts, tv.BLANKS)
                data = tv.LOWER[data]
                index, words = tv.distinct_words(data, begin, end)
                words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
                index, sizes = np.insert(index, first[1:], len(words) - 1), np.diff(first) + 1
                for learning in (False, True):  # documents that weights are learned on have segments of their own
                    mine = (folds[lo:hi] == 1) == learning
                    if mine.any():
                        at = np.flatnonzero(mine) + lo
                        held[learning].append(([doc_ids[i] for i in at.tolist()], folds[at].tolist(), sizes[mine], words, index[np.repeat(mine, sizes)]))
                        tokens[learning] += int(sizes[mine].sum())
                        if tokens[learning] >= size:
                            yield flush(learning)
        for learning in (False, True):
            if held[learning]:
                yield flush(learning)

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(2)).cast("int")
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("fold")), run, SEGMENTS)


@dataclasses.dataclass
class Key:
    """Secret multipliers, the same for all tasks of a job."""

    word: np.ndarray = dataclasses.field(default_factory=tv.word_key)
    run: np.ndarray = dataclasses.field(default_factory=lambda: tv.run_key(3))


class Segment:
    """A row of segments(), unpacked: its words, and of each token the number of its word."""

    def __init__(self, row: dict, key: "Key"):
        self.key = key
        self.id = row["segment"]
        self.words = _unpack_keys(row["lengths"], row["words"])
        self.token = _unpack_planes(row["tokens"], "<u4").astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.r_[0, np.cumsum(self.sizes)][:-1]
        folds = np.array(row["folds"], np.int64)
        self.folds = np.repeat(folds, self.sizes)  # of each token
        self.doc_ids, self.doc_folds = row["doc_ids"], folds
        self._hashes = None

    def hashes(self) -> np.ndarray:
        """128 bits of each word, and behind them the begin's."""
        if self._hashes is None:
            self._hashes = np.concatenate([tv.keyed_words(self.words, self.key.word), BEGIN])
        return self._hashes

    def grams(self, order: int) -> np.ndarray:
        """The number of each token with the order - 1 before it; a text begins behind as many begins."""
        lanes, token = np.zeros((len(self.token), 2), np.uint64), self.token
        with np.errstate(over="ignore"):
            for k in self.key.run[:order]:
                lanes += tv.word_sums(self.hashes(), k)[token]
                token = self.before(token, len(self.words))
        return tv.run_number(lanes, order, self.key.run)

    def before(self, values: np.ndarray, at_begin: int) -> np.ndarray:
        """The value of the token before each; at a text's begin at_begin."""
        out = np.r_[0, values[:-1]]
        out[self.first] = at_begin
        return out


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _ask(parts: DataFrame, buckets: int, order: int, key: Key) -> DataFrame:
    """What each segment asks of each bucket: distinct words or runs in order, with its counts in training documents, and
    in those of them that weights are learned on. Buckets are ranges of hashes."""
    cuts = np.array([((b << 64) // buckets) for b in range(1, buckets)], np.uint64)

    def run(batches):
        for row in _rows(batches):
            s = Segment(row, key)
            if order > 1:
                keys, index = np.unique(s.grams(order), return_inverse=True)
                hashes, own = keys, np.arange(len(keys))
            else:
                keys, index = s.words, s.token
                own = np.argsort(s.hashes()[:-1, 0], kind="stable")
                hashes = s.hashes()[:-1, 0][own]
            counts = np.bincount(index[s.folds > 0], minlength=len(keys))
            held = np.bincount(index[s.folds == 1], minlength=len(keys))
            at = [0, *np.searchsorted(hashes, cuts).tolist(), len(keys)]
            for lo in range(0, buckets, 64):
                some = [b for b in range(lo, min(buckets, lo + 64)) if at[b] < at[b + 1]]
                if some:
                    mine = [np.sort(own[at[b] : at[b + 1]]) for b in some]  # words keep the order of their bytes
                    packed = [_pack_keys(keys[x] if order > 1 else keys.take(pa.array(x))) for x in mine]
                    columns = [[a for a, _ in packed], [b for _, b in packed], [_narrow(counts[x]) for x in mine], [_narrow(held[x]) for x in mine]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int64()), pa.array([s.id] * len(some), pa.int64()), *(pa.array(x, pa.binary()) for x in columns)],
                        ["bucket", "segment", "lengths", "keys", "counts", "held"],
                    )

    return mapped(parts, run, ASKED)


def _add_up(table: pa.Table):
    """Rows of a bucket (or of a group of it) in the order of their segments; where each one's keys are; the keys, and
    their counts."""
    rows = table.sort_by("segment").to_pylist()
    keys = [_unpack_keys(r["lengths"], r["keys"]) for r in rows]
    index, merged = _merged(keys)
    counts, held = (np.bincount(index, np.concatenate([_wide(r[c]) for r in rows])).astype(np.int64) for c in ("counts", "held"))
    return rows, np.split(index, np.cumsum([len(k) for k in keys])[:-1]), merged, counts, held


def _answers(bucket: int, rows, own, counts: np.ndarray, held: np.ndarray, sums: list[int] | None) -> pa.Table:
    last = [] if sums is None else [None]
    return pa.table(
        {
            "segment": pa.array([*(r["segment"] for r in rows), *last], pa.int64()),
            "bucket": pa.array([bucket] * (len(rows) + len(last)), pa.int64()),
            "counts": pa.array([*(_narrow(counts[x]) for x in own), *last], pa.binary()),
            "held": pa.array([*(_narrow(held[x]) for x in own), *last], pa.binary()),
            "sums": pa.array([*(None for _ in rows), *([] if sums is None else [sums])], pa.list_(pa.int64())),
        }
    )


def _answer(asked: DataFrame, groups: int = 1) -> DataFrame:
    """Totals over all segments, in the order of each one's question; sums, on a row without segment: occurrences and
    distinct keys of the bucket, over all training documents and over the counted part. With several groups of segments,
    a bucket hears from groups, which answer their segments."""

    def whole(key, table):
        rows, own, _, counts, held = _add_up(table)
        sums = [int(y) for x in (counts, counts - held) for y in (x.sum(), (x > 0).sum())]
        return _answers(key[0].as_py(), rows, own, counts, held, sums)

    if groups <= 1:
        return asked.groupBy("bucket").applyInArrow(whole, ANSWERED)

    def part(key, table):
        _, _, merged, counts, held = _add_up(table)
        lengths, keys = _pack_keys(merged)
        return pa.table({"bucket": [key[0].as_py()], "segment": [key[1].as_py()]} | {c: pa.array([x], pa.binary()) for c, x in zip(("lengths", "keys", "counts", "held"), (lengths, keys, _narrow(counts), _narrow(held)))})

    def back(key, questions, answer):
        rows, own, *_ = _add_up(questions.drop_columns(["group"]))
        told = answer.to_pylist()[0]
        return _answers(key[0].as_py(), rows, own, _wide(told["counts"]), _wide(told["held"]), None)

    asked = materialize(asked.withColumn("group", F.pmod(F.xxhash64("segment"), F.lit(groups))), "questions")
    answered = materialize(_answer(asked.groupBy("bucket", "group").applyInArrow(part, ASKED)), "group-answers")
    replies = answered.where("segment is not null").select("bucket", F.col("segment").alias("group"), "counts", "held")
    told = asked.groupBy("bucket", "group").cogroup(replies.groupBy("bucket", "group")).applyInArrow(back, ANSWERED)
    return told.unionByName(answered.where("segment is null"))


def count(parts: DataFrame, buckets: int, order: int, key: Key, groups: int = 1) -> DataFrame:
    """Ask and answer; one row a segment and bucket."""
    with swept(parts.sparkSession):  # the questions are many times the answers
        return materialize(_answer(_ask(parts, buckets, order, key), groups), f"grams-{order}")


def _joined(parts: DataFrame, counted: list[DataFrame]) -> DataFrame:
    """Segments with all the answers they got, in the order of buckets. A segment is bounded, and so are its answers."""
    every = [x.where("segment is not null").withColumn("order", F.lit(k)) for k, x in enumerate(counted)]
    gathered = reduce(DataFrame.unionByName, every).groupBy("segment").agg(
        *(F.array_sort(F.collect_list(F.when(F.col("order") == k, F.struct("bucket", "counts", "held")))).alias(f"g{k}") for k in range(len(every)))
    )
    return parts.join(gathered, "segment")


def _gather(answers: list[dict], key: str) -> np.ndarray:
    return np.concatenate([_wide(x[key]) for x in answers]) if answers else np.zeros(0, np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for 0, then one for each power of two."""
    return np.frexp(counts.astype(np.float64))[1]


def _probabilities(s: Segment, row: dict, total: int, texts: int, learning: bool):
    """For each token (when learning: from the counts without the held part): level of its context, the three
    maximum-likelihood estimates, longest first, and its word's count."""
    counts = [_gather(row[f"g{k}"], "counts") - (_gather(row[f"g{k}"], "held") if learning else 0) for k in range(3)]
    # words were asked for bucket by bucket
    hashes = s.hashes()[:-1, 0]
    cuts = np.array([((b << 64) // row["buckets"]) for b in range(1, row["buckets"])], np.uint64)
    asked = np.lexsort((np.arange(len(hashes)), np.searchsorted(cuts, hashes, "right")))
    words = np.empty(len(hashes), np.int64)
    words[asked] = counts[0]
    seen = words[s.token]
    pair, triple = (counts[k][np.unique(s.grams(k + 1), return_inverse=True)[1]] for k in (1, 2))
    one, two = s.before(seen, texts), s.before(pair, texts)
    level = np.where(two > 0, LEVELS + _level(two), _level(one))
    return level, (triple / np.maximum(two, 1), pair / np.maximum(one, 1), seen / max(total, 1)), seen


def learn(joined: DataFrame, key: Key, tokens: int, distinct: int, texts: int) -> np.ndarray:
    """Weights (l3, l2, l1, l0) of each context level, by expectation-maximisation over a histogram of all tokens of the
    learning segments."""

    def run(batches):
        for row in _rows(batches):
            s = Segment(row, key)
            level, estimates, _ = _probabilities(s, row, tokens, texts, True)
            code = level.astype(np.int64)
            for p in estimates:  # a bin is below 2**12
                code = code << 12 | np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * FINE) + 1, 0).astype(np.int64)
            cell, index, n = np.unique(code, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n), *(pa.array(np.bincount(index, p)) for p in estimates)], ["cell", "n", "s3", "s2", "s1"])

    sums = mapped(joined, run, "cell long, n long, s3 double, s2 double, s1 double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "s3", "s2", "s1")))
    rows = sums.orderBy("cell").toPandas()  # bounded by the bins, whatever the corpus
    weights = np.tile(np.array([0.0, 0.3, 0.5, 0.2]), (2 * LEVELS, 1))
    weights[0] = (0, 0, 0.8, 0.2)
    weights[LEVELS:] = (0.3, 0.3, 0.3, 0.1)
    known = []
    for level, own in rows.groupby(rows["cell"] // (1 << 36)):
        n, w = own["n"].to_numpy(float), weights[level].copy()
        p = np.stack([*(own[c] / n for c in ("s3", "s2", "s1")), np.full(len(own), 1 / (distinct + 1))], 1)
        for _ in range(ROUNDS):
            share = p * w
            share = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) + 0.01 * (w > 0)
            w = share / share.sum()
        weights[level] = w
        known.append(level)
    for levels in (range(1, LEVELS), range(LEVELS + 1, 2 * LEVELS)):  # a level that no held token had takes the nearest one's
        near = [k for k in known if k in levels]
        for level in levels:
            if near and level not in near:
                weights[level] = weights[min(near, key=lambda k: abs(k - level))]
    return weights


def score(docs: DataFrame, size: int = SEGMENT, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """See SCORED: base_score by smoothed unigrams, score by the model, both log10 of the whole text."""
    spark = docs.sparkSession
    parts = materialize(segments(docs, size), "segments")
    held = parts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets, groups, key = max(1, -(-held // bucket)), max(1, -(-parts.count() // fan)), Key()
    counted = [count(parts, buckets, order, key, groups) for order in (1, 2, 3)]
    parts = parts.withColumn("buckets", F.lit(buckets))

    sums = counted[0].where("segment is null").agg(*(F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(4))).first()
    tokens, distinct, known, known_distinct = sums
    folds = parts.select(F.explode("folds").alias("fold"))
    texts, held_texts = folds.agg(F.coalesce(F.sum((F.col("fold") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("fold") == 1).cast("long")), F.lit(0))).first()
    odd = [x.where("segment % 2 = 1") for x in (parts, *counted)]
    weights = spark.sparkContext.broadcast(learn(_joined(odd[0], odd[1:]), key, known, known_distinct, texts - held_texts))
    release(spark)

    def run(batches):
        for row in _rows(batches):
            s = Segment(row, key)
            level, estimates, seen = _probabilities(s, row, tokens, texts, False)
            *share, l0 = (x[level] for x in weights.value.T)
            model = np.log10(sum(x * p for x, p in zip(share, estimates)) + l0 / (distinct + 1))
            base = np.log10((seen + 0.1) / (tokens + 0.1 * (distinct + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s.doc_ids, pa.int64()),
                    pa.array(s.doc_folds == 0),
                    pa.array(s.sizes),
                    pa.array(np.add.reduceat((seen > 0).astype(np.int64), s.first)),
                    pa.array([tokens] * len(s.sizes), pa.int64()),
                    pa.array(np.add.reduceat(base, s.first)),
                    pa.array(np.add.reduceat(model, s.first)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return mapped(_joined(parts, counted), run, SCORED)
