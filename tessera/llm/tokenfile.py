"""Token files: canonical length-limited Huffman coding of token ids in independent blocks.

Code lengths come from the counts of all ids of the corpus (package-merge, at most MAX_BITS bits, or as many as a larger
vocabulary needs); canonical codes
follow from the lengths alone, so a reader needs just one length for each id. A file is a Parquet table of blocks in
ascending doc_id order. A block holds the documents of a bounded number of tokens: their ids and sizes, the coded
bits, and the bit offset of every CHECK-th token. Decoding starts at all those checkpoints at once and moves them
forward together, one table look-up a token.

Defined cases: a null or empty text has the end id alone. Documents are ordered by doc_id, null first; rows that
repeat a doc_id stand beside each other, the shorter first, equally long ones by their bytes. One document larger than BLOCK is a block of its own.
An empty table gives a file without blocks. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import mapped, materialize, scratch

MAX_BITS = 16
#: Tokens between two checkpoints.
CHECK = 128
#: Tokens of a block at least, unless a part of the file ends.
BLOCK = 1 << 18
#: Tokens that a part of the file holds, on average.
PART = 1 << 23
#: Parts at most, so that one number for each of them can be sent to the driver and back.
MOST_PARTS = 100_000

ENCODED = "doc_id long, n_tokens long, ids binary"
BLOCKS = "part int, block int, doc_ids array<long>, sizes array<long>, n_tokens long, bits binary, checkpoints binary"
READ = "doc_id long, n_tokens long, ids_crc32 long, part int, before long"


# ---- codes


def code_lengths(counts: dict[int, int], most: int | None = None) -> dict[int, int]:
    """Length of each id's code: an optimal prefix code of at most `most` bits (package-merge); by default MAX_BITS, or
    what that many ids need."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    if len(symbols) == 1:
        return {symbols[0]: 1}
    most = most or max(MAX_BITS, (len(symbols) - 1).bit_length())
    if len(symbols) > 1 << most:
        raise ValueError("more ids than codes of that length")
    weight = np.array([counts[s] for s in symbols], np.float64)
    n = len(weight)
    # a level's items are the symbols and pairs of the level below; members of a level, from the cheapest, are
    # counted back from the top: of the m cheapest items of a level, those that are pairs stand for two below
    levels, items = [], weight
    for _ in range(most):
        levels.append(items)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        items = np.sort(np.r_[weight, pairs], kind="stable")
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for level in range(most - 1, -1, -1):
        if level:
            below = levels[level - 1]
            pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
            # symbols come before pairs of equal weight
            rank = np.argsort(np.r_[weight, pairs], kind="stable")[:take]
            singles = int((rank < n).sum())
        else:
            singles = take
        lengths[:singles] += 1
        take = 2 * (take - singles)
    return {s: int(x) for s, x in zip(symbols, lengths)}


class Codebook:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, lengths: dict[int, int]):
        most = max([MAX_BITS, *lengths.values()])
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        size = (max(order) + 1) if order else 0
        self.most = most
        self.length = np.zeros(size, np.uint8)
        self.code = np.zeros(size, np.uint64)
        self.symbol_at = np.zeros(1 << most, np.uint32)  # the id that the next `most` bits begin with
        self.length_at = np.ones(1 << most, np.uint8)
        code, previous = 0, 0
        for s in order:
            code <<= lengths[s] - previous
            previous = lengths[s]
            self.length[s], self.code[s] = previous, code
            lo = code << (most - previous)
            self.symbol_at[lo : lo + (1 << (most - previous))] = s
            self.length_at[lo : lo + (1 << (most - previous))] = previous
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Coded bits, and the bit offset of every CHECK-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.uint64)
        length = self.length[ids].astype(np.int64)
        end = np.cumsum(length)
        start = end - length
        words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
        at = start >> 6
        left = 64 - (start & 63) - length  # free bits behind the code in its word; below 0: it goes on in the next
        code = self.code[ids]
        here = np.where(left >= 0, code << np.maximum(left, 0).astype(np.uint64), code >> np.maximum(-left, 0).astype(np.uint64))
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[first]] = np.add.reduceat(here, first)  # codes share no bits, so a sum is their union
        over = np.flatnonzero(left < 0)
        words[at[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], start[::CHECK].astype(np.uint64)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids; all stretches between checkpoints are read side by side."""
        if not n:
            return np.zeros(0, np.uint32)
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # 32 bits from each byte
        out = np.zeros((CHECK, len(checkpoints)), np.uint32)
        at = checkpoints.astype(np.int64)
        last = n - (len(checkpoints) - 1) * CHECK
        shift, mask = 32 - self.most, np.uint32((1 << self.most) - 1)
        for i in range(CHECK):
            if i == last:
                at = at[:-1]
                if not len(at):
                    break
            peek = (window[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[i, : len(at)] = self.symbol_at[peek]
            at = at + self.length_at[peek]
        return out.T.reshape(-1)[:n]


# ---- writing


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): whole texts as ids with the end id, two bytes each where they fit, deflated."""

    def run(batches):
        from tessera.llm.bpe import Encoder

        encoder = Encoder.at(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id")
            for lo in range(0, len(texts), 256):
                ids, first = encoder.encode(texts[lo : lo + 256])
                blobs = [_shrink(np.append(ids[a:b], np.uint32(end_id))) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids[lo : lo + 256], pa.array(np.diff(first) + 1), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, ENCODED)


def _shrink(ids: np.ndarray) -> bytes:
    import zstandard

    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([wide]) + zstandard.compress(ids.astype("<u4" if wide else "<u2").tobytes(), 1)


def _grow(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob[1:]), "<u4" if blob[0] else "<u2").astype(np.uint32)


def id_counts(encoded: DataFrame) -> dict[int, int]:
    """How often each id occurs in the whole corpus. The result is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column("ids"):
                n = np.bincount(_grow(blob.as_py()))
                if len(n) > len(total):
                    total = np.r_[total, np.zeros(len(n) - len(total), np.int64)]
                total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    rows = mapped(encoded.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(rows["id"].tolist(), rows["n"].tolist()))


def write(encoded: DataFrame, lengths: dict[int, int], path: str, part: int = PART, block: int = BLOCK) -> None:
    """Write encoded documents as a token file: <path>/codes (id, length) and <path>/blocks (see BLOCKS)."""
    spark = encoded.sparkSession
    spark.createDataFrame(sorted(lengths.items()), "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // max(part, -(-total // MOST_PARTS))))
    book = spark.sparkContext.broadcast(Codebook(lengths))

    def run(batches):
        from pyspark import TaskContext

        number, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            ids = np.concatenate([x for _, x in held])
            bits, checkpoints = book.value.encode(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int32()),
                    pa.array([count], pa.int32()),
                    pa.array([[i for i, _ in held]], pa.list_(pa.int64())),
                    pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([bits], pa.binary()),
                    pa.array([checkpoints.astype("<u8").tobytes()], pa.binary()),
                ],
                ["part", "block", "doc_ids", "sizes", "n_tokens", "bits", "checkpoints"],
            )

        for batch in batches:
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held.append((doc_id, _grow(blob.as_py())))
                size += len(held[-1][1])
                if size >= block:
                    yield flush()
                    held, size, count = [], 0, count + 1
        if held:
            yield flush()

    order = F.col("doc_id").asc_nulls_first()  # encoded is read from files, so sampling its ids for the ranges is cheap
    ordered = encoded.repartitionByRange(parts, order).sortWithinPartitions(order, "n_tokens", "ids")
    mapped(ordered.select("doc_id", "ids"), run, BLOCKS).write.parquet(f"{path}/blocks")


# ---- reading


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    return Codebook({r.id: r.length for r in spark.read.parquet(f"{path}/codes").collect()})


def decode_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from a token file: see READ; before counts the ids of earlier documents of its block. with_ids
    adds ids array<int>."""
    book = spark.sparkContext.broadcast(read_codebook(spark, path))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids = book.value.decode(value["bits"], np.frombuffer(value["checkpoints"], "<u8"), value["n_tokens"])
                sizes = np.array(value["sizes"], np.int64)
                first = np.r_[0, np.cumsum(sizes)]
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                n = len(sizes)
                out = [
                    pa.array(value["doc_ids"], pa.int64()),
                    pa.array(sizes),
                    pa.array(crcs, pa.int64()),
                    pa.array([value["part"]] * n, pa.int32()),
                    pa.array(first[:-1]),
                    pa.array([value["block"]] * n, pa.int32()),
                ]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_tokens", "ids_crc32", "part", "before", "block"] + ["ids"] * with_ids
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return mapped(blocks, run, READ + ", block int" + ", ids array<int>" * with_ids)


def block_starts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(part, block, inside): the ids of the part's documents before each block; (part, base): those before each
    part, MOST_PARTS rows at most. Both come from the blocks' sizes alone."""
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("inside"))
    rows, base = [], 0
    for r in sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        rows.append((r.part, base))
        base += r.n
    return inside, spark.createDataFrame(rows, "part int, base long")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Read a token file back: doc_id, start, n_tokens, ids_crc32."""
    inside, base = block_starts(spark, path)
    rows = decode_documents(spark, path).join(F.broadcast(base), "part").join(inside, ["part", "block"])
    start = F.col("base") + F.col("inside") + F.col("before")
    return rows.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def write_documents(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encode whole documents to a token file at path (by default in the shared folder) and return the path."""
    path = path or scratch(docs.sparkSession, "tokens")
    encoded = materialize(encode_documents(docs, tokenizer, end_id), "ids")
    write(encoded, code_lengths(id_counts(encoded)) if encoded.limit(1).count() else {}, path)
    return path
