"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Every document's ids (with an end id) are cut into full pieces of the sequence length and one remainder. A full
piece is a sequence by itself and never shuffles. Remainders are dealt at random to groups of about GROUP pieces;
each group is packed on its own: longest first, each into the first bin with room, found by descending a tree whose
nodes hold the largest room below them. No group depends on the size of the table.

Defined cases: a null or empty text has the end id alone, so every document has at least one piece. Rows that repeat
a doc_id are packed each for itself; a null doc_id stays null. Of equal lengths the earlier in (doc_id, start) goes
first. An empty table gives no rows. Texts are read whole, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mapped, materialize

SEQUENCE = 1024
#: Remainders packed together, on average.
GROUP = 8192
_MASK = (1 << 64) - 1
PACKED_BASE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, dealt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given: the first bin with room for it, else a new one."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [size] * (2 * leaves)  # of the bins at the leaves; above, the largest below
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins.append(node - leaves)
        offsets.append(size - room[node])
        room[node] -= n
        node //= 2
        while node:
            most = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def _scatter(x: int) -> int:
    """A 63-bit number that looks random."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return (x ^ (x >> 31)) >> 1


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int = SEQUENCE) -> DataFrame:
    """The pieces of every document, without their texts; see PIECES. dealt is a random number for each."""

    def run(batches):
        from pyspark import TaskContext

        from tessera.llm.bpe import Encoder

        encoder = Encoder.at(tokenizer)
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id").to_pylist()
            for lo in range(0, len(texts), 256):
                ids, first = encoder.encode(texts[lo : lo + 256])
                first = first.tolist()
                out: list[tuple] = []
                for k in range(len(first) - 1):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), size):
                        part = own[start : start + size]
                        out.append((doc_ids[lo + k], start, len(part), zlib.crc32(part.tobytes()), len(own), _scatter(task << 40 | row)))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], [*PACKED_BASE, "dealt"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def pack(pieces: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Place pieces (see PIECES) in sequences. Sequence ids are distinct, not gapless."""
    full = pieces.where(F.col("length") >= size).select(
        *PACKED_BASE, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group))

    def place(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("dealt", "ascending")])
        bins, offsets = first_fit(table.column("length").to_pylist(), size)
        ids = (key[0].as_py() << 24 | np.array(bins, np.int64)) * 2
        return table.select(PACKED_BASE).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))

    placed = rest.withColumn("__group", F.col("dealt") % groups).groupBy("__group").applyInArrow(place, PACKED)
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Tokenise, cut and pack whole documents; the pieces (no texts) are written to the shared folder once."""
    return pack(materialize(cut(docs, tokenizer, end_id, size), "pieces"), size, group)
