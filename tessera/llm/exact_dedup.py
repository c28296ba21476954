"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every text to a slot of a bit array and marks the slots that more than one row reached. What moves for
that is slot numbers, one for each slot and task: never a text, hash or id. Pass 2 looks each row's slot up in the
broadcast array: a row whose slot nobody else reached is unique and passes straight through; only the rest, the
possibly repeated, shuffle by their SHA-256 and are decided exactly. A crowded array costs more shuffling, never a
wrong result. Its size follows the number of rows up to MAX_BITS, which bounds what is broadcast (2**30 bits: 128 MB).

Defined cases: a null text counts as empty, and empty texts equal each other. Of equal texts the row with the
largest doc_id stays (null is the smallest). Rows that repeat both text and doc_id are one document: decisions()
marks each of them alike, deduplicate() returns one of them. An empty table gives an empty result. Other columns,
whatever their names, pass through deduplicate() unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

MAX_BITS = 1 << 30
BITS_PER_ROW = 32
#: Bits in one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768


def text_hash(text: str = "text"):
    """SHA-256 of the whole text in lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """Bits of the filter: a power of two, at least one bitmap, at most max_bits."""
    return min(max_bits, 1 << max(BITMAP_BITS.bit_length() - 1, (rows * BITS_PER_ROW).bit_length()))


def _slot(sha, bits: int):
    """The slot of a hash."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long") % bits


def crowded_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the slots that two or more rows of hashes(sha) reached, as bitmaps. A task sends each slot once."""
    many = hashes.select(_slot(F.col("sha"), bits).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return many.groupBy(F.shiftright("slot", 15).alias("bucket")).agg(
        F.bitmap_construct_agg((F.col("slot") % BITMAP_BITS)).alias("bitmap")
    )


def _is_set(bitmap, slot):
    """Whether the slot's bit is set in its bitmap; no bitmap means no bit."""
    at = (slot % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))


def mark_suspects(hashes: DataFrame, crowded: DataFrame, bits: int) -> DataFrame:
    """hashes with suspect: whether its slot is crowded. The bitmaps are broadcast; bits bounds their size."""
    side = F.broadcast(crowded.select(F.col("bucket").alias("__b"), F.col("bitmap").alias("__m")))
    hashes = hashes.withColumn("__s", _slot(F.col("sha"), bits))
    hashes = hashes.join(side, F.shiftright("__s", 15) == F.col("__b"), "left")
    return hashes.withColumn("suspect", _is_set(F.col("__m"), F.col("__s"))).drop("__b", "__m", "__s")


def decisions(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. See the module for defined cases."""
    hashes = materialize(docs.select("doc_id", text_hash().alias("sha")), "dedup-hashes")
    bits = bits_for(hashes.count(), max_bits)
    crowded = materialize(crowded_slots(hashes, bits), "dedup-bloom")
    marked = mark_suspects(hashes, crowded, bits)
    unique = marked.where("not suspect").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = materialize(marked.where("suspect").select("doc_id", "sha"), "dedup-suspects")
    groups = suspects.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # read back from files, both sides of the join are plain shuffles, which AQE splits where a text fills a partition
    groups = materialize(groups, "dedup-groups")
    repeated = suspects.join(groups, "sha").select("doc_id", "sha", "keep_id", "group_size")
    return unique.unionByName(repeated).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group of equal texts: that with the largest doc_id.

    Possibly repeated rows are reduced by a partial aggregate before they shuffle, so a text that fills a third of
    the table sends one row per task.
    """
    columns = docs.columns
    hashes = materialize(docs.select(text_hash().alias("sha")), "dedup-hashes")
    bits = bits_for(hashes.count(), max_bits)
    crowded = materialize(crowded_slots(hashes, bits), "dedup-bloom")
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    marked = mark_suspects(docs.select(row.alias("__row"), text_hash().alias("sha")), crowded, bits)
    order = F.struct(F.col("__row.doc_id"), F.xxhash64("__row"))
    repeated = marked.where("suspect").groupBy("sha").agg(F.max_by("__row", order).alias("__row"))
    return marked.where("not suspect").select("__row").unionByName(repeated.select("__row")).select("__row.*")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
