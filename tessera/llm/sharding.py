"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: offset, offset + skip, offset + 2
skip, and so on, from two hashes of its name. The shards take turns, each claiming the first slot of its order that is
still free, until the table is full. So shards own equally many slots (give or take one), and adding or removing a
shard moves few others. A row's key is hashed to a slot; the table, whose size is a parameter, is broadcast, so
placing a row takes one look-up and no shuffle.

Defined cases: a null key is placed as the empty string; equal keys share a shard. An empty table gives no rows. Extra
columns pass through assign() unchanged; columns named slot or shard are replaced. Shard names have to be distinct and
no more than there are slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots; a prime well above 100 times the number of shards keeps shares within a percent.
SLOTS = 4099
SHARDS = 16


def _number(text: str) -> int:
    """The first 15 hexadecimal digits of the MD5 hash."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in the list) that owns each slot."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= slots:
        raise ValueError("shard names have to be distinct, at least one, and no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots has to be prime")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while table[at[shard]] >= 0:
            at[shard] = (at[shard] + skip[shard]) % slots
        table[at[shard]] = shard
    return table


def slot_of(key: str, slots: int = SLOTS):
    """The slot of a key: the first 15 hexadecimal digits of the MD5 hash of its text, modulo the slots."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def assign(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot (long) and shard (int: its place in the list)."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard int")
    return df.drop("slot", "shard").withColumn("slot", slot_of(key, slots)).join(F.broadcast(table), "slot").select(*(c for c in df.columns if c not in ("slot", "shard")), "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files: int = 1, slots: int = SLOTS) -> None:
    """Write df as Parquet in a folder for each shard, of about `files` files each: rows are dealt by their own hash, so that
    neither a frequent key's shard nor a large one falls to a single task."""
    placed = assign(df, key, shards, slots)
    deal = F.pmod(F.xxhash64(*placed.columns), F.lit(files))
    placed.repartition(len(shards) * files, "shard", deal).write.partitionBy("shard").parquet(path)


#: The same table by SQL: shards take turns, the state being which slots are taken.
ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5('offset:shard-' || i), 1, 15))::BIGINT % {SLOTS} AS o,
            ('0x' || substr(md5('skip:shard-' || i), 1, 15))::BIGINT % ({SLOTS} - 1) + 1 AS k
  FROM range({SHARDS}) r(i)
), orders AS (
  SELECT i, list_transform(range({SLOTS}), lambda j: (o + j * k) % {SLOTS}) AS preferred FROM shards
), turns(turn, slot, taken) AS (
  SELECT 0::BIGINT, preferred[1], list_transform(range({SLOTS}), lambda s: s = preferred[1]) FROM orders WHERE i = 0
  UNION ALL
  SELECT turn, slot, list_transform(range({SLOTS}), lambda s: taken[s + 1] OR s = slot)
  FROM (
    SELECT t.turn + 1 AS turn, t.taken, list_filter(preferred, lambda s: NOT t.taken[s + 1])[1] AS slot
    FROM turns t JOIN orders ON i = (t.turn + 1) % {SHARDS}
    WHERE t.turn + 1 < {SLOTS}
  )
)
SELECT doc_id, turns.slot, (turn % {SHARDS})::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN turns ON turns.slot = d.slot
"""
