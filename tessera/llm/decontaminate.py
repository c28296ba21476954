"""Benchmark decontamination, in DataFrame and SQL functions only.

Texts are words (lower-cased runs of letters and digits) and their shingles of five words; an item of n shingles is
compared with the windows of n shingles of each document (all of a shorter document). A window is contaminated if its
weighted Jaccard similarity with the item, each shingle weighing as often as it occurs, is 0.8 or more.

1. Anchors. A window that similar misses a fifth of the item's shingles at most, so it holds one of any fifth and one
   more. Those anchors of all items are broadcast in blocks of BLOCK_ANCHORS; every document is read whole, and only
   where one of its shingles is an anchor are windows made: all those of the anchor's item size that contain it.
2. SimHash. Each window's fingerprint is the majority, bit by bit, of its shingles' 64-bit hashes.
3. Multi-index Hamming join. Fingerprints are cut into six blocks of 10 or 11 bits. Two within RADIUS differ in at most
   NEAR bits of one block at least, so the index holds each item's blocks with all changes of so few bits, and joining
   on block and value finds every item within the radius; only the first block that is near reports a pair. A window
   probes six times and meets one in four unrelated items of its size. At a similarity of 0.8 bits differ with a
   probability of 0.15: 10 of 64, and more than 17 in one of 200 windows; above 0.8 there are fewer.
4. The survivors' similarity is computed exactly from their shingles.

Nothing but matches is shuffled. Defined cases: null, empty or wordless texts match nothing and are no items. An item
of fewer than five words is one shingle of them all, found wherever these words follow each other. Rows that repeat a
doc_id, or items that repeat an item_id, are reported once for each pair of ids, with the highest similarity and, of
equal ones, the smallest start; a null id is reported as null. Empty tables give no rows. Other columns are ignored by
matches() and pass through clean() unchanged; a document without doc_id always stays. Texts are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep_or_drop, materialize

WORDS = 5
SIMILARITY = 0.8
#: Bits of each block of a fingerprint, the radius within which every pair is found, and the bits of a block that may differ.
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 17
NEAR = RADIUS // len(BLOCKS)
#: Anchors that are broadcast at once (24 bytes each), and the size of the item index that is (both by blocks of items).
BLOCK_ANCHORS = 500_000
SEPARATORS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
#: The most shingles for which a fingerprint's counts fit lanes of 8 bits; above, lanes have 16.
NARROW = 63

MATCHES = "doc_id long, item_id long, similarity double, word_start long"


def words(text: str = "text"):
    """Lower-cased words of a text; none if it is null."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")


def _shingle_hashes(of: str, width: int) -> str:
    """SQL: hashes of all runs of width words of an array; empty if there are fewer."""
    parts = ", ".join(f"{of}[i + {k}]" for k in range(width))
    return f"IF(size({of}) < {width}, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, greatest(0, size({of}) - {width})), i -> xxhash64({parts})))"


def fingerprint(shingles: str, lanes: int) -> str:
    """SQL: 64-bit SimHash of an array of hashes. Each of the sums holds every lanes-th bit's count in a lane of its own."""
    per = 64 // lanes
    ones = sum(1 << (lanes * i) for i in range(per))
    sums = f"aggregate({shingles}, array_repeat(0L, {lanes}), (a, h) -> transform(a, (x, g) -> x + (shiftrightunsigned(h, g) & {ones}L)))"
    # a count above half of the shingles reaches the lane's last but one bit
    top = lanes - 2
    add = f"({1 << top}L - (size({shingles}) div 2 + 1)) * {ones}L"
    bits = f"transform({sums}, (x, g) -> shiftleft(shiftrightunsigned(x + {add}, {top}) & {ones}L, g))"
    return f"aggregate({bits}, 0L, (a, x) -> a | x)"


def _block(of: str, j: int) -> str:
    """SQL: block j of a fingerprint."""
    return f"(shiftrightunsigned({of}, {sum(BLOCKS[:j])}) & {(1 << BLOCKS[j]) - 1}L)"


def _changes(width: int) -> str:
    """SQL: all numbers of width bits of which NEAR are set at most."""
    return f"array({', '.join(f'{x}L' for x in range(1 << width) if x.bit_count() <= NEAR)})"


def _blocks(of: str, changed: bool) -> str:
    """SQL: (block, value) of all blocks of a fingerprint; changed adds the values that are near."""
    one = lambda j, value: f"named_struct('block', {j}, 'value', {value})"
    if not changed:
        return f"array({', '.join(one(j, _block(of, j)) for j in range(len(BLOCKS)))})"
    return f"concat({', '.join(f'transform({_changes(w)}, c -> {one(j, f"{_block(of, j)} ^ c")})' for j, w in enumerate(BLOCKS))})"


def similarity(a: str, b: str) -> str:
    """SQL: weighted Jaccard similarity of two arrays of hashes, each weighing as often as it occurs."""
    plain = f"size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b})"
    counted = f"aggregate(array_intersect({a}, {b}), 0, (t, s) -> t + least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))"
    shared = f"IF({plain}, size(array_intersect({a}, {b})), {counted})"
    return f"transform(array({shared}), t -> t / CAST(size({a}) + size({b}) - t AS DOUBLE))[0]"


def items(benchmark: DataFrame) -> DataFrame:
    """(item_no, item_id, width, shingles): the items that have words, each once."""
    found = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words().alias("w")).where("size(w) > 0")
    cases = "CASE " + " ".join(f"WHEN size(w) = {k} THEN {_shingle_hashes('w', k)}" for k in range(1, WORDS)) + f" ELSE {_shingle_hashes('w', WORDS)} END"
    return found.select("item_id", F.least(F.size("w"), F.lit(WORDS)).alias("width"), F.expr(cases).alias("shingles")).distinct().withColumn("item_no", F.monotonically_increasing_id())


def _scan(docs: DataFrame, chosen: DataFrame, width: int, lanes: int) -> DataFrame:
    """Matches of the chosen items of one shingle width, which are few enough to broadcast."""
    chosen = chosen.withColumn("n", F.size("shingles"))
    anchors = chosen.select("n", F.explode(F.expr(f"slice(array_sort(shingles), 1, CAST(floor({1 - SIMILARITY:.4f} * n + 1e-9) AS INT) + 1)")).alias("anchor")).distinct()
    index = chosen.select("item_no", "n", F.expr(fingerprint("shingles", lanes)).alias("item_print"))
    index = index.select("item_no", "n", "item_print", F.explode(F.expr(_blocks("item_print", True))).alias("b")).select("item_no", "n", "item_print", "b.block", "b.value")
    # every shingle of every document, from its words side by side; the words themselves go along by reference
    sides = ", ".join("w" if k == 0 else f"slice(w, {k + 1}, greatest(size(w), 1))" for k in range(width))
    names = [f"`{k}`" for k in range(width)]
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("w")).where(F.size("w") >= width)
    every = every.select("doc_id", "w", F.expr(f"posexplode(arrays_zip({sides}))").alias("at", "s"))
    last = F.col("s").getField(str(width - 1) if width > 1 else "w")
    fields = [F.col("s").getField("w" if k == 0 else str(k)) for k in range(width)]
    hits = every.where(last.isNotNull()).withColumn("anchor", F.xxhash64(*fields)).join(F.broadcast(anchors), "anchor")
    # the shingles around an anchor, as far as windows of n that contain it reach
    region = hits.select("doc_id", "n", F.expr("greatest(0, at - n + 1)").alias("origin"), F.expr(f"slice(w, greatest(0, at - n + 1) + 1, least(at, n - 1) + n + {width - 1})").alias("near"))
    region = region.select("doc_id", "n", "origin", F.expr(_shingle_hashes("near", width)).alias("near"))
    windows = region.select("doc_id", "n", "origin", F.expr("posexplode(transform(sequence(0, greatest(0, size(near) - n)), i -> slice(near, i + 1, n)))").alias("shift", "window"))
    windows = windows.withColumn("print", F.expr(fingerprint("window", lanes)))
    probes = windows.select("*", F.explode(F.expr(_blocks("print", False))).alias("b")).select("doc_id", "n", "origin", "shift", "window", "print", "b.block", "b.value")
    close = probes.join(F.broadcast(index), ["n", "block", "value"]).withColumn("differ", F.expr("print ^ item_print"))
    first = " AND ".join(f"(block <= {j} OR bit_count({_block('differ', j)}) > {NEAR})" for j in range(len(BLOCKS) - 1))
    close = close.where((F.bit_count("differ") <= RADIUS) & F.expr(first)).drop("n")
    close = close.join(F.broadcast(chosen.select("item_no", "item_id", "shingles")), "item_no")
    close = close.withColumn("similarity", F.expr(similarity("window", "shingles"))).where(F.col("similarity") >= SIMILARITY - 1e-9)
    return close.select("doc_id", "item_id", "similarity", (F.col("origin") + F.col("shift")).cast("long").alias("word_start"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, word_start (of the best window): one row for each pair that matches."""
    known = materialize(items(benchmark), "items")
    sizes = known.groupBy("width").agg(F.max(F.size("shingles")).alias("most"), F.sum(F.size("shingles")).alias("total")).collect()
    found = []
    for r in sorted(sizes, key=lambda r: r.width):
        blocks = -(-r.total // BLOCK_ANCHORS)
        for b in range(blocks):
            chosen = known.where((F.col("width") == r.width) & (F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == b)).select("item_no", "item_id", "shingles")
            found.append(_scan(docs, chosen, r.width, 8 if r.most <= NARROW else 16))
    if not found:
        return docs.sparkSession.createDataFrame([], MATCHES)
    every = reduce(DataFrame.unionByName, found)
    best = F.max(F.struct("similarity", (-F.col("word_start")).alias("back"))).alias("best")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("word_start"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of any item."""
    return keep_or_drop(docs, materialize(matches(docs, benchmark).select("doc_id").distinct(), "contaminated"), "left_anti")
