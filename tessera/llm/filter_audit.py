"""Audit of filters that are applied one after the other: what each removes in every order, from one pass over texts.

Every text gets a mask with a bit for each filter that it fails. What a table holds is then a count for each part and
mask, 2**n of them, whatever its size. The subset-zeta transform turns a part's counts into the documents that survive
every subset of filters: those whose mask lies within the complement. A step of an order goes from one subset to its
neighbour with one filter more, so what it removes is the difference of two survivors, for good and toxic documents
alike; and the Shapley sum of a filter weighs the same differences over all subsets that lack it.

The filters: A, under 200 words; B, less than half of the words are different; C, over 2 in 100 characters are A-Z; D,
one of # $ % & * |; E, a smaller doc_id has the same text, in any part and removed or not. Words are maximal runs
without space and the controls 0x09 to 0x0D.

Equal texts fail A to D alike, so E needs no row for a pair: rows are counted by text (its SHA-256), part and label, and
of a text's rows only those with its smallest doc_id pass E. A text or a part that fills a third of the table is summed
up by the tasks that read it.

Defined cases: a null text is empty, a null source is the part ''. A null doc_id fails E never and is smaller than none.
Rows that repeat doc_id and text are as many documents, of which E fails none if the doc_id is the text's smallest. A
doc_id that labels repeats is good (toxic) if any of its rows says so; one without label is neither. An empty table has
no parts and gives no rows. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
#: Space and the ASCII controls 0x09 to 0x0D.
BLANK = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def content_mask(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D, which look at a text alone."""
    # the words are split once: the array of one element stands for a variable
    measured = F.transform(F.array(F.filter(F.split(text, BLANK), lambda w: w != "")), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("different")))
    words, different = F.get(measured, F.lit(0))["words"], F.get(measured, F.lit(0))["different"]
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [words < 200, different * 100 < words * 50, capitals * 100 > F.length(text) * 2, text.rlike(r"[#$%&*|]")]
    return sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails[1:], 1)), F.when(fails[0], F.lit(1)).otherwise(F.lit(0)))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, sha, mask, good, toxic) of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", F.sha2("t", 256).alias("sha"), content_mask(F.col("t")).alias("mask"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").alias("good"), "toxic")
    known = materialize(known.groupBy("__id").agg(is_one("good"), is_one("toxic")).where("good + toxic > 0"), "audit-labels")
    # rows without an id have no label: a join would send them all to one task
    named = rows.where("doc_id is not null").join(known, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return named.unionByName(rows.where("doc_id is null"), allowMissingColumns=True).fillna(0, ["good", "toxic"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part with exactly these failures, at most 2**5 rows a part."""
    text = ["sha", "part", "mask", "good", "toxic"]
    ids = _labelled(docs, labels).groupBy(*text, "doc_id").agg(F.count("*").alias("n"))
    # copies by text, part and label; of those with an id, how many have the least one
    copies = ids.groupBy(*text).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    copies = materialize(copies, "audit-copies")
    first = materialize(copies.groupBy(F.col("sha").alias("__sha")).agg(F.min("least").alias("first")), "audit-first")
    both = copies.join(first, F.col("sha") == F.col("__sha"))
    repeats = F.col("named") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    either = F.explode(F.array(F.struct(repeats.alias("n"), F.lit(1 << FILTERS.index("E")).alias("bit")), F.struct((F.col("n") - repeats).alias("n"), F.lit(0).alias("bit")))).alias("x")
    split = both.select("part", "mask", "good", "toxic", either).where("x.n > 0")
    n = F.col("x.n")
    counted = split.groupBy("part", (F.col("mask") + F.col("x.bit")).alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))
    out = materialize(counted, "audit-masks")
    discard(copies, first)
    return out


def survivors(counts: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, exact, alive): for each part and measure an array over all masks of documents with exactly these failures,
    and one over all subsets of filters of those that none of the subset's filters removes."""
    size = 1 << filters
    own = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("m"))
    masks = F.sequence(F.lit(0), F.lit(size - 1))
    of = lambda c: F.transform(masks, lambda i: F.coalesce(F.try_element_at("m", i)[c], F.lit(0).cast("long")))
    exact = {c: of(c) for c in MEASURES}
    out = own.select("part", F.struct(*(x.alias(c) for c, x in exact.items())).alias("exact"))
    zeta = {c: F.col(f"exact.{c}") for c in MEASURES}
    out = out.withColumns({f"__{c}": x for c, x in zeta.items()})
    for bit in range(filters):  # after each round, sums over the submasks that differ in the bits so far
        step = lambda c, bit=bit: F.transform(F.col(f"__{c}"), lambda x, i: F.when(i.bitwiseAND(1 << bit) != 0, x + F.get(f"__{c}", i - (1 << bit))).otherwise(x))
        out = out.withColumns({f"__{c}": step(c) for c in MEASURES})
    alive = F.struct(*(F.reverse(f"__{c}").alias(c) for c in MEASURES))  # the complement of subset s is size - 1 - s
    return out.select("part", "exact", alive.alias("alive"))


def steps(filters: str = FILTERS) -> list[dict]:
    """Each step of each order of the filters: its filter's bit, and the subset that went before."""
    return [
        {"filter_order": "".join(order), "step": k + 1, "own": 1 << filters.index(name), "before": sum(1 << filters.index(x) for x in order[:k])}
        for order in permutations(filters)
        for k, name in enumerate(order)
    ]


def report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step; see the module. Rows follow parts and orders, not documents."""
    n = len(filters)
    every = F.from_json(F.lit(json.dumps(steps(filters))), "array<struct<filter_order string, step int, own int, before int>>")
    rows = survivors(counts, n).select("part", "exact", "alive", F.explode(every).alias("s"))
    rows = rows.select("part", "s.filter_order", "s.step", "exact", "alive", F.col("s.before").alias("before"), F.col("s.own").alias("own")).withColumn("after", F.col("before") + F.col("own"))
    at = lambda c, i: F.get(F.col(f"alive.{c}"), i)
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    # the orders in which exactly the filters of a subset come before this one
    orders = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in range(1 << n) if s.bit_count() < n}
    weigh = lambda s, own: F.lit(orders[s]) * F.when(own.bitwiseAND(F.lit(s)) == 0, at("n", F.lit(s)) - at("n", F.lit(s) + own)).otherwise(0)
    shapley = sum((weigh(s, F.col("own")) for s in list(orders)[1:]), weigh(0, F.col("own")))
    return rows.select(
        "part", "filter_order", "step",
        at("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", F.col("own")) - lost("n")).alias("redundant"),
        F.get("exact.n", F.col("own")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over all documents."""
    return report(mask_counts(docs, labels))


#: Every document walks through every order here; nothing is shared with the transform.
ORACLE = r"""
WITH labelled AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN least < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN labelled USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (
  SELECT part, fails, n, good, toxic, filter_order,
    coalesce(list_min(list_filter([instr(filter_order, x) FOR x IN string_split(fails, '') IF x <> ''], lambda i: i > 0)), 6) AS removed_at
  FROM g, o),
s AS (SELECT unnest(range(1, 6)) AS step),
x AS (
  SELECT part, filter_order, step, substr(filter_order, step::INT, 1) AS own,
    sum(CASE WHEN removed_at > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN removed_at = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN removed_at < step AND contains(fails, substr(filter_order, step::INT, 1)) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = substr(filter_order, step::INT, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN removed_at = step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN removed_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM r, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM x
"""
