"""A join that is kept up to date by batches of changes, by the bilinear delta rule.

Both inputs are bags: (key, part, weight), weight being how often a row is there; a batch is a bag of changes whose
weights are negative where rows go. What a batch changes in the inner join is dL x R_old + L_new x dR: each side's
changes meet the other side's state once, and no row that did not change is joined again with one that did not. Rows of
an outer side without a partner are padded. Whether a key has partners is a counter, the weight of all its rows on the
other side; only where a batch lets it leave or reach zero do the state's rows of that key lose or get their padded
copy, and a changed row of a key whose counter is zero brings its own.

State is a list of written tables, a table a batch, of which nothing is written again: the rule is linear in each side,
so a union of tables stands for their sum. From MOST_TABLES tables on they are merged into one. The joined bag is kept in
the same way; a change's total is the sum over what it holds of that row.

Rows of one key and part move as one row with a weight, summed up before they shuffle, so a key that holds a third of
all rows sends as many rows as it has different parts; pairs of different parts are the result itself. Joins are
sort-merge joins, whatever the size of their sides: nothing is collected or broadcast.

Defined cases: a null key equals no key. Rows with one are left out on a side that is not padded, and are padded on one
that is. Null parts are values like any other. Equal rows add up to copies. Empty tables and batches change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

#: Tables that a state consists of, at most.
MOST_TABLES = 8
#: What stands for the part of a row that is not there.
PADDED = "-"
HOWS = {"inner": (), "left": ("left",), "right": ("right",), "full": ("left", "right")}


def summed(rows: DataFrame) -> DataFrame:
    """A bag with one row for each key and part, without those of weight 0."""
    return rows.groupBy("key", "part").agg(F.sum("weight").alias("weight")).where("weight != 0")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _join(one: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """An equi-join on key without a broadcast."""
    return one.join(other.hint("merge"), "key", how)


class JoinView:
    """The join of left and right, bags of (key, part, weight) that are empty at first. how: inner, left, right or full."""

    def __init__(self, how: str = "right"):
        self.outer = HOWS[how]
        self.state: dict[str, list[DataFrame]] = {"left": [], "right": [], "joined": []}

    def apply(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Take a batch of changes; return what it changes in the join: key, left_part, right_part, weight (copies after
        less those before), total (copies after; 0 if none is left)."""
        delta = {"left": self._taken("left", left), "right": self._taken("right", right)}
        new = {side: [*self.state[side], delta[side]] for side in delta}
        parts = []
        if self.state["right"]:
            parts.append(self._pairs(delta["left"], _union(self.state["right"])))
        parts.append(self._pairs(_union(new["left"]), delta["right"]))
        counters = []
        for side, other in (("left", "right"), ("right", "left")):
            if side in self.outer:
                counters.append(self._counters(delta, other))
                parts += self._padding(side, delta[side], counters[-1])
        bag = ["key", "left_part", "right_part"]
        changes = _union(parts).groupBy(*bag).agg(F.sum("weight").alias("weight")).where("weight != 0")
        changes = materialize(changes, "join-changes")
        discard(*counters)
        before = [x.select(*bag, F.lit(0).cast("long").alias("weight"), F.col("weight").alias("total")) for x in self.state["joined"]]
        every = _union([changes.select(*bag, "weight", F.col("weight").alias("total")), *before])
        # a row of changes has a weight, those of the state have none
        told = every.groupBy(*bag).agg(F.sum("weight").alias("weight"), F.sum("total").alias("total")).where("weight != 0")
        told = materialize(told, "join-totals")
        for name, table in (*delta.items(), ("joined", changes)):
            self._keep(name, table)
        return told

    def _taken(self, side: str, rows: DataFrame) -> DataFrame:
        """A batch's changes of one side, written once."""
        rows = rows.select("key", "part", F.col("weight").cast("long").alias("weight"))
        return materialize(summed(rows if side in self.outer else rows.where("key is not null")), f"join-{side}")

    def _pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.select("key", F.col("part").alias("left_part"), F.col("weight").alias("a"))
        b = right.select("key", F.col("part").alias("right_part"), F.col("weight").alias("b"))
        return _join(a, b).select("key", "left_part", "right_part", (F.col("a") * F.col("b")).alias("weight"))

    def _counters(self, delta: dict[str, DataFrame], side: str) -> DataFrame:
        """(key, before, after): rows of a side at every key that the batch touches on either side. Keys without any are 0."""
        zero = F.lit(0).cast("long")
        touched = [x.select("key", (F.col("weight") if name == side else zero).alias("d"), zero.alias("before"), F.lit(True).alias("touched")) for name, x in delta.items()]
        stored = [x.select("key", zero.alias("d"), F.col("weight").alias("before"), F.lit(False).alias("touched")) for x in self.state[side]]
        sums = _union([*touched, *stored]).where("key is not null").groupBy("key").agg(F.sum("before").alias("before"), F.sum("d").alias("d"), F.max("touched").alias("touched"))
        return materialize(sums.where("touched").select("key", "before", (F.col("before") + F.col("d")).alias("after")), "join-counters")

    def _padding(self, side: str, delta: DataFrame, counters: DataFrame) -> list[DataFrame]:
        """Padded copies that come and go: [after = 0] x changes + ([after = 0] - [before = 0]) x state. Rows without a
        key have no partner ever."""
        empty = lambda c: F.col(c).eqNullSafe(F.lit(0)).cast("long")
        pad, own = F.lit(PADDED), F.col("part")
        parts = (own.alias("left_part"), pad.alias("right_part")) if side == "left" else (pad.alias("left_part"), own.alias("right_part"))
        columns = lambda weight: ["key", *parts, weight.alias("weight")]
        out = [
            _join(delta, counters.where("after = 0")).select(*columns(F.col("weight"))),
            delta.where("key is null").select(*columns(F.col("weight"))),
        ]
        if self.state[side]:
            crossed = counters.where((F.col("before") == 0) != (F.col("after") == 0))
            out.append(_join(_union(self.state[side]), crossed).select(*columns(F.col("weight") * (empty("after") - empty("before")))))
        return out

    def _keep(self, name: str, table: DataFrame) -> None:
        """Add a table to a state; merge its tables where there are too many."""
        tables = self.state[name]
        tables.append(table)
        if len(tables) > MOST_TABLES:
            keys = [c for c in table.columns if c != "weight"]
            merged = materialize(_union(tables).groupBy(*keys).agg(F.sum("weight").alias("weight")).where("weight != 0"), f"join-{name}")
            discard(*tables)
            self.state[name] = [merged]


# ---- the tables' own changes

LEFT, RIGHT = "d", "l"


def draw(kind: str, doc_id: Column, batch: int) -> Column:
    """c(t) of a row: the unsigned crc32 of kind:doc_id:t as text; a null id is the text null."""
    return F.crc32(F.concat(F.lit(f"{kind}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{batch}")).cast("binary"))


def histories(rows: DataFrame, kind: str, batches: int) -> DataFrame:
    """rows with states: for each batch from 0 whether the row is present, and how often it was updated. No row looks at
    another."""
    states = [(draw(kind, F.col("doc_id"), 0) % 3 != 0, F.lit(0).cast("long"))]
    out = rows.select("*", F.array(F.struct(states[0][0].alias("present"), states[0][1].alias("updates"))).alias("states"))
    for t in range(1, batches + 1):
        drawn, last = draw(kind, F.col("doc_id"), t) % 19, F.element_at("states", -1)
        now = F.struct((last["present"] != (drawn == 0)).alias("present"), (last["updates"] + (last["present"] & (drawn == 1)).cast("long")).alias("updates"))
        out = out.withColumn("states", F.concat("states", F.array(now)))
    return out


def printed(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def document_row(state: Column) -> tuple[Column, Column]:
    """Key and part of a document in a state: updates move it to another key."""
    return F.floor(F.col("doc_id") / 3).cast("long") + state["updates"], printed(F.col("lang"))


def label_row(state: Column) -> tuple[Column, Column]:
    """Key and part of a label in a state: an update turns its quality round."""
    quality = F.when(state["updates"] % 2 == 1, F.lit(1) - F.col("quality")).otherwise(F.col("quality"))
    return F.floor(F.col("doc_id") / 3).cast("long"), F.concat(printed(quality), F.lit(","), printed(F.col("toxic")))


def batch_changes(rows: DataFrame, row_of, t: int) -> DataFrame:
    """(key, part, weight): the rows that batch t adds, and those that it takes away. Rows that it leaves give none."""
    now, last = F.get("states", F.lit(t)), F.get("states", F.lit(t - 1)) if t else None
    made = lambda state, weight: F.struct(row_of(state)[0].alias("key"), row_of(state)[1].alias("part"), F.lit(weight).cast("long").alias("weight"))
    # none of the other columns changes, so a row changed if its state did
    moved = F.lit(True) if last is None else (now["present"] != last["present"]) | (now["updates"] != last["updates"])
    some = F.array_compact(F.array(*([F.when(last["present"], made(last, -1))] if t else []), F.when(now["present"], made(now, 1))))
    return rows.where(moved).select(F.explode(some).alias("x")).select("x.*")


def maintain(docs: DataFrame, labels: DataFrame, batches: int = 2, how: str = "right") -> DataFrame:
    """The join of documents and labels, kept through batches of changes: batch, join_key, doc_part, label_part, weight,
    total. Batch 0 fills the state and is not reported."""
    sides = {
        LEFT: (histories(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang"), LEFT, batches), document_row),
        RIGHT: (histories(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic"), RIGHT, batches), label_row),
    }
    view, told = JoinView(how), []
    for t in range(batches + 1):
        out = view.apply(*(batch_changes(rows, row_of, t) for rows, row_of in sides.values()))
        if t:
            told.append(out.select(F.lit(t).alias("batch"), F.col("key").alias("join_key"), F.col("left_part").alias("doc_part"), F.col("right_part").alias("label_part"), "weight", "total"))
        else:
            discard(out)
    return _union(told)


#: CRC-32 by its table, which the query makes; then both joins in full for every batch, and their difference.
ORACLE = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
times AS (SELECT unnest([0, 1, 2]) AS t),
ids AS (
  SELECT kind, id, t, kind || ':' || coalesce(id::VARCHAR, 'null') || ':' || t AS s
  FROM (SELECT DISTINCT 'd' AS kind, doc_id AS id FROM documents UNION ALL SELECT DISTINCT 'l', doc_id FROM labels), times),
drawn AS (
  SELECT kind, id, t, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(s, '')]),
    lambda a, b: xor(a // 256, tab.crc[1 + xor(a % 256, b)])), 4294967295::BIGINT) AS c FROM ids, tab),
wide AS (
  SELECT kind, id, max(c) FILTER (t = 0) % 3 <> 0 AS p0, max(c) FILTER (t = 1) % 19 AS m1, max(c) FILTER (t = 2) % 19 AS m2
  FROM drawn GROUP BY kind, id),
one AS (SELECT *, p0 <> (m1 = 0) AS p1, CASE WHEN p0 AND m1 = 1 THEN 1 ELSE 0 END AS u1 FROM wide),
two AS (SELECT *, p1 <> (m2 = 0) AS p2, u1 + CASE WHEN p1 AND m2 = 1 THEN 1 ELSE 0 END AS u2 FROM one),
h AS (
  SELECT kind, id, 0 AS t, p0 AS present, 0 AS updates FROM two
  UNION ALL SELECT kind, id, 1, p1, u1 FROM two UNION ALL SELECT kind, id, 2, p2, u2 FROM two),
l AS (SELECT t, doc_id // 3 + updates AS k, coalesce(lang, 'null') AS doc_part
      FROM documents JOIN h ON kind = 'd' AND id IS NOT DISTINCT FROM doc_id WHERE present),
r AS (SELECT t, doc_id // 3 AS k,
        coalesce((CASE WHEN updates % 2 = 1 THEN 1 - quality ELSE quality END)::VARCHAR, 'null') || ',' || coalesce(toxic::VARCHAR, 'null') AS label_part
      FROM labels JOIN h ON kind = 'l' AND id IS NOT DISTINCT FROM doc_id WHERE present),
j AS (SELECT r.t, r.k, coalesce(doc_part, '-') AS doc_part, label_part, count(*) AS n
      FROM r LEFT JOIN l ON r.t = l.t AND r.k = l.k GROUP BY ALL),
s AS (
  SELECT t AS batch, k, doc_part, label_part, n, 0 AS was FROM j WHERE t > 0
  UNION ALL SELECT t + 1, k, doc_part, label_part, 0, n FROM j WHERE t < 2)
SELECT batch::INTEGER AS batch, k::BIGINT AS join_key, doc_part, label_part, (sum(n) - sum(was))::BIGINT AS weight, sum(n)::BIGINT AS total
FROM s GROUP BY batch, k, doc_part, label_part HAVING sum(n) <> sum(was)
"""
