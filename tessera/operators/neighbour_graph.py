"""The k nearest others of every vector, by refining a graph: neighbours of neighbours are likely to be neighbours.

The graph begins with the k nearest in small parts of the space: every vector goes to its nearest of a few centres drawn
from the data, in several tables, and a part of more than PART vectors is cut at random, so no task holds more. Then
rounds: a vector's neighbours and those whose neighbour it is (some of them, where they are many) are introduced to each
other, pairs that are new meet once, and each vector keeps its k best. Only links found in the last round make
introductions with others, so that work falls as the graph settles; it ends when fewer than SETTLED of all links change.
Work is in proportion to the vectors, not to their square, and all of it moves by joins on ids.

Links move as (id, other) pairs, and the vectors of those that one introduces to it, once; of what they are to each other,
only what betters a row's links goes on. How good the result is,
recall() measures against exact search for a sample of rows.

Defined cases: rows without a vector, or with one of another length than most, are left out. Rows that repeat an id keep one vector. Ties go to the smaller id. Groups
are apart: no vector of one is a neighbour in another. A group of fewer than k + 1 vectors gives all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import top_k
from tessera.shared import discard, materialize

#: Vectors of a part, at most on average, and tables of parts that the graph begins with.
PART, TABLES = 256, 3
#: Neighbours that are kept on the way, at least: with few, a graph of vectors without clusters falls apart. Of them, so
#: many nearest introduce others in each direction. Rounds at most.
KEEP, FANOUT, ROUNDS = 24, 16, 8
SETTLED = 0.002
#: Centres of a table at most: their vectors are broadcast.
MOST_CENTRES = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.values if hasattr(column, "values") else column.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _placed(rows: DataFrame, table: int) -> DataFrame:
    """rows(grp, n, id, vector) with part: its nearest centre in a table, of as many as its group's size n asks for; large
    parts are cut by a hash."""
    spark = rows.sparkSession
    total, most = rows.agg(F.count("*"), F.max("n")).first()
    parts = lambda n: F.least(F.lit(MOST_CENTRES), F.ceil(n / PART))
    wanted = int(min(MOST_CENTRES, -(-most // PART)))
    drawn = rows.select("vector", F.xxhash64("id", F.lit(table)).alias("h")).where(F.pmod("h", F.lit(1 << 30)) < -(-(4 * wanted << 30) // max(1, total)))
    centres = [r["vector"] for r in drawn.orderBy("h").limit(wanted).select("vector").collect()]  # MOST_CENTRES at most
    held = spark.sparkContext.broadcast(np.array(centres, float))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, c, m = _matrix(batch.column("vector")), held.value, batch.column("m").to_numpy(zero_copy_only=False)
                far = np.where(np.arange(len(c)) < m[:, None], (c * c).sum(1) - 2 * x @ c.T, np.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(1), pa.int64())], [*batch.schema.names, "part"])

    rows = rows.select("grp", "id", "vector", parts(F.col("n")).cast("int").alias("m"))
    out = materialize(rows.mapInArrow(run, rows.withColumn("part", F.lit(0).cast("long")).schema), "placed")
    sizes = materialize(out.groupBy("grp", "part").agg(F.ceil(F.count("*") / PART).alias("cuts")), "part-sizes")
    cut = F.pmod(F.xxhash64("id", F.lit(table + 100)), "cuts").alias("cut")
    # groupings are not hot once they are cut: a part is at most PART vectors on average
    return out.join(sizes.select(F.col("grp").alias("g"), F.col("part").alias("p"), "cuts"), (F.col("grp").eqNullSafe(F.col("g"))) & (F.col("part") == F.col("p"))).select("grp", "part", cut, "id", "vector")


def _first_links(rows: DataFrame, k: int) -> DataFrame:
    """(id, other, distance): the k nearest within the parts of all tables."""
    id_type = rows.schema["id"].dataType.simpleString()

    def meet(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("vector").combine_chunks())
        distance = np.empty((len(x), len(x)))
        for i in range(0, len(x), 256):
            distance[i : i + 256] = ((x[i : i + 256, None, :] - x[None, :, :]) ** 2).sum(2)
        distance[ids[:, None] == ids[None, :]] = np.inf
        n = min(k, len(x))
        best = np.argpartition(distance, n - 1, axis=1)[:, :n] if n < len(x) else np.tile(np.arange(len(x)), (len(x), 1))
        at, own = np.repeat(np.arange(len(x)), best.shape[1]), best.reshape(-1)
        some = np.isfinite(distance[at, own])
        return pa.table({"id": pa.array(ids[at[some]]), "other": pa.array(ids[own[some]]), "distance": pa.array(distance[at[some], own[some]])})

    parts = [_placed(rows, i).withColumn("table", F.lit(i)) for i in range(TABLES)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("table", "grp", "part", "cut").applyInArrow(meet, f"id {id_type}, other {id_type}, distance double")


def _best(links: DataFrame, k: int) -> DataFrame:
    """The k best of each id; a link that is met twice is one, and old if any of them is."""
    once = links.groupBy("id", "other").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    return top_k(once, k, ["id"], "distance", "other", descending=False)


def _introduced(graph: DataFrame) -> DataFrame:
    """(id, other, fresh): whom each id introduces to each other, if any of their links is fresh."""
    both = graph.select("id", "other", "fresh", "distance").unionByName(graph.select(F.col("other").alias("id"), F.col("id").alias("other"), "fresh", "distance"))
    both = both.repartition("id").groupBy("id", "other").agg(F.max("fresh").alias("fresh"), F.min("distance").alias("distance"))
    # of many, the fresh ones first: those of a hub would introduce all others to each other
    w = Window.partitionBy("id", "fresh").orderBy("distance", "other")
    some = both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= FANOUT)
    # 2 * FANOUT at most of an id
    return some.withColumn("any", F.max("fresh").over(Window.partitionBy("id"))).where("any").select("id", "other", "fresh")


def _met(graph: DataFrame, rows: DataFrame, keep: int) -> DataFrame:
    """(id, other, distance): what those who were introduced are to each other, of one group and with a fresh link, where it
    is no further than the id's keep-th link so far. The vectors of those that an id introduces move to it once, not once for
    each pair of them."""
    bounds = graph.where(F.col("rank") == keep).select("id", F.col("distance").alias("bound"))
    known = rows.join(bounds, "id", "left").select(F.col("id").alias("other"), "grp", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    met = _introduced(graph).join(known, "other").repartition("id").sortWithinPartitions("id")
    id_type = rows.schema["id"].dataType.simpleString()

    def pairs(table: pa.Table) -> pa.RecordBatch:
        by, ids, fresh, bound = (table.column(c).to_numpy() for c in ("id", "other", "fresh", "bound"))
        group = table.column("grp").combine_chunks().dictionary_encode("encode").indices.to_numpy()
        x = _matrix(table.column("vector").combine_chunks())
        begin = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        size = np.diff(np.r_[begin, len(by)])
        end = np.repeat(begin + size, size)
        later = end - np.arange(len(by)) - 1  # those of the same id that follow
        a = np.repeat(np.arange(len(by)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        some = (fresh[a] | fresh[b]) & (ids[a] != ids[b]) & (group[a] == group[b])
        a, b = a[some], b[some]
        d = np.concatenate([((x[a[i : i + 8192]] - x[b[i : i + 8192]]) ** 2).sum(1) for i in range(0, max(1, len(a)), 8192)])
        one, two = d <= bound[a], d <= bound[b]
        kind = table.schema.field("other").type
        return pa.RecordBatch.from_arrays([pa.array(np.r_[ids[a[one]], ids[b[two]]], kind), pa.array(np.r_[ids[b[one]], ids[a[two]]], kind), pa.array(np.r_[d[one], d[two]])], ["id", "other", "distance"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if len(table):
                by = table.column("id").to_numpy()
                cut = len(by) - int(np.argmax(by[::-1] != by[-1])) if (by != by[-1]).any() else 0  # an id may go on in the next batch
                rest = table.slice(cut)
                if cut:
                    yield pairs(table.slice(0, cut))
        if rest is not None and len(rest):
            yield pairs(rest)

    return met.mapInArrow(run, f"id {id_type}, other {id_type}, distance double")


#: Rows of a block of a group that meets the group's other blocks, a task for each two.
EXACT_BLOCK = 2048


def _completed(graph: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, other, distance, rank): the k nearest of all in its group for each of rows(grp, n, id, vector). A pair of blocks
    gives the k best of a row that are no further than the k-th of graph."""
    id_type, bounds = rows.schema["id"].dataType.simpleString(), graph.where(F.col("rank") == k).select("id", F.col("distance").alias("bound"))
    blocks = F.ceil(F.col("n") / EXACT_BLOCK)
    dealt = rows.join(bounds, "id", "left").select("grp", "id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), F.pmod(F.xxhash64("id"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("far"))
    left = dealt.select("grp", F.col("own").alias("a"), F.col("far").alias("b"), "id", "vector", "bound")
    right = dealt.select(F.col("grp").alias("group"), F.col("far").alias("c"), F.col("own").alias("d"), F.col("id").alias("other"), F.col("vector").alias("to"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if len(x) and len(y):
            ids, others, most = x.column("id").to_numpy(), y.column("other").to_numpy(), x.column("bound").to_numpy()
            v, w = (_matrix(c.combine_chunks()) for c in (x.column("vector"), y.column("to")))
            for i in range(0, len(v), 64):
                own, bound = v[i : i + 64], most[i : i + 64]
                squares = (own * own).sum(1)[:, None] + (w * w).sum(1)
                near = squares - 2 * own @ w.T <= bound[:, None] + 1e-9 * squares  # more than rounding can take away
                r, c = np.nonzero(near & (ids[i : i + 64, None] != others))
                d = ((own[r] - w[c]) ** 2).sum(1)
                kept = d <= bound[r]
                r, c, d = r[kept], c[kept], d[kept]
                order = np.lexsort((others[c], d, r))
                r, c, d = r[order], c[order], d[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                out.append((ids[i + r[place < k]], others[c[place < k]], d[place < k]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(columns[0], x.schema.field("id").type), pa.array(columns[1], x.schema.field("id").type), pa.array(columns[2], pa.float64())], ["id", "other", "distance"])

    met = left.groupBy("grp", "a", "b").cogroup(right.groupBy("group", "c", "d")).applyInArrow(meet, f"id {id_type}, other {id_type}, distance double")
    return top_k(met, k, ["id"], "distance", "other", descending=False)


def build(vectors: DataFrame, k: int, by: str | None = None, rounds: int = ROUNDS, exact: bool = False) -> DataFrame:
    """(id, neighbour, distance, rank): about the k nearest others of every row of vectors(id, vector, ...), within its
    group of `by` if one is given, by squared distance. With exact, the graph's distances are bounds, and what a pass over all
    pairs of a group finds within them completes it: that work grows with the square of a group."""
    rows = vectors.where("vector is not null and id is not null")
    kept = "array<float>" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"  # reckoned in doubles
    rows = rows.select((F.lit(0) if by is None else F.col(by)).alias("grp"), "id", F.col("vector").cast(kept).alias("vector"))
    rows = materialize(rows.groupBy("grp", "id").agg(F.first("vector").alias("vector")), "vectors")
    length = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    if length is None:
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    rows, keep = rows.where(F.size("vector") == length["d"]), max(2 * k, KEEP)
    sizes = materialize(rows.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("n")), "group-sizes")
    sized = rows.join(sizes, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "n", "id", "vector")
    graph = materialize(_best(_first_links(sized, keep).withColumn("fresh", F.lit(True)), keep), "graph")
    total = graph.count()
    for _ in range(rounds):
        found = _met(graph, rows, keep).withColumn("fresh", F.lit(True))
        old = graph.select("id", "other", "distance", F.lit(False).alias("fresh"))
        before, graph = graph, materialize(_best(old.unionByName(found), keep), "graph")
        discard(before)
        if graph.where("fresh").count() <= SETTLED * total:
            break
    if exact:
        graph = _completed(graph.where(F.col("rank") <= k), sized, k)
    return graph.where(F.col("rank") <= k).select("id", F.col("other").alias("neighbour"), "distance", "rank")


def recall(graph: DataFrame, exact: DataFrame) -> float:
    """The share of exact(id, neighbour) that graph has."""
    found = exact.join(graph.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return found["hits"] / max(1, found["n"])
