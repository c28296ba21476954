"""An index of vectors by cells: a Parquet table whose rows lie with the centroid nearest to them.

Centroids are fitted on a bounded sample, every vector is indexed. How many cells a search reads for a query is found
when the index is built: so many that sampled queries find RECALL of their NEIGHBOURS nearest in the sample. True
neighbours are nearer than those of a sample, so a search finds more. An exact search reads all cells. Cells of more
than BLOCK vectors meet their queries in blocks, so that no task holds more, however many vectors are alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.manifests import Manifest
from tessera.operators.retrieval import top_k
from tessera.shared import discard, materialize

#: Vectors that centroids are fitted on at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Centroids at most; there are as many as the square root of the vectors.
MOST_CELLS = 4096
ROUNDS = 12
#: The share of the nearest that a search is to find, of so many, for so many sampled queries.
RECALL, NEIGHBOURS, TRIALS = 0.95, 20, 200
#: Vectors of a cell that one task compares with the queries of that cell.
BLOCK = 8192


def _nearest(points: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each point, the nearest first; ties go to the smaller number."""
    out = np.empty((len(points), n), np.int64)
    for lo in range(0, len(points), 1024):
        some = points[lo : lo + 1024]
        distance = (some * some).sum(1)[:, None] - 2 * some @ centres.T + (centres * centres).sum(1)
        out[lo : lo + 1024] = np.argsort(distance, 1, kind="stable")[:, :n] if n > 1 else distance.argmin(1)[:, None]
    return out


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """k-means of a sample, from distinct points of it; centres that lose all their points stay where they are."""
    rng = np.random.default_rng(0)
    points = np.unique(sample, axis=0)
    centres = points[rng.permutation(len(points))[:cells]].copy()
    for _ in range(ROUNDS if len(centres) else 0):
        own = _nearest(sample, centres)[:, 0]
        count = np.bincount(own, minlength=len(centres))
        for d in range(sample.shape[1]):
            total = np.bincount(own, sample[:, d], len(centres))
            centres[count > 0, d] = total[count > 0] / count[count > 0]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray) -> int:
    """Cells to read for RECALL of the NEIGHBOURS nearest in the sample, on average over its first TRIALS."""
    if not len(sample):
        return 1
    trials = sample[:TRIALS]
    own, order = _nearest(sample, centres)[:, 0], _nearest(trials, centres, len(centres))
    place = np.argsort(order, 1)  # of each cell in the order of each trial
    near = _nearest(trials, sample, min(NEIGHBOURS, len(sample)))
    return int(np.quantile(np.take_along_axis(place, own[near], 1), RECALL, method="higher")) + 1


def _whole(column) -> pa.Array:
    """One array; some kinds come in chunks when they are taken from."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index of vectors(id, vector, ...) to <path>/centres, <path>/probes and <path>/cells; rows without a
    vector are left out."""
    spark = vectors.sparkSession
    rows = vectors.where("vector is not null")
    n = rows.count()
    cells = cells or min(MOST_CELLS, max(1, int(n**0.5)))
    chosen = rows.select("vector", "id").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample).toPandas()
    points = np.array(chosen["vector"].tolist(), float) if n else np.zeros((0, 1))
    centres = fit_centres(points, cells)
    spark.createDataFrame([(probes_for(points, centres),)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    held = spark.sparkContext.broadcast(centres)
    columns = rows.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = _nearest(_matrix(batch.column("vector")), held.value)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], [*columns, "cell"])

    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    schema = rows.withColumn("cell", F.lit(0)).schema
    placed = materialize(rows.mapInArrow(run, schema), "placed")
    # ranges of cell and hash: vectors that are all alike lie in one cell, but not in one task
    placed.repartitionByRange("cell", F.xxhash64(F.col("id").cast("string"))).sortWithinPartitions("cell").write.parquet(f"{path}/cells")
    discard(placed)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
    """(query, id, distance, rank): the k nearest of queries(query, vector) among the vectors of the cells nearest to
    each, by squared distance; ties go to the smaller id. probes: cells read for a query, by default as many as the index
    was found to need; all if exact. where filters the vectors, by any of their columns, before the nearest are taken."""
    if not exact and probes is None:
        probes = spark.read.parquet(f"{path}/probes").first()["probes"]
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"].tolist()  # MOST_CELLS at most
    held = spark.sparkContext.broadcast(np.array(centres, float) if centres else np.zeros((0, 1)))
    index = spark.read.parquet(f"{path}/cells")
    index = index if where is None else index.where(where)
    query_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query"), (index, "id")))

    def route(batches):
        for batch in batches:
            if batch.num_rows and len(held.value):
                n = len(held.value) if exact else min(probes, len(held.value))
                near = _nearest(_matrix(batch.column("vector")), held.value, n)
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                own = [_whole(batch.column(c).take(at)) for c in ("query", "vector")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(near.reshape(-1), pa.int32())], ["query", "vector", "cell"])

    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null").mapInArrow(route, f"query {query_type}, vector array<double>, cell int")
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    mine = index.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64(F.col("id").cast("string")), "blocks").alias("block"), "id", "vector")
    theirs = asked.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "query", "vector")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names, found, distances = [], [], []
        if len(a) and len(b):
            x, ids = np.array(b["vector"].tolist(), float), np.array(b["id"].tolist())
            for name, q in zip(a["query"].tolist(), np.array(a["vector"].tolist(), float)):
                d = ((x - q) ** 2).sum(1)
                at = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                at = at[np.lexsort((ids[at], d[at]))][:k]
                names += [name] * len(at)
                found += ids[at].tolist()
                distances += d[at].tolist()
        return pd.DataFrame({"query": pd.Series(names, dtype=object), "id": pd.Series(found, dtype=object), "distance": np.array(distances, float)})

    met = theirs.groupBy("cell", "block").cogroup(mine.groupBy("cell", "block")).applyInPandas(meet, f"query {query_type}, id {id_type}, distance double")
    return top_k(met, k, ["query"], "distance", "id", descending=False)


class VectorIndexes:
    """The indexes of embedding sets, each in a folder of its own below path. Which set has which is a manifest there, so
    whoever opens the path finds them; an index that is built is not seen before it is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.manifest = Manifest(spark, path)

    def sets(self) -> dict[int, str]:
        """Folders of the sets that have an index."""
        return {int(k): v for k, v in self.manifest.read()[1].items()}

    def create(self, set_id: int, vectors: DataFrame, replace: bool = False, cells: int | None = None) -> bool:
        """Build the set's index; False if it has one and it is not to be replaced. The old one answers until the new one
        is there, and goes on if that fails. Raises Conflict if another writer was faster."""
        base, now = self.manifest.read()
        old = now.get(str(set_id))
        if old and not replace:
            return False
        folder = self.manifest.folder(f"set-{set_id}")
        try:
            build(vectors, folder, cells)
            self.manifest.commit(base, now | {str(set_id): folder})
        except BaseException:
            self.manifest.remove([folder])
            raise
        self.manifest.remove([old] if old else [])
        return True

    def registered(self, set_id: int) -> bool:
        return set_id in self.sets()

    def drop(self, set_id: int) -> bool:
        """Delete the set's index; False if it has none."""
        base, now = self.manifest.read()
        folder = now.pop(str(set_id), None)
        if folder:
            self.manifest.commit(base, now)
            self.manifest.remove([folder])
        return folder is not None

    def search(self, set_id: int, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
        found = self.sets()
        if set_id not in found:
            raise KeyError(f"set {set_id} has no vector index")
        return search(self.spark, found[set_id], queries, k, probes, exact, where)
