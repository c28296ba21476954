"""Embedding sets: registry, validated writes, index metadata, retraction and provider calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids as I
from tessera.operators import graph, temporal

AT = ("ts",)


def register_set(sets: DataFrame, provider: str, model: str, dims: int, ts: int, dtype: str = "f32") -> DataFrame:
    """sets (a version log) with an assertion of this set; registering again changes nothing that is live."""
    row = sets.sparkSession.range(1).select(
        I.embedding_set_id(F.lit(provider), F.lit(model), F.lit(dims)).alias("id"), F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        F.lit(dims).cast("long").alias("dims"), F.lit(dtype).alias("embedding_dtype"), I.relation_name(F.lit(model), F.lit(dims)).alias("rel_name"),
    )
    return temporal.assert_rows(sets, row, F.lit(ts).cast("long"))


def active_set(chosen: DataFrame, sets: DataFrame, vectors: DataFrame) -> DataFrame:
    """(namespace, set_id): each crate's chosen set (namespace, set_id); where it is null, the smallest set that holds vectors."""
    populated = sets.join(vectors.select(F.col("set_id").alias("id")).distinct(), "id", "left_semi").agg(F.min("id").alias("__first"))
    return chosen.join(F.broadcast(populated)).select("namespace", F.coalesce("set_id", "__first").alias("set_id"))


def put_vectors(log: DataFrame, rows: DataFrame, set_id: int, dims: int, ts: int) -> tuple[DataFrame, DataFrame]:
    """The log with assertions of the valid rows(node_id, vector), and (node_id, reason) of the others."""
    bad = (
        F.when(F.col("vector").isNull() | (F.size("vector") == 0), "empty")
        .when(F.size("vector") != dims, "dimensions")
        .when(~F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), "not finite")
    )
    checked = rows.withColumn("reason", bad)
    good = checked.where("reason is null").select("node_id", F.lit(set_id).cast("long").alias("set_id"), "vector")
    return temporal.assert_rows(log, good, F.lit(ts).cast("long")), checked.where("reason is not null").select("node_id", "reason")


def retract_changed(log: DataFrame, set_id: int, changed: DataFrame, edges: DataFrame, ts: int, kinds: Sequence[str] = graph.PARENT_KINDS) -> DataFrame:
    """The log with retractions of the set's vectors of all nodes at or below changed(id) modules."""
    below = graph.reachable(edges, changed, kinds).select(F.col("id").alias("node_id"), F.lit(set_id).cast("long").alias("set_id"))
    return temporal.retract_rows(log, below, ["node_id", "set_id"], F.lit(ts).cast("long"))


def pending(nodes: DataFrame, log: DataFrame, set_id: int, kinds: Sequence[str] = graph.RETRIEVABLE) -> DataFrame:
    """Nodes of these kinds without a live vector in the set."""
    have = temporal.live(log.where(F.col("set_id") == set_id), ["node_id", "set_id"]).select(F.col("node_id").alias("id"))
    return nodes.where(F.col("node_type").isin(*kinds)).join(have, "id", "left_anti")


def status(nodes: DataFrame, log: DataFrame, set_id: int) -> DataFrame:
    """(node_type, total, embedded)."""
    have = temporal.live(log.where(F.col("set_id") == set_id), ["node_id", "set_id"]).select(F.col("node_id").alias("id"), F.lit(1).alias("__has"))
    return nodes.join(have, "id", "left").groupBy("node_type").agg(F.count("*").alias("total"), F.count("__has").alias("embedded"))


def changes_since(log: DataFrame, ts: int) -> DataFrame:
    """Versions behind a moment, with op: put or retract."""
    return log.where(F.col("ts") > ts).withColumn("op", F.when(F.col("is_assert"), "put").otherwise("retract"))


def check_response(indices: Sequence[int], vectors: Sequence[Sequence[float]], n: int, dims: int) -> list[list[float]]:
    """Vectors of a provider's answer in the order of their indices; raises if any is missing, repeated or malformed."""
    if len(vectors) != n or len(indices) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    out: list = [None] * n
    for i, v in zip(indices, vectors):
        if not 0 <= i < n or out[i] is not None:
            raise ValueError(f"index {i} is out of range or repeats")
        if len(v) != dims or not np.isfinite(v).all():
            raise ValueError(f"vector {i} has a wrong length or number")
        out[i] = list(map(float, v))
    return out


def embed(rows: DataFrame, text: Column, provider: Callable[[list[str]], tuple[Sequence[int], Sequence[Sequence[float]]]], dims: int, batch: int = 100, attempts: int = 3, wait: float = 0.5, pause: float = 0.0) -> DataFrame:
    """(id, vector, error): texts sent to a provider in batches from the executors; a batch that keeps failing gives its
    rows an error instead of a vector. Between attempts it waits, twice as long each time; pause (seconds after each
    batch) bounds the calls that a task makes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                vectors, error = [None] * len(part), None
                for attempt in range(attempts):
                    time.sleep(wait * 2 ** (attempt - 1) if attempt else 0)
                    try:
                        vectors, error = check_response(*provider(part["text"].tolist()), len(part), dims), None
                        break
                    except Exception as e:  # noqa: BLE001  (any failure of the provider is reported with the rows)
                        error = str(e)
                time.sleep(pause)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": vectors, "error": [error] * len(part)})

    source = rows.select("id", text.alias("text"))
    return source.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, error string")
