"""Append-only versions with time travel.

A versioned relation has key columns, a version order (`at` columns, the last of which breaks ties) and is_assert. A
key's row is live if its newest version is an assertion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = ("ts",)


def _newest(versions: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    # an aggregate, not a window: versions of a frequent key are reduced before they shuffle
    row = F.struct(*versions.columns)
    order = F.struct(*at) if len(at) > 1 else F.col(at[0])
    return versions.groupBy(*keys).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def live(versions: DataFrame, keys: Sequence[str], at: Sequence[str] = AT) -> DataFrame:
    """Rows as of now: the newest version of each key, unless it is a retraction."""
    return _newest(versions, keys, at).where("is_assert").drop("is_assert")


def as_of(versions: DataFrame, keys: Sequence[str], moment: Column, at: Sequence[str] = AT) -> DataFrame:
    """Rows as of a moment."""
    return live(versions.where(F.col(at[0]) <= moment), keys, at)


def history(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Versions and assertions of each key."""
    return versions.groupBy(*keys).agg(F.count("*").alias("versions"), F.count_if(F.col("is_assert")).alias("asserts"))


def assert_rows(versions: DataFrame, rows: DataFrame, moment: Column, at: str = "ts") -> DataFrame:
    """Versions with new assertions of rows behind them."""
    return versions.unionByName(rows.withColumn(at, moment).withColumn("is_assert", F.lit(True)), allowMissingColumns=True)


def retract_rows(versions: DataFrame, ids: DataFrame, keys: Sequence[str], moment: Column, at: Sequence[str] = AT) -> DataFrame:
    """Versions with retractions of those live rows whose keys are in ids."""
    gone = live(versions, keys, at).join(ids.select(*keys).distinct(), list(keys), "left_semi")
    return versions.unionByName(gone.withColumn(at[0], moment).withColumn("is_assert", F.lit(False)), allowMissingColumns=True)


def merge_fields(log: DataFrame, key: str, at: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The newest value that is not null of each field."""
    order = F.struct(*at) if len(at) > 1 else F.col(at[0])
    return log.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields))
