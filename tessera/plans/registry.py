"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, read when first asked for."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None):
    """Register f(t: Tables) under its name, with the SQL it is checked against."""

    def wrap(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return f

    return wrap
