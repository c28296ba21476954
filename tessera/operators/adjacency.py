"""Edges stored twice, in buckets of their source and in buckets of their target, so that looking up either end moves no edge.

A bucketed table lies ready for a join on its bucket column: only the other side is dealt to the buckets, and a filter by
a few ids opens only the buckets that those lie in. The tables are written in the session's warehouse, under names that
end in _by_source and _by_target.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import CONTAINS, written

#: Buckets of each table.
BUCKETS = 32
#: Ids that are named in a filter at most; more are joined.
MOST_NAMED = 200


class Adjacency:
    """The stored edges (source_id, target_id, relation_kind, ...) of a name."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def save(self, edges: DataFrame) -> "Adjacency":
        """Write both tables, in place of what the name has. Within a bucket, edges lie in the order of the bucket's column."""
        edges = edges.distinct()
        for column, end in (("source_id", "source"), ("target_id", "target")):
            dealt = edges.repartition(self.buckets, column)  # one file a bucket
            dealt.write.bucketBy(self.buckets, column).sortBy(column, "relation_kind").format("parquet").mode("overwrite").saveAsTable(f"{self.name}_by_{end}")
        return self

    def drop(self) -> None:
        for end in ("source", "target"):
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}_by_{end}`")

    def by_source(self) -> DataFrame:
        return self.spark.table(f"{self.name}_by_source")

    def by_target(self) -> DataFrame:
        return self.spark.table(f"{self.name}_by_target")

    def _at(self, table: DataFrame, column: str, ids: DataFrame, named: list | None) -> DataFrame:
        """Edges whose column is one of ids(id): by a filter on buckets where the ids are named, else by a join that moves
        the ids alone."""
        if named is not None:
            return table.where(F.col(column).isin(named))
        # a hint keeps both sides sorted by bucket; the ids are dealt to as many parts as there are buckets
        return table.join(ids.select(F.col("id").alias(column)).repartition(self.buckets, column).hint("merge"), column, "left_semi")

    def _named(self, ids: DataFrame) -> list | None:
        found = [r["id"] for r in ids.select("id").where("id is not null").distinct().limit(MOST_NAMED + 1).collect()]
        return found if len(found) <= MOST_NAMED else None

    def touching(self, ids: DataFrame) -> DataFrame:
        """Edges with an end among ids(id), each once."""
        ids = ids.select("id").where("id is not null").distinct()
        named = self._named(ids)
        out, into = self._at(self.by_source(), "source_id", ids, named), self._at(self.by_target(), "target_id", ids, named)
        columns = self.by_source().columns
        return out.select(*columns).unionByName(into.select(*columns)).distinct()

    def step(self, ids: DataFrame, kinds: Sequence[str] | None = None, back: bool = False) -> DataFrame:
        """(id, next): one step from ids(id) along edges of these kinds, or against them."""
        own, other = ("target_id", "source_id") if back else ("source_id", "target_id")
        table = self.by_target() if back else self.by_source()
        if kinds is not None:
            table = table.where(F.col("relation_kind").isin(*kinds))
        return self._at(table, own, ids, self._named(ids)).select(F.col(own).alias("id"), F.col(other).alias("next"))

    def reachable(self, seeds: DataFrame, kinds: Sequence[str] | None = CONTAINS, back: bool = False) -> DataFrame:
        """(id, depth): nodes reached from seeds(id), these at depth 0. A round reads the buckets of what the last one
        found, and moves only that."""
        new = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
        found, depth = [new], 0
        while new.limit(1).count():
            depth += 1
            known = reduce(DataFrame.unionByName, found).select("id")
            came = self.step(new, kinds, back).select(F.col("next").alias("id")).where("id is not null").distinct()
            new = written(came.join(known, "id", "left_anti").withColumn("depth", F.lit(depth)))
            found.append(new)
        return reduce(DataFrame.unionByName, found)
