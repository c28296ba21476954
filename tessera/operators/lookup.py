"""Queries put together by field names, and the checks of a look-up's arguments."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators.graph import RETRIEVABLE

# Kinds that a look-up may name.
NODE_KINDS = (*RETRIEVABLE, "import", "impl")


@dataclasses.dataclass(frozen=True)
class Query:
    """A selection from one relation. Fields that the relation does not have are left out and reported in warnings, so
    that a caller who asks for too much still gets the rest."""

    relation: str
    fields: tuple[str, ...] = ()
    conditions: tuple[tuple[str, object], ...] = ()
    warnings: tuple[str, ...] = ()

    def __post_init__(self):
        if self.relation not in schema.RELATIONS:
            raise ValueError(f"no relation {self.relation}")

    def _known(self, field: str) -> bool:
        return field in schema.RELATIONS[self.relation].schema.names

    def field(self, *names: str) -> "Query":
        """With these fields in the result, in the order they are named first."""
        good = tuple(n for n in dict.fromkeys(names) if self._known(n) and n not in self.fields)
        bad = tuple(f"{self.relation} has no field {n}" for n in names if not self._known(n))
        return dataclasses.replace(self, fields=self.fields + good, warnings=self.warnings + bad)

    def where(self, **equal: object) -> "Query":
        """With fields equal to values; a list of strings equals an array."""
        bad = tuple(f"{self.relation} has no field {n}" for n in equal if not self._known(n))
        return dataclasses.replace(self, conditions=self.conditions + tuple((n, v) for n, v in equal.items() if self._known(n)), warnings=self.warnings + bad)

    def run(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The distinct rows; all fields if none is named."""
        rows = tables[self.relation]
        for name, value in self.conditions:
            rows = rows.where(F.col(name) == (F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)))
        return rows.select(*(self.fields or schema.RELATIONS[self.relation].schema.names)).distinct()


def check_lookup(node_kind: str, file_path: str, module_path: list[str], name: str) -> list[str]:
    """What is wrong with the arguments of a look-up; nothing if they are good."""
    out = []
    if node_kind not in NODE_KINDS:
        out.append(f"node_kind has to be one of {', '.join(NODE_KINDS)}")
    if not file_path.endswith(".rs"):
        out.append("file_path has to name a .rs file")
    if not module_path or module_path[0] != "crate":
        out.append("module_path has to begin with crate")
    if not name.strip():
        out.append("name is missing")
    return out


def valid_lookups(requests: DataFrame) -> DataFrame:
    """requests(node_kind, file_path, module_path, name, ...) with problems: those of check_lookup, for a whole table."""
    checks: list[tuple[Column, str]] = [
        (F.col("node_kind").isin(*NODE_KINDS), f"node_kind has to be one of {', '.join(NODE_KINDS)}"),
        (F.col("file_path").endswith(".rs"), "file_path has to name a .rs file"),
        (F.get("module_path", F.lit(0)) == "crate", "module_path has to begin with crate"),
        (F.trim("name") != "", "name is missing"),
    ]
    found = F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(text)) for good, text in checks))
    return requests.withColumn("problems", F.array_compact(found))
