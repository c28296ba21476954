"""Registered queries of the retrieval engine and the SQL they are checked against."""

from __future__ import annotations

from tessera.plans import context, graphs, lifecycle, maintenance, retrieval, stored, versions  # noqa: F401  (they register themselves)
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
