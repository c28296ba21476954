"""Unified diffs of texts, and the part of them near changes."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def unified(old: str | None, new: str | None, name: str = "", context: int = 3) -> str:
    """The unified diff of two texts; empty if they are equal. None is an empty text."""
    a, b = ((x or "").splitlines() for x in (old, new))
    return "\n".join(difflib.unified_diff(a, b, f"a/{name}", f"b/{name}", n=context, lineterm=""))


def unified_diffs(changes: DataFrame, context: int = 3) -> DataFrame:
    """changes(file_path, old, new, ...) with diff, removed and added (numbers of lines)."""
    columns = changes.columns

    def run(batches):
        for batch in batches:
            made = [unified(*x, context) for x in zip(*(batch.column(c).to_pylist() for c in ("old", "new", "file_path")))]
            counts = [[sum(y[:1] == sign for y in x.split("\n")[2:]) for x in made] for sign in "-+"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], [*columns, "diff", "removed", "added"])

    schema = T.StructType([*changes.schema.fields, T.StructField("diff", T.StringType()), T.StructField("removed", T.LongType()), T.StructField("added", T.LongType())])
    return changes.mapInArrow(run, schema)
