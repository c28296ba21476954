"""Python workers, tables and id-based filtering of the llm operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import discard, materialize, scratch, shared_dir  # noqa: F401

#: Rows handed to a Python worker at once, at most: texts are long, and workers share their executor's memory.
ARROW_ROWS = 1000
#: Ids that may be broadcast at most (8 bytes each on the wire).
BROADCAST_IDS = 2_000_000
#: Empties what a worker keeps between tasks; filled by the modules that keep something.
KEPT: dict[str, Callable[[], None]] = {}
_worker: dict = {}


def _begin(job: str) -> None:
    """A task of a job begins in this worker: what other jobs kept is let go."""
    if not _worker:
        import pyarrow as pa

        _worker["libc"] = ctypes.CDLL(None)
        pa.set_memory_pool(pa.system_memory_pool())
    if _worker.get("job") != job:
        for empty in KEPT.values():
            empty()
        _worker["job"] = job


def _end() -> None:
    """A task ends: what was freed goes back to the system, as workers stay and share their executor's memory."""
    gc.collect()
    if hasattr(_worker["libc"], "malloc_trim"):
        _worker["libc"].malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of ARROW_ROWS rows at most (and Spark's limit of bytes). The session's
    own setting is lowered if it is larger, as it is read when the plan runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= ARROW_ROWS:
        df.sparkSession.conf.set(key, str(ARROW_ROWS))
    job = f"{run.__module__}.{run.__qualname__}"

    def lean(batches):
        _begin(job)
        try:
            yield from run(batches)
        finally:
            _end()

    return df.mapInArrow(lean, schema)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffles and broadcasts that nothing refers to any more; it does so when garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def swept(spark: SparkSession):
    """What is written inside deletes its shuffle files as soon as it stands, rather than when garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep_or_drop(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or is not (left_anti) in ids(doc_id).

    The ids are broadcast only if counted to be BROADCAST_IDS at most; beyond that the join shuffles.
    Rows with a null doc_id are in no list.
    """
    ids = ids.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["__id"], how)
