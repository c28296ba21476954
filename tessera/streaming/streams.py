"""Streams: change capture, debounced file events, and micro-batch indexing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from tessera.manifests import Conflict, Manifest
from tessera.operators.retrieval import postings

# Of several events of a path, the kind that counts most, by rank.
KIND_RANK = {"Removed": 5, "Renamed": 4, "Created": 3, "Modified": 2, "Other": 1}


def kind_rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in KIND_RANK.items() for x in pair)), kind)


def debounce(events: DataFrame, key: str, ts: str, kind: str, rank: Column, gap: str = "250 milliseconds", late: str | None = None) -> DataFrame:
    """(key, events, first, last, kind): events of a key that follow each other within the gap become one, of the kind
    of highest rank. Works on batches and on streams; for streams, late is the watermark's delay."""
    if late is not None:
        events = events.withWatermark(ts, late)
    grouped = events.withColumn("__rank", rank).groupBy(key, F.session_window(ts, gap).alias("__w"))
    return grouped.agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.max_by(kind, "__rank").alias("kind")).drop("__w")


# ---- file events with renames

#: Columns of file events; seq orders events of one time. Of a rename, old_path is what the file was called before; it may
#: come with a later event of the same path.
EVENTS = "path string, kind string, old_path string, ts timestamp, seq long"
#: One event for each burst of them.
COALESCED = "path string, kind string, old_path string, first timestamp, last timestamp, events long"


def coalesce_events(events: DataFrame, gap: str = "250 milliseconds") -> DataFrame:
    """COALESCED of events (see EVENTS): those of a path that follow each other in less than the gap become one, of the
    kind of highest rank (KIND_RANK; the first of equals). A rename takes the first old path that is told with it or after
    it in its burst; other kinds have that of their event. An unknown kind ranks below all. Events without a path or time
    are left out; of equal ones each counts."""
    rows = events.where("path is not null and ts is not null").withColumn("__rank", F.coalesce(kind_rank(F.col("kind")), F.lit(0)))
    in_order = Window.partitionBy("path").orderBy("ts", F.coalesce("seq", F.lit(0)))
    begins = F.coalesce((F.col("ts") >= F.lag("ts").over(in_order) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    rows = rows.withColumn("__burst", F.sum(begins).over(in_order)).withColumn("__at", F.struct("ts", F.coalesce("seq", F.lit(0)).alias("seq")))
    best = F.min(F.struct((-F.col("__rank")).alias("r"), "__at", "kind", "old_path")).over(Window.partitionBy("path", "__burst"))
    rows = rows.withColumn("__best", best)
    told = F.col("old_path").isNotNull() & (F.col("__at") >= F.col("__best.__at"))
    grouped = rows.groupBy("path", "__burst").agg(
        F.first("__best").alias("best"), F.min(F.when(told, F.struct("__at", "old_path"))).alias("told"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events")
    )
    old = F.when(F.col("best.kind") == "Renamed", F.col("told.old_path")).otherwise(F.col("best.old_path"))
    return grouped.select("path", F.col("best.kind").alias("kind"), old.alias("old_path"), "first", "last", "events")


def fold_burst(rows: Sequence[tuple]) -> tuple:
    """kind and old path of one burst's (kind, old_path) in order: coalesce_events, event by event."""
    kind, old = rows[0]
    for k, o in rows[1:]:
        if KIND_RANK.get(k, 0) > KIND_RANK.get(kind, 0):
            kind, old = k, o
        elif kind == "Renamed" and old is None and o is not None:
            old = o
    return kind, old


class Debouncer(StatefulProcessor):
    """Keeps a path's events until the watermark has passed the gap behind the last of a burst, then tells the burst. Events
    may come in any order that the watermark allows; what is told is the same as from a batch of all of them.

    A path has one timer, for the first end that a burst of it may have, and it is moved to the first end that is left when
    it expires: so a path's events are read once for each burst that ends by itself, not once for each event."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "kind array<string>, old_path array<string>, us array<long>, seq array<long>")  # a row for a batch
        self.next = handle.getValueState("next", "ms long")

    def wake(self, us: int) -> None:
        """Move the path's timer to the gap behind an event, if it has none or a later one."""
        ms, now = -(-us // 1000) + self.gap_ms, self.next.get()
        if now is None or ms < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(ms)
            self.next.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                us = (batch["ts"].to_numpy("datetime64[us]").astype("int64")).tolist()
                old = [o if isinstance(o, str) else None for o in batch["old_path"]]
                self.events.appendValue((batch["kind"].tolist(), old, us, batch["seq"].fillna(0).astype("int64").tolist()))
                self.wake(min(us))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, out, rest, ends = timerValues.getCurrentWatermarkInMs() * 1000, [], [], []
        self.next.clear()
        events = sorted(((us, seq, kind, old) for packed in self.events.get() for kind, old, us, seq in zip(*packed)), key=lambda x: x[:2])
        while events:
            n = 1
            while n < len(events) and events[n][0] - events[n - 1][0] < self.gap_ms * 1000:
                n += 1
            burst, events = events[:n], events[n:]
            if burst[-1][0] + self.gap_ms * 1000 <= until:
                out.append((key[0], *fold_burst([(kind, old) for _, _, kind, old in burst]), burst[0][0], burst[-1][0], n))
            else:
                rest += [(kind, old, us, seq) for us, seq, kind, old in burst]
                ends.append(burst[-1][0])
        if rest:
            self.events.put([tuple(map(list, zip(*rest)))])
            self.wake(ends[0])
        else:
            self.events.clear()
        if out:
            made = pd.DataFrame(out, columns=["path", "kind", "old_path", "first", "last", "events"])
            yield made.assign(first=pd.to_datetime(made["first"], unit="us"), last=pd.to_datetime(made["last"], unit="us"))

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, gap_ms: int = 250, late: str = "1 second") -> DataFrame:
    """coalesce_events of a stream: one state a path, kept with timers of event time. late: the watermark's delay. Keeps its
    state in RocksDB, which the session is told to use."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = events.where("path is not null").withWatermark("ts", late)
    return kept.groupBy("path").transformWithStateInPandas(Debouncer(gap_ms), COALESCED, "Append", "EventTime")


# ---- micro-batches


def on_change(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Call handle(batch, id) for each micro-batch of a stream of changed rows; the checkpoint remembers what was done."""
    writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="100 milliseconds")).start()


def index_stream(rows: DataFrame, tokens: Column, path: str, checkpoint: str, key: str = "doc_id"):
    """Write postings of new rows to Parquet, a micro-batch at a time, each in a folder of its number: a batch that is
    handed over again replaces itself. Stop and start again at will. Corpus statistics are computed by a batch query
    over what was written (finalize)."""

    def handle(batch: DataFrame, number: int) -> None:
        postings(batch, tokens, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return on_change(rows, handle, checkpoint)


def finalize(postings: DataFrame) -> DataFrame:
    """Documents and mean length of an index, after its stream has ended."""
    return postings.select("doc", "len").distinct().agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def windowed_counts(events: DataFrame, ts: str, by: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), by).agg(F.count("*").alias("n"))


# ---- indexing under control

RUNNING, PAUSED, CANCELLED, COMPLETED, FAILED = "Running", "Paused", "Cancelled", "Completed", "Failed"


class IndexingControl:
    """What an indexing job was told, and how far it is, in a folder that all share: whoever opens the path can pause,
    resume or cancel it and read its progress, from another session too. The folder outlives the job."""

    def __init__(self, spark: SparkSession, path: str):
        self.commands, self.states = Manifest(spark, f"{path}/commands"), Manifest(spark, f"{path}/progress")

    def tell(self, command: str) -> None:
        """Ask for Running, Paused or Cancelled. The last one counts, from the next batch on."""
        if command not in (RUNNING, PAUSED, CANCELLED):
            raise ValueError(command)
        self.commands.commit(self.commands.read()[0], {"command": command})

    def told(self) -> str:
        return self.commands.read()[1].get("command", RUNNING)

    def note(self, **facts) -> None:
        """Write progress: facts that are given replace those that were."""
        while True:  # the job and its listener write side by side
            version, now = self.states.read()
            try:
                self.states.commit(version, now | facts)
                break
            except Conflict:
                continue
        self.states.trim(16)

    def finished(self, number: int, rows: int) -> None:
        """Note a batch's rows; one that is handed over again counts once."""
        now = self.progress()
        before = now["before"] if number == now["batch"] else now["processed"]
        self.note(batch=number, before=before, processed=before + rows)

    def progress(self) -> dict:
        """status, processed (rows of finished batches), batch (the last finished one), total (if it was known), errors."""
        return {"status": None, "processed": 0, "batch": None, "before": 0, "total": None, "errors": []} | self.states.read()[1]


class ProgressListener(StreamingQueryListener):
    """Writes down what streams of a name read, as Spark tells it."""

    def __init__(self, control: IndexingControl, name: str):
        self.control, self.name = control, name
        self.ids: set[str] = set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ids.add(str(event.id))

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            rows = json.loads(event.progress.json).get("numInputRows", 0)
            self.control.note(last_batch=event.progress.batchId, last_rows=rows, rate=event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ids.discard(str(event.id))


class Stopped(Exception):
    """A batch is not begun because the job was paused or cancelled."""


def index_under_control(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, control: IndexingControl, total: int | None = None) -> str:
    """Hand a stream's micro-batches to write(batch, number) until it has no more rows, or control says otherwise at the
    begin of a batch; the status it ends with. A batch that was begun is finished, and one that was not is handed over
    by the next call with the same checkpoint: nothing is lost, and write() sees a number twice only if it failed.

    Paused and Cancelled end the call (a streaming job holds executors, an ended one none); after Paused the next call goes on where it was told to
    run again. An error of write() is noted, ends the call as Failed, and raises."""
    spark = rows.sparkSession
    told = control.told()
    if told != RUNNING:
        control.note(status=told)
        return told
    control.note(status=RUNNING, total=total)
    name = f"indexing-{abs(hash(checkpoint))}"
    listener = ProgressListener(control, name)

    def handle(batch: DataFrame, number: int) -> None:
        if control.told() != RUNNING:
            raise Stopped(control.told())
        kept = batch.persist()
        try:
            n = kept.count()
            write(kept, number)
            control.finished(number, n)
        except Exception as error:
            control.note(status=FAILED, errors=[*control.progress()["errors"], f"{type(error).__name__}: {error}"[:500]])
            raise
        finally:
            kept.unpersist()

    spark.streams.addListener(listener)
    try:
        query = rows.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        status = COMPLETED
    except Exception as error:
        if "Stopped" not in str(error):
            if control.progress()["status"] != FAILED:
                control.note(status=FAILED, errors=[*control.progress()["errors"], str(error)[:500]])
            raise
        status = control.told()
    finally:
        spark.streams.removeListener(listener)
    control.note(status=status)
    return status
