"""File events that become bursts, and indexing that can be stopped."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import shared
from tessera.streaming import streams as S

GAP = 1000


def brute(events):
    """Event by event, path by path."""
    out = []
    for path in {p for p, *_ in events}:
        own, burst = sorted((us, seq, kind, old) for p, kind, old, us, seq in events if p == path), []
        for e in [*own, None]:
            if burst and (e is None or e[0] - burst[-1][0] >= GAP * 1000):
                kind, old = burst[0][2:]
                for _, _, k, o in burst[1:]:
                    if S.KIND_RANK.get(k, 0) > S.KIND_RANK.get(kind, 0):
                        kind, old = k, o
                    elif kind == "Renamed" and old is None and o is not None:
                        old = o
                out.append((path, kind, old, burst[0][0], burst[-1][0], len(burst)))
                burst = []
            burst.append(e)
    return sorted(out, key=str)


def some_events(rng, n):
    kinds = [*S.KIND_RANK, "strange"]
    return [(f"p{rng.randrange(5)}", rng.choice(kinds), rng.choice([None, None, f"old{i}"]), 10**12 + rng.randrange(0, 60) * 300_000, i) for i in range(n)]


def told(rows):
    found = rows.select("path", "kind", "old_path", F.unix_micros("first"), F.unix_micros("last"), "events").collect()
    return sorted((tuple(r) for r in found), key=str)


def frame(spark, events):
    return spark.createDataFrame(events, "path string, kind string, old_path string, us long, seq long").select("path", "kind", "old_path", F.timestamp_micros("us").alias("ts"), "seq")


def test_bursts_of_a_batch_equal_brute_force(spark):
    events = some_events(random.Random(1), 150)
    assert told(S.coalesce_events(frame(spark, [*events, (None, "Created", None, 0, 0)]), f"{GAP} milliseconds")) == brute(events)


def test_a_stream_tells_the_same_bursts_in_any_order(spark):
    rng = random.Random(2)
    events = some_events(rng, 150)
    folder, checkpoint, out = (shared.scratch(spark, x) for x in ("events", "checkpoint", "out"))
    order = list(events)
    rng.shuffle(order)
    for i in range(0, 150, 50):
        frame(spark, order[i : i + 50]).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)

    def run():
        stream = S.debounce_stream(source, GAP, "100 seconds").writeStream.format("parquet")
        stream.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    frame(spark, [("~end", "Other", None, 2 * 10**12, 0)]).write.mode("append").parquet(folder)
    run()  # the state outlived the first query
    assert told(spark.read.schema(S.COALESCED).parquet(out).where("path != '~end'")) == brute(events)


def test_indexing_is_paused_resumed_cancelled_and_fails_without_loss(spark):
    folder, checkpoint, path = (shared.scratch(spark, x) for x in ("rows", "checkpoint", "control"))
    spark.range(40).repartition(5).write.parquet(folder)
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    control, seen, fail = S.IndexingControl(spark, path), {}, []

    def write(batch, number):
        if fail:
            raise OSError(fail.pop())
        seen.setdefault(number, []).append(sorted(r.id for r in batch.collect()))
        if number in (0, 2):
            control.tell(S.PAUSED if number == 0 else S.CANCELLED)

    run = lambda: S.index_under_control(source, write, checkpoint, control, total=40)
    assert run() == S.PAUSED and list(seen) == [0] and run() == S.PAUSED
    assert S.IndexingControl(spark, path).progress()["processed"] == len(seen[0][0])  # from elsewhere
    control.tell(S.RUNNING)
    fail.append("disk full")
    with pytest.raises(Exception, match="disk full"):
        run()
    assert control.progress()["status"] == S.FAILED and "disk full" in control.progress()["errors"][0] and list(seen) == [0]
    assert run() == S.CANCELLED and list(seen) == [0, 1, 2]
    control.tell(S.RUNNING)
    assert run() == S.COMPLETED and run() == S.COMPLETED
    assert sorted(i for batches in seen.values() for b in batches for i in b) == list(range(40))
    assert control.progress()["processed"] == 40 and control.progress()["status"] == S.COMPLETED
    with pytest.raises(ValueError):
        control.tell("Sideways")


def test_a_path_has_one_timer_however_many_events():
    class Handle:
        """State and timers of one path."""

        def __init__(self):
            self.timers, self.set, self.values = set(), 0, {}

        def _state(self, name):
            own = self.values
            state = type("State", (), {})()
            state.get = lambda: iter(own.get(name, [])) if name == "events" else own.get(name)
            state.clear = lambda: own.pop(name, None)
            state.appendValue = lambda x: own.setdefault(name, []).append(x)
            state.appendList = lambda x: own.setdefault(name, []).extend(x)
            state.put = state.update = lambda x: own.__setitem__(name, x)
            return state

        def getListState(self, name, schema):
            return self._state(name)

        getValueState = getListState

        def registerTimer(self, ms):
            self.timers.add(ms)
            self.set += 1

        deleteTimer = lambda self, ms: self.timers.discard(ms)

    handle, debouncer = Handle(), S.Debouncer(1000)
    debouncer.init(handle)
    times = [*range(0, 50_000, 100), *range(90_000, 95_000, 100), 200_000]  # ms: bursts of 500, 50 and 1
    order = random.Random(4).sample(times, len(times))
    for lot in (order[:300], order[300:]):
        frame_ = pd.DataFrame({"kind": ["Modified"] * len(lot), "old_path": [None] * len(lot), "ts": pd.to_datetime(lot, unit="ms"), "seq": lot})
        assert not list(debouncer.handleInputRows(("p",), iter([frame_]), None))
        assert len(handle.timers) == 1
    told, before = [], handle.set
    for watermark in (60_000, 100_000, 300_000):
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda self, w=watermark: w})()
        while handle.timers and min(handle.timers) <= watermark:
            handle.timers.remove(min(handle.timers))
            for rows_ in debouncer.handleExpiredTimer(("p",), now, None):
                told += rows_["events"].tolist()
    assert told == [500, 50, 1] and not handle.timers and handle.set - before == 2
