"""Streams with state: latest statuses, remaining times, late events, and ingest without repeats.

Results go to folders by batch id, each of which a repeated batch replaces, so a replay changes nothing. What a query
keeps between batches lies in its state store.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def to_batches(path: str):
    """A ``foreachBatch`` function that writes a batch to its own folder, replacing an earlier try of it."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that batches have written, with the number of the batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Everything that is there goes through the query, which then ends; the next run goes on from there.

    State lies in RocksDB, whose size is not bound by the executors' memory.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, STORE)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(to_batches(path)).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(key, before)


# ---------------------------------------------------------------- latest status

STATUS = "item_id long, status string, ts timestamp, event_id long"


class LatestStatus(StatefulProcessor):
    """Keeps an item's latest event and gives it out when it changes; items without events for a time are forgotten.

    An item that comes back starts anew, which costs a row but no truth: readers compare by time.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ts timestamp, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        best, old = None, self.latest.get()
        for df in rows:
            top = df.sort_values(["ts", "event_id"]).iloc[-1]
            if best is None or (top["ts"], top["event_id"]) > (best["ts"], best["event_id"]):
                best = top
        if best is None or (old is not None and (pd.Timestamp(old[0]), old[1]) >= (best["ts"], best["event_id"])):
            return
        self.latest.update((best["ts"].to_pydatetime(), int(best["event_id"])))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(best["ts"].value // 1_000_000) + self.keep_ms)
        yield pd.DataFrame({"item_id": [key[0]], "status": [best["type"]], "ts": [best["ts"]], "event_id": [best["event_id"]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, keep: str = "1 day") -> DataFrame:
    """A stream of items' new statuses, from watermarked events; state of items idle for ``keep`` of event time goes."""
    ms = int(events.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {keep})").first()[0])
    keyed = events.select("item_id", "type", "ts", "event_id").groupBy("item_id")
    return keyed.transformWithStateInPandas(LatestStatus(ms), STATUS, "Update", "EventTime")


def latest_status(changes: DataFrame) -> DataFrame:
    """The latest status of every item of a log of changes."""
    return changes.groupBy("item_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


# ---------------------------------------------------------------- remaining time

#: Stages and the type of event that completes one of a stage's items.
STAGES = {"resolver": "resolver", "analyzer": "analyzer", "enhancer": "enhancer", "license": "license"}


def backlog(stats: DataFrame) -> DataFrame:
    """(stage, waiting, in_flight) of the four stages, from one row of catalogue statistics."""
    of = {
        "resolver": ("albums_pending", "albums_resolving"), "analyzer": ("tracks_pending", "tracks_processing"),
        "enhancer": ("untagged", None), "license": ("unlicensed", None),
    }
    zero = F.lit(0).cast("long")
    rows = [F.struct(F.lit(s).alias("stage"), F.col(w).alias("waiting"), (F.col(f) if f else zero).alias("in_flight")) for s, (w, f) in of.items()]
    return stats.select(F.explode(F.array(*rows)).alias("b")).select("b.*")


def remaining_time(events: DataFrame, stages: DataFrame) -> DataFrame:
    """Per sliding five minutes and stage: done, unknown or running, and the whole seconds that are left at its rate.

    A stage's rate is its completions a second since the first of them in the window, one second at least. ``events`` may
    be a stream, ``stages`` is a table of a row a stage; a window is told once any event falls into it.
    """
    counts = []
    for stage, kind in STAGES.items():
        mine = F.col("type") == kind
        counts += [F.count_if(mine).alias(f"{stage}_n"), F.min(F.when(mine, F.col("ts"))).alias(f"{stage}_first")]
    g = events.groupBy(F.window("ts", "5 minutes", "1 minute")).agg(*counts)
    each = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"{s}_n").alias("n"), F.col(f"{s}_first").alias("first")) for s in STAGES))
    rows = g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), F.explode(each).alias("e"))
    rows = rows.select("window_start", "window_end", "e.*").join(F.broadcast(stages), "stage")  # four rows
    passed = F.greatest(F.lit(1.0), F.unix_micros("window_end") / 1e6 - F.unix_micros("first") / 1e6)
    rate: Column = F.when(F.col("n") > 0, F.col("n") / passed).otherwise(0.0)
    running = (rate > 0) & (F.col("waiting") > 0)
    state = F.when(running, "running").when((F.col("waiting") == 0) & (F.col("in_flight") == 0), "done").otherwise("unknown")
    seconds = F.when(running, F.floor((F.col("waiting") + F.col("in_flight")) / rate))
    return rows.select("window_start", "stage", state.alias("state"), seconds.alias("seconds"))


# ---------------------------------------------------------------- late events


class Dropped(StreamingQueryListener):
    """Counts the rows that a stream's watermark drops, from the progress that the stream tells of."""

    def __init__(self):
        self.rows, self.input, self.ended = 0, 0, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.input += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def deny_late(events: DataFrame) -> DataFrame:
    """Watermarked events without those behind the watermark; of events with one id and time the first."""
    return events.dropDuplicates(["event_id", "ts"])


def kept_and_dropped(events: DataFrame, path: str, checkpoint: str, wait: float = 60) -> Dropped:
    """Runs ``deny_late`` to the end of a stream, writes what it keeps, and returns the counts of its listener."""
    spark, seen = events.sparkSession, Dropped()
    spark.streams.addListener(seen)
    try:
        run_to_end(deny_late(events), path, checkpoint, "append")
        seen.ended.wait(wait)
    finally:
        spark.streams.removeListener(seen)
    return seen


# ---------------------------------------------------------------- ingest


def first_seen(items: DataFrame, key: str) -> DataFrame:
    """A stream's rows with keys it has not had: known keys lie in the state store, so a batch reads only its own rows."""
    return items.dropDuplicates([key])
