"""Streams over several batches: state that goes, batches that come again, rates of the stages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tonearm.streaming import rates as R
from tonearm.streaming import state as S

EVENT = "event_id long, ts timestamp, item_id long, value double, type string"
START = dt.datetime(2024, 1, 1)


def event(i, minute, item, kind="bytes"):
    return (i, START + dt.timedelta(minutes=minute), item, 1.0, kind)


def files(spark, path, *parts):
    for rows in parts:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, S.STORE)
    yield
    spark.conf.unset(key)


def test_statuses_over_batches(spark, tmp_path, rocks):
    parts = [
        [event(1, 0, 1, "a"), event(2, 0, 1, "b"), event(3, 1, 2, "a")],
        [event(4, 2, 1, "c"), event(5, 0.5, 2, "old")],  # an older event of item 2 changes nothing
        [event(6, 3000, 3, "a")],  # days later: items 1 and 2 are forgotten
        [event(7, 6000, 1, "back")],
        [event(8, 9000, 4, "a")],
    ]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = R.watermarked(files(spark, path, *parts))
    q = S.status_changes(stream, "1 hour").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    q = q.foreachBatch(S.to_batches(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["customMetrics"] for p in q.recentProgress if p["stateOperators"]]
    log = S.batches(spark, out, S.STATUS)
    assert {(r["item_id"], r["status"]) for r in log.collect()} == {(1, "b"), (2, "a"), (1, "c"), (3, "a"), (1, "back"), (4, "a")}
    want = {r["item_id"]: r["status"] for r in R.status_fold(spark.createDataFrame(sum(parts, []), EVENT)).collect()}
    assert {r["item_id"]: r["status"] for r in S.latest_status(log).collect()} == want == {1: "back", 2: "a", 3: "a", 4: "a"}
    assert sum(h["numDeletedTimers"] for h in held) >= 4  # one replaced, three gone
    S.to_batches(out)(spark.createDataFrame(log.where("batch = 0").drop("batch").collect(), S.STATUS), 0)  # once more
    assert {r["item_id"]: r["status"] for r in S.latest_status(S.batches(spark, out, S.STATUS)).collect()} == want


def test_late_rows_are_counted(spark, tmp_path):
    parts = [[event(1, 0, 1)], [event(2, 100, 1), event(2, 100, 1)], [event(3, 200, 1)], [event(4, 94, 1), event(5, 95, 1), event(6, 95.1, 1), event(7, 400, 1)]]
    stream = R.watermarked(files(spark, str(tmp_path / "in"), *parts))
    seen = S.kept_and_dropped(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    kept = S.batches(spark, str(tmp_path / "out"), EVENT)
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 3, 6, 7]  # the last batch's mark is that of batch 1, less five minutes
    assert (seen.rows, seen.input) == (2, 8)


def test_remaining_time(spark):
    rows = [event(i, 0.1 * i, 1, "resolver") for i in range(1, 11)] + [event(20, 0.5, 1, "license"), event(21, 0.5, 1, "bytes")]
    stages = spark.createDataFrame([("resolver", 100, 20), ("analyzer", 7, 0), ("enhancer", 0, 0), ("license", 0, 3)], "stage string, waiting long, in_flight long")
    got = S.remaining_time(spark.createDataFrame(rows, EVENT), stages).where(F.col("window_start") == F.lit(START))
    # ten completions in the 294 s since the first of them
    assert {r["stage"]: (r["state"], r["seconds"]) for r in got.collect()} == {
        "resolver": ("running", int(120 / (10 / 294))), "analyzer": ("unknown", None), "enhancer": ("done", None), "license": ("unknown", None)
    }


def test_ingest_takes_each_key_once(spark, tmp_path, rocks):
    path, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    rows = [event(i, 0, i % 3) for i in range(6)]
    S.run_to_end(S.first_seen(files(spark, path, rows), "item_id"), out, state, "append")
    S.run_to_end(S.first_seen(files(spark, path, rows + [event(9, 0, 9)]), "item_id"), out, state, "append")
    S.run_to_end(S.first_seen(files(spark, path), "item_id"), out, state, "append")
    got = sorted(r["item_id"] for r in S.batches(spark, out, EVENT).collect())
    assert got == [0, 1, 2, 9]
