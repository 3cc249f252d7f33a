"""Rates, shares and states over activity events (event_id, ts, item_id, value, type).

Every function takes a batch or a streaming DataFrame: windows are event-time windows, so a stream with a watermark
and a batch over the same events give the same rows. ``watermarked`` drops events that are later than the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a second that count as full use.
LIMIT = 1_048_576


def watermarked(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _at(width: str, slide: str | None = None) -> Column:
    return F.window("ts", width, slide) if slide else F.window("ts", width)


def _start(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), *cols)


def completion_rates(events: DataFrame) -> DataFrame:
    """Per type and sliding five minutes: events, and events a second since the first of them, one second at least."""
    g = events.groupBy(_at("5 minutes", "1 minute"), "type").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    seconds = F.col("window.end").cast("double") - F.col("first").cast("double")
    return _start(g, "type", "n", F.round(F.col("n") / F.greatest(F.lit(1.0), seconds), 6).alias("rate"))


def bandwidth(events: DataFrame) -> DataFrame:
    g = events.where("type = 'bytes'").groupBy(_at("5 minutes", "1 minute")).agg(F.sum("value").alias("b"))
    rate = F.col("b") / 300
    return _start(g, F.round(rate, 6).alias("bytes_per_second"), F.round(F.least(F.lit(100.0), rate * 100 / LIMIT), 6).alias("pct_of_limit"))


def time_breakdown(events: DataFrame) -> DataFrame:
    """Shares of time by kind of work; null where there is none."""
    kinds = {"network": "api_call", "embed": "analyzer", "processing": "resolver"}
    sums = [F.coalesce(F.sum(F.when(F.col("type") == t, F.col("value"))), F.lit(0.0)).alias(k) for k, t in kinds.items()]
    g = events.groupBy(_at("1 hour")).agg(*sums)
    total = F.nullif(F.col("network") + F.col("embed") + F.col("processing"), F.lit(0.0))
    return _start(g, *(F.round(F.col(k) * 100 / total, 4).alias(k) for k in kinds))


def batch_progress(events: DataFrame) -> DataFrame:
    """Scored counts, one row a second and worker at most."""
    g = events.where("type = 'analyzer'").groupBy(_at("1 second"), "item_id").agg(F.count("*").alias("n"))
    return _start(g, "item_id", "n")


def status_fold(events: DataFrame) -> DataFrame:
    """The latest status of every item."""
    latest = F.max_by("type", F.struct("ts", "event_id")).alias("status")
    return events.groupBy("item_id").agg(latest, F.max("ts").alias("ts"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A folder of event files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*")
