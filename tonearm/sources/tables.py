"""A table kept in partitions by status, of which a job reads and writes only those it works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.sources.scratch import scratch


def materialised(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written to a new table in the shared folder and read again, for what is read more than once."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(df: DataFrame, path: str, batch: str = "0") -> None:
    """Rows into the partitions of their statuses, in the batch's own folders, which replace any of an earlier try."""
    _write(df.withColumn("batch", F.lit(batch)), path)


def rows_of(spark: SparkSession, path: str, *status: str) -> DataFrame:
    """Rows of some statuses (none given: all), without the batch; other partitions are not read."""
    t = spark.read.option("recursiveFileLookup", False).parquet(path).withColumn("batch", F.col("batch").cast("string"))
    return (t.where(F.col("status").isin(*status)) if status else t).drop("batch")


def waiting(spark: SparkSession, path: str, status: str, batch: str) -> DataFrame:
    """What a batch works on: rows of a status that other batches wrote, so that a repeated batch sees the same."""
    t = spark.read.parquet(path)
    return t.where((F.col("status") == status) & (F.col("batch").cast("string") != batch)).drop("batch")


def move(spark: SparkSession, path: str, changed: DataFrame, key: str, status: str, batch: str) -> None:
    """Rows of ``waiting`` as ``changed``; those without a change are kept, all other partitions are left alone.

    The batch's own partitions are written first, replacing any that an earlier try of it left; only then the waiting
    ones go. Running a batch again gives the same table.
    """
    before = waiting(spark, path, status, batch)
    rest = before.join(changed.select(key), key, "left_anti")
    names = [r["batch"] for r in spark.read.parquet(path).where(F.col("status") == status).select(F.col("batch").cast("string").alias("batch")).distinct().collect()]
    _write(changed.unionByName(rest, allowMissingColumns=True).withColumn("batch", F.lit(batch)), path)
    jvm = spark._jvm
    for name in names:
        if name != batch:
            old = jvm.org.apache.hadoop.fs.Path(f"{path}/status={status}/batch={name}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "batch").parquet(path)
