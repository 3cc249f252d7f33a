"""Folders for what a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share; in a temporary one only on one machine where none is set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = getattr(spark, "_tonearm_scratch", None) or tempfile.mkdtemp(prefix="spark-tonearm-")
        spark._tonearm_scratch = known
    return f"{known.rstrip('/')}/{what}-{uuid.uuid4().hex}"
