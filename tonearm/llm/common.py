"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only on one machine without the setting."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = getattr(spark, "_tonearm_shared", None) or tempfile.mkdtemp(prefix="spark-tonearm-")
        spark._tonearm_shared = known
    return known.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonearm-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # what was shuffled for the table is of no use once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove ``saved`` tables. Only for those whose readers have all been saved themselves, so that none reads them again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of a batch's rows that are looked at together.
SLICE = 16 << 20


def slices(batches, rows: int = 512) -> Iterator:
    """Record batches of ``rows`` rows and about SLICE bytes at most, so that few texts are Python objects at once."""
    for b in batches:
        step = max(1, min(rows, rows if b.nbytes <= SLICE else b.num_rows * SLICE // b.nbytes))
        for i in range(0, max(1, b.num_rows), step):
            yield b.slice(i, step)


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for null, empty or blank texts.

    White space becomes plain spaces first, so that the usual text splits at a single character without a regex.
    """
    flat = F.coalesce(text, F.lit(""))
    for c in SPACE[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    flat = F.btrim(flat)

    def split(t: Column) -> Column:
        return (
            F.when(t == "", F.array().cast("array<string>"))
            .when(F.contains(t, F.lit("  ")), F.split(t, " +"))
            .otherwise(F.split(t, " "))
        )

    return F.get(F.transform(F.array(flat), split), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_columns(df: DataFrame, fn, schema: str, rows: int = 512) -> DataFrame:
    """``df`` through ``fn``, ``rows`` rows at a time: it gets columns as Python lists (nulls are None) and returns columns."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in slices(batches, rows):
            out = fn(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)

    return df.mapInArrow(run, schema)
