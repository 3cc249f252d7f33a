"""The corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.common import documents, dropped, saved
from tonearm.llm.jaccard import one_of_each
from tonearm.llm.packing import pack
from tonearm.llm.pii import redact
from tonearm.llm.quality import keep_good
from tonearm.llm.suffixes import remove_repeats


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the least id stays."""
    return one_of_each(docs, percent=80, n=5)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand anywhere else go from the texts."""
    return _measured(remove_repeats(docs))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return _measured(redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("PII", personal_data_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the stages after the first; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage read is removed once what it made is written."""
    docs, before = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
