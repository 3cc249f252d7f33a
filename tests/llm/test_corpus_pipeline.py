"""The pipeline's stages, one after the other, on the smallest documents."""

from pyspark.sql import functions as F

import corpus_pipeline
from tonearm.llm.common import saved
from tonearm.llm.jaccard import similar
from tonearm.llm.suffixes import measure

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kinds, seen = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, DIR))
        seen[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.dtypes == kinds
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = seen["quality rules"][1]
    assert good.join(labels.where("quality = 0"), "doc_id", "left_semi").count() == 0
    near = seen["n-gram Jaccard join"][1]
    roots = similar(seen["n-gram Jaccard join"][0], 80, 5).select("component_id").distinct().count()
    assert near.count() == roots and similar(near, 80, 5).where("doc_id <> component_id").count() == 0
    cut = seen["suffix-array dedup"]
    lost = cut[0].agg(F.sum(F.octet_length("text"))).first()[0] - cut[1].agg(F.sum(F.octet_length("text"))).first()[0]
    assert lost >= measure(cut[0]).agg(F.sum("n_removed")).first()[0] and cut[1].count() == cut[0].count()
    assert seen["PII"][1].where(F.col("text").rlike(r"[a-z0-9]+@mail[0-9]\.example\.com")).count() == 0
    packed = seen["best-fit packing"][1]
    assert packed.select("doc_id").distinct().count() == near.count()
    assert packed.where(F.octet_length("ids") != F.col("length") * 4).count() == 0
