"""Repeated rows and rows without ids in the near-duplicate stage, and the texts that the next stage leaves."""

import random

import corpus_pipeline


def prose(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(80))


def test_one_of_each_class_stays(spark):
    a, b, c, d, e = map(prose, range(5))
    rows = [(1, a), (1, a), (2, b), (3, b), (None, b), (None, c), (None, c), (4, d), (None, e), (5, None), (5, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", {"k": 1}) for i, t in rows], "doc_id long, text string, lang string, odd map<string,int>")
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert left.columns == docs.columns
    told = lambda df: sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str)
    want = [(1, a), (2, b), (None, c), (4, d), (None, e), (5, None), (None, None)]
    assert told(left) == sorted(want, key=str)
    assert told(corpus_pipeline.repeats_stage(spark, left, "")) == sorted(want, key=str)
