"""What queries do with large tables, by their plans."""

from pyspark.sql import functions as F

from tonearm.functions import text as X
from tonearm.plans.views import VIEWS, inputs, view

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_tracks_are_grouped_without_sorting(spark):
    t = view(spark, DIR, "tracks")
    sql = spark.sql(VIEWS["tracks"], **{x: view(spark, DIR, x) for x in inputs(VIEWS["tracks"])})
    assert t.dtypes == sql.dtypes and t.exceptAll(sql).isEmpty() and sql.exceptAll(t).isEmpty()
    told = ("track_id", "album_id", "duration", "status")
    assert "SortAggregate" not in plan(t.select(*told)) and "SortAggregate" in plan(sql.select(*told))


def test_words_of_a_row_are_taken_once(spark):
    t = spark.createDataFrame([("Hot Ring", "hot, small", "Gears", "A Band")], "title string, tags string, album string, creator string")
    s = t.select(X.pill_score(F.lit("hot gears"), *(F.col(c) for c in ("title", "tags", "album", "creator"))).alias("s"))
    assert round(s.first()["s"], 6) == 0.425
    low = plan(s).split("Optimized Logical Plan")[1]
    fold = low[low.index("aggregate(") : low.index("Physical Plan")]
    assert "split(" not in fold[: fold.index("AS s")]


def test_models_and_spectra_take_some_rows_at_a_time(spark):
    from tonearm.operators import audio as A

    def few(heads):  # a model that takes so many and no more
        assert len(heads) <= 256
        return [[float(h[0]), 1.0] for h in heads]

    f = spark.range(1500).selectExpr("id div 2 as track_id", "cast(id % 2 as int) as frame_no", "48000 as sample_rate", "array_repeat(cast(id as float), if(id % 5 = 0, 1000, 2048)) as samples").coalesce(1)
    heads = {r["track_id"]: r["v"] for r in A.embed_heads(f, 10, few, "v").collect()}
    assert len(heads) == 750 and all(abs(v[0] - 2 * t / (4 * t * t + 1) ** 0.5) < 1e-6 for t, v in heads.items())
    assert A.embed_column(f.selectExpr("track_id", "samples"), "samples", few).count() == 1500
    assert len(A.embed_column(f.selectExpr("track_id", "samples"), "samples", few).collect()) == 1500
    assert A.frame_spectra(f).count() == 1200


def test_buckets_and_links(spark):
    from tonearm.operators import catalog as C
    from tonearm.plans import jobs

    assert jobs.buckets(1) == 8 and jobs.buckets(216_000_000) == 216
    new = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "collection_id int, album_id long")
    done = C.insert_or_ignore(new.limit(0), new, ["collection_id", "album_id"], ["album_id"])
    assert done.count() == 2 and "Window" not in plan(done)
