"""Registered jobs over whole texts and growing tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.operators import audio
from tonearm.plans import analysis, catalog, jobs
from tonearm.plans.views import view


def test_letters_count_the_whole_text():
    a, b = jobs._letters(["a" * 256, "a" * 256 + "b" * 100])
    assert a.sum() == 256 and b.sum() == 356


def test_tracks_grow_with_the_vectors(spark, tmp_path):
    rows = spark.range(36_000).selectExpr("id as vec_id", "transform(sequence(1, 64), x -> cast(sin(id * x) as float)) as embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert analysis.frame_spectra(spark, str(tmp_path)).count() == 36_000
    assert analysis.pool_quality(spark, str(tmp_path)).count() == 720


def test_listenability_of_all_albums(spark):
    """Albums without completed tracks have a row too."""
    sf_dir = "/root/testdata/sf0.001"
    got = catalog.QUERIES["album_listenability"](spark, sf_dir)
    assert got.count() == view(spark, sf_dir, "tracks").select("album_id").distinct().count()
    assert not got.where("avg_score is null").count() and got.where("avg_completed is null").count()


def test_quality_pools_chroma_of_all_frames(spark, tmp_path):
    """Each of the twelve chroma sums is a mean over the frames of a track, however late they are."""
    rows = spark.range(100).selectExpr("id as vec_id", "transform(sequence(1, 64), x -> cast(sin(id + x) as float)) as embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    frames = analysis._whole_tracks(spark, str(tmp_path))
    each = audio.frame_spectra(frames).toPandas()
    got = analysis.pool_quality(spark, str(tmp_path)).toPandas().set_index("track_id")
    for track, part in each.groupby("track_id"):
        want = np.stack(part["chroma"]).mean(axis=0)
        assert got.loc[track, [f"chroma_{i}" for i in range(12)]].tolist() == pytest.approx(want.tolist(), abs=1e-3)
    late = frames.withColumn("frame_no", F.col("frame_no") + 10_000)
    assert audio.frame_spectra(late).count() == 0 and audio.frame_spectra(late, seconds=None).count() == 100
