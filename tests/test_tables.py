"""Jobs that write tables: batches that are run again, items that repeat, tracks without audio."""

import json

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tonearm.operators import analysis, resolve
from tonearm.plans.analysis import loudness
from tonearm.sources import items as I
from tonearm.sources import tables

TRACK = "track_id long, album_id long, title string, filename string, duration double, bitrate int, tags string, status string, retry_count int"


def audio(track_id, wave):
    wave = np.asarray(wave, np.float32)
    return [(track_id, i, 8000, wave[i * 2048 : (i + 1) * 2048].tolist(), [0.1] * 20) for i in range(-(-len(wave) // 2048))]


def test_a_batch_run_again_gives_the_same_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, "pending" if i % 2 else "completed", None) for i in range(10)], "k int, status string, note string")
    tables.put(rows, path)
    for _ in range(2):
        work = tables.waiting(spark, path, "pending", "1")
        changed = work.where("k < 6").withColumns({"status": F.when(F.col("k") < 4, "completed").otherwise("pending"), "note": F.lit("b")})
        tables.move(spark, path, changed, "k", "pending", "1")
        got = {r["k"]: (r["status"], r["note"]) for r in tables.rows_of(spark, path).collect()}
        assert got == {i: (("completed", "b") if i in (1, 3) else ("pending", "b") if i == 5 else ("pending", None) if i % 2 else ("completed", None)) for i in range(10)}
    assert tables.rows_of(spark, path).count() == 10 and tables.waiting(spark, path, "pending", "1").count() == 0
    assert sorted(r["k"] for r in tables.rows_of(spark, path, "pending").collect()) == [5, 7, 9]


def test_a_batch_that_stopped_before_the_old_rows_went(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.put(spark.createDataFrame([(i, "pending") for i in range(6)], "k int, status string"), path)
    work = lambda: tables.waiting(spark, path, "pending", "1")
    half = work().where("k < 3").withColumn("status", F.lit("completed"))
    tables._write(half.unionByName(work().where("k >= 3")).withColumn("batch", F.lit("1")), path)  # and no more
    tables.move(spark, path, work().where("k < 3").withColumn("status", F.lit("completed")), "k", "pending", "1")
    assert sorted((r["k"], r["status"]) for r in tables.rows_of(spark, path).collect()) == [(i, "completed" if i < 3 else "pending") for i in range(6)]


def test_analysis_of_sine_noise_and_silence(spark):
    t = np.arange(8000 * 12)
    sine = np.sin(2 * np.pi * 440 * t / 8000)
    noise = np.random.default_rng(0).normal(size=len(t))
    frames = audio(1, sine) + audio(2, noise) + audio(3, np.zeros(3000)) + audio(4, np.zeros(3000)) + audio(5, sine) + audio(7, sine[:100])
    rows = [(i, 1, f"song {i}", f"{i}.mp3", 200.0, 320, "jazz", "pending", i) for i in (1, 2, 3, 4, 6, 7)] + [(5, 1, "short", "5.mp3", 59.94, 320, None, "pending", 0), (8, 1, "done", "8.mp3", 200.0, 320, None, "completed", 0)]
    frames = spark.createDataFrame(frames, "track_id long, frame_no int, sample_rate int, samples array<float>, coef array<double>")
    albums = spark.createDataFrame([(1, "An album", "sfx", "rock", "jazz")], "album_id long, title string, creator string, subjects string, genres string")
    seen = []

    def model(heads, most=8000 * 10):
        assert all(len(h) <= most for h in heads)
        return loudness(heads)

    found = analysis.analyze_tracks(spark.createDataFrame(rows, TRACK), albums, frames, model)
    got = {r["track_id"]: r for r in found.tracks.collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "completed", 2: "unavailable", 3: "failed", 4: "failed", 5: "unavailable", 7: "unavailable"}
    assert got[5]["error_message"] == "listenability: duration 59.9s below 60s minimum"
    assert got[2]["error_message"].startswith("low quality: score=0.000 snr=") and got[7]["error_message"] == "low quality: score=0.000 snr=0.0 centroid=0 crest=" + got[7]["error_message"][-3:]
    assert (got[3]["retry_count"], got[3]["error_message"]) == (4, "clap: no embedding")
    assert got[1]["decision"] == "include" and got[1]["version"] == "listenability-v2" and got[1]["error_message"] is None
    e = found.embeddings.collect()
    assert [r["track_id"] for r in e] == [1] and abs(sum(x * x for x in e[0]["clap"]) - 1) < 1e-6 and len(e[0]["mfcc"]) == 40 and not seen


def test_resolving(spark, tmp_path):
    mp3 = lambda name, **more: {"name": name, "format": "VBR MP3", "length": "200", **more}
    meta = lambda i, **more: {"identifier": i, "title": f"Title {i}", "creator": "Someone", "licenseurl": "https://creativecommons.org/licenses/by/4.0/", "mediatype": "audio", **more}
    items = [
        {"metadata": meta("a", subject=["Rock", "Live"]), "files": [mp3("1 one.mp3"), mp3("2 two.mp3", title="Two", track="2/9"), mp3("1 one.mp3", title="again"), mp3("long.mp3", length="1:00:00"), {"name": "x.ogg", "format": "Ogg Vorbis"}]},
        {"metadata": meta("b", **{"access-restricted-item": "true"}), "files": [mp3("1.mp3")]},
        {"metadata": meta("c", subject="Audiobook"), "files": [mp3("1.mp3")]},
        {"metadata": meta("d", licenseurl="https://creativecommons.org/licenses/by-nc/4.0/"), "files": [mp3("1.mp3")]},
        {"metadata": meta("e"), "files": [{"name": "1.mp3", "format": "64Kbps MP3"}]}, {"metadata": meta("f")},
        {"metadata": meta("done"), "files": [mp3("1.mp3")]}, {"metadata": {"title": "no id"}}, {"metadata": meta("unknown album"), "files": [mp3("1.mp3")]},
    ]
    lines = [json.dumps(x) for x in items] + [json.dumps(items[1]), "{broken", ""]
    (tmp_path / "items.json").write_text("\n".join(lines))
    albums = spark.createDataFrame([(x, "resolving" if x == "a" else "resolved" if x == "done" else "pending") for x in ("a", "b", "c", "d", "e", "f", "done", "no item")], "album_id string, status string")
    tracks = spark.createDataFrame([(1, "a", "2 two.mp3", "old", 30.0, "completed", None), (2, "b", "1.mp3", None, 50.0, "pending", "x"), (3, "b", "2.mp3", None, 50.0, "completed", "x")],
                                   "track_id long, album_id string, filename string, title string, duration double, status string, tags string")
    seen = Observation()
    found = resolve.resolve_albums(albums, tracks, I.scan_item_metadata(spark, str(tmp_path / "items.json"), seen), seen)
    a = {r["album_id"]: r for r in found.albums.collect()}
    assert {k: (r["status"], r["error_message"]) for k, r in a.items()} == {
        "a": ("resolved", None), "b": ("unavailable", "access-restricted item"), "c": ("unavailable", 'non-music subject: "Audiobook"'),
        "d": ("unavailable", "excluded: non-free license (cc-by-nc)"), "e": ("unavailable", "no acceptable MP3 tracks found"), "f": ("unavailable", "no acceptable MP3 tracks found"),
        "done": ("resolved", None), "no item": ("pending", None),
    }
    assert (a["a"]["track_count"], a["a"]["license"], a["a"]["subjects"], a["a"]["prechecked"]) == (1, "cc-by", "Rock, Live", True)
    assert a["d"]["license"] == "cc-by-nc" and a["c"]["license"] is None and a["a"]["score"] is not None and a["c"]["score"] is None
    t = {(r["album_id"], r["filename"]): r for r in found.tracks.collect()}
    assert len(t) == 4 == found.tracks.count()
    assert t["a", "1 one.mp3"]["title"] == "One" and t["a", "1 one.mp3"]["status"] == "pending" and t["a", "2 two.mp3"]["title"] == "old"
    assert {r["tags"] for (x, _), r in t.items() if x == "a"} == {"live, rock, someone, title"}
    assert (t["b", "1.mp3"]["status"], t["b", "1.mp3"]["error_message"], t["b", "2.mp3"]["status"]) == ("unavailable", "access-restricted item", "completed")
    assert found.counters == {"lines": 11, "bad_lines": 1, "items": 6, "restricted": 1, "no_music": 1, "unlicensed": 1, "no_tracks": 2, "resolved": 1}
    free = resolve.resolve_albums(albums, tracks, I.scan_item_metadata(spark, str(tmp_path / "items.json")), free_only=False)
    assert free.counters["unlicensed"] == 0 and free.counters["resolved"] == 2


def test_buckets_join_without_exchange(spark, tmp_path):
    a = I.write_bucketed(spark.range(1000).selectExpr("id as k", "id % 7 as x"), "bucket_a", str(tmp_path / "a"), "k", 4)
    b = I.write_bucketed(spark.range(500).selectExpr("id as k", "id as y"), "bucket_b", str(tmp_path / "b"), "k", 4)
    j = a.hint("merge").join(b, "k").groupBy("k").agg(F.sum("x").alias("x"))
    assert "Exchange" not in j._jdf.queryExecution().sparkPlan().toString() and "Exchange hashpartitioning" not in j._jdf.queryExecution().executedPlan().toString()
    assert j.count() == 500
    spark.sql("drop table bucket_a")
    spark.sql("drop table bucket_b")


def test_stream_into_status_partitions(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(i, "pending" if i % 2 else "completed") for i in range(6)], "k int, status string")
    rows.write.parquet(path)
    q = spark.readStream.schema(rows.schema).parquet(path).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(I.catalog_batches(out))
    q.trigger(availableNow=True).start().awaitTermination()
    I.catalog_batches(out)(rows, 0)  # the batch comes again
    assert sorted(map(tuple, tables.rows_of(spark, out).select("k", "status").collect())) == [(i, "pending" if i % 2 else "completed") for i in range(6)]


def test_denylists(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  "one",\n  "two \\"x\\" \\u00e9",\n  "three"\n]\n')
    (tmp_path / "b.json").write_text('["four", "five"]')
    (tmp_path / "c.json").write_text('{"six": "seven"}')
    (tmp_path / "d.json").write_text('[\n"eight",\nnine\n]')
    (tmp_path / "e.json").write_text("[]")
    assert sorted(r[0] for r in I.scan_denylist(spark, str(tmp_path)).collect()) == ["five", "four", "one", "three", 'two "x" é']


def test_seeds(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"id": "a", "label": "A", "keywords": "x, y"}, {"id": "b", "enabled": False, "min_library_count": 3}]))
    seeds = I.scan_seed_pills(spark, str(tmp_path / "p.json")).select("id", "enabled", "min_library_count")
    have = spark.createDataFrame([("a", False, 1)], seeds.schema)
    assert sorted(map(tuple, I.seed(have, seeds, "id").collect())) == [("a", False, 1), ("b", False, 3)]
    assert [tuple(r) for r in I.seed(have, seeds, "id", only_if_empty=True).collect()] == [("a", False, 1)]
    assert sorted(map(tuple, I.seed(have.limit(0), seeds, "id", only_if_empty=True).collect())) == [("a", True, 10), ("b", False, 3)]
