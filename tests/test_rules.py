"""Literal cases of the rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.functions import listenability as L
from tonearm.functions import metadata as M
from tonearm.functions import text as X
from tonearm.operators import audio as A
from tonearm.operators import blocks as B
from tonearm.operators import catalog as C
from tonearm.operators import search as S
from tonearm.sources import items as I
from tonearm.streaming import rates as R


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("seconds, score", [(0, 0), (59, 0), (60, 0.65), (75, 0.775), (90, 1), (1800, 1), (2000, 0.5833), (2250, 0.375), (2700, 0), (3000, 0)])
def test_duration_score(spark, seconds, score):
    assert one(spark, L.duration_score(F.col("s")), s=float(seconds)) == pytest.approx(score, abs=1e-3)


@pytest.mark.parametrize("url, kind", [
    ("", "unknown"), ("http://creativecommons.org/publicdomain/zero/1.0/", "pd"), ("https://creativecommons.org/licenses/zero/1.0/", "cc0"),
    ("https://x.org/CC0", "cc0"), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"), ("https://creativecommons.org/licenses/by/4.0/", "cc-by"),
    ("https://www.creativecommons.org/licenses/by/4.0/", "other"), ("http://example.com", "other"),
])
def test_license(spark, url, kind):
    assert one(spark, M.classify_license(F.col("u")), u=url) == kind


@pytest.mark.parametrize("text, seconds", [("245.5", 245.5), ("4:05", 245), ("1:04:05", 3845), ("x", 0), ("", 0), ("a:b", 0), ("1:2:3:4", 1)])
def test_duration(spark, text, seconds):
    assert one(spark, M.parse_duration(F.col("t")), t=text) == seconds


@pytest.mark.parametrize("text, number", [("3/12", 3), ("007", 7), ("", 0), ("x", 0), ("000", 0)])
def test_track_number(spark, text, number):
    assert one(spark, M.parse_track_number(F.col("t")), t=text) == number


@pytest.mark.parametrize("name, title", [("01 - hello_world.mp3", "Hello World"), ("Track 03 - some-song.mp3", "Some Song"), ("plain.mp3", "Plain")])
def test_title(spark, name, title):
    assert one(spark, M.derive_title(F.col("n")), n=name) == title


def test_pill_score(spark):
    s = X.pill_score(F.lit("piano"), F.lit("Sonata"), F.lit("piano, classical, beethoven"), F.lit("The Complete Piano Sonatas"), F.lit("x"))
    assert one(spark, s, a=1) == pytest.approx(0.75)
    assert one(spark, X.pill_score(F.lit("the"), F.lit(""), F.lit(""), F.lit(""), F.lit("")), a=1) == 0


def test_transient(spark):
    for text, yes in (("stream: EOF", True), ("HTTP 403 timeout", False), ("not found", False), ("503", True)):
        assert one(spark, X.is_transient_error(F.col("t")), t=text) is yes


def test_flexible_fields(spark):
    lines = ['{"a":"x","b":true}', '{"a":["x","y"],"b":"true"}', '{"b":"TRUE"}', "{broken"]
    df = spark.createDataFrame([(x,) for x in lines], "s string").select(F.try_parse_json("s").alias("v"))
    got = df.select(M.flex_to_string(F.col("v"), "$.a"), M.flex_bool(F.col("v"), "$.b")).collect()
    assert [tuple(r) for r in got] == [("x", True), ("x, y", True), ("", False), ("", False)]


def test_denylist(spark):
    items = spark.createDataFrame([("a",), ("b",), ("x_LibriVox_1",), ("librivoxed",), (None,)], "identifier string")
    assert {r[0] for r in C.filter_denylist(items, spark.createDataFrame([("b",), (None,)], "identifier string")).collect()} == {"a", None}


def test_missing_denylist(spark, tmp_path):
    assert I.scan_denylist(spark, str(tmp_path / "none.json")).count() == 0


def test_collection_stats(spark):
    rows = [(1, "completed", 0.8), (1, "completed", 0.6), (1, "pending", None), (2, "completed", None), (2, "failed", 0.1), (3, "pending", None)]
    t = spark.createDataFrame(rows, "album_id long, status string, score double")
    a = spark.createDataFrame([(1, "cc0"), (2, "cc-by-nc"), (3, None)], "album_id long, license string")
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 99), (12, 3)], "collection_id long, album_id long")
    got = sorted(tuple(r) for r in C.collection_track_stats(links, a, t).collect())
    assert got == [(10, 5, 3, 0.7, 2, 40.0), (12, 1, 0, 0.0, 0, 0.0)]  # a collection without tracks is absent


def test_pages_follow_each_other(spark):
    rows = [(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else f"n{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a int, b string")
    order = [("a", True), ("b", False), ("k", False)]
    found, total = C.first_page(df, order, 7)
    while len(rest := C.page(df, order, 7, found[-1]).collect()):
        found += rest
    assert total == 60 and found == df.orderBy(F.desc("a"), "b", "k").collect()


def test_completed_albums_only(spark):
    a = spark.createDataFrame([(1, "resolved", 2), (2, "resolved", 1), (3, "pending", 1), (4, "resolved", 0)], "album_id long, status string, track_count int")
    a = a.selectExpr("*", "'x 100%' as title", "'c' as creator", "cast(null as string) as collection")
    t = spark.createDataFrame([(10, 1, "completed", 0.5), (11, 1, "pending", None), (20, 2, "completed", None), (30, 3, "completed", 1.0)], "track_id long, album_id long, status string, score double")
    e = spark.createDataFrame([(10, 0.5)], "track_id long, quality_score double")
    every = {r["album_id"]: (r["completed"], r["avg_quality"], r["avg_score"]) for r in C.search_albums(a, t, e, "%100%").collect()}
    assert every == {1: (1, 0.5, 0.5), 2: (1, 0.0, 0.0), 4: (0, 0.0, 0.0)}
    assert [r["album_id"] for r in C.search_albums(a, t, e, None, completed_only=True).collect()] == [2]


def test_score_reset_leaves_other_failures(spark):
    rows = [(1, "completed", "v1", "include", None), (2, "completed", "v2", "include", None), (3, "unavailable", "v1", "exclude", "listenability: x"), (4, "unavailable", "v1", "exclude", "decode: x"), (5, "failed", "v1", None, None)]
    t = spark.createDataFrame(rows, "k int, status string, version string, decision string, error_message string")
    got = [tuple(r) for r in C.reset_score_version(t, "v1").select(*t.columns).orderBy("k").collect()]
    assert got == [(1, "completed", None, "include", None), rows[1], (3, "completed", None, None, None), rows[3], rows[4]]


def test_enrichment_writes_back(spark):
    a = spark.createDataFrame([(1, "resolved", None), (2, "resolved", "pd"), (3, "pending", ""), (4, "unavailable", ""), (5, "resolved", "")], "album_id long, status string, license string")
    t = spark.createDataFrame([(i * 10, i, "completed", None) for i in (1, 2, 3, 4)] + [(50, 5, "pending", None)], "track_id long, album_id long, status string, tags string")
    m = spark.createDataFrame([(i, "https://creativecommons.org/licenses/by/4.0/") for i in (1, 2, 3, 5)] + [(4, None)], "album_id long, licenseurl string")
    assert {r["album_id"]: r["license"] for r in C.license_enrich(a, t, m).collect()} == {1: "cc-by", 2: "pd", 3: "", 4: "unknown", 5: ""}
    a = a.selectExpr("*", "if(album_id = 4, '', 'a la') as title", "'of' as creator", "if(album_id = 4, null, 'Rock') as subjects", "cast(null as string) as genres")
    e = t.select("track_id").where("track_id <> 20")
    assert {r["track_id"]: r["tags"] for r in C.tag_enhance(t, a, e).collect()} == {10: "rock", 20: None, 30: None, 40: None, 50: None}


def test_similar(spark):
    v = [(1, [1.0] * 48), (2, [1.0] * 48), (3, [-1.0] * 48), (4, [0.5] * 48)]
    df = spark.createDataFrame([(i, x + [0.0] * 16, True) for i, x in v], "track_id long, embedding array<double>, ok boolean")
    got = {r["track_id"]: r["distance"] for r in S.similar_tracks(df, F.col("track_id") == 1, 5).collect()}
    assert got == {2: pytest.approx(0, abs=1e-6), 4: pytest.approx(0, abs=1e-6), 3: pytest.approx(2, abs=1e-6)}


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_nearest_in_blocks(spark, monkeypatch, sent):
    for name, value in (("SENT", sent), ("QUERIES", 7), ("CANDIDATES", 11)):
        monkeypatch.setattr(B, name, value)
    r = np.random.default_rng(4)
    m = r.integers(-3, 4, (90, 5)).astype(float)  # many ties
    m[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(3)
    extra = df.withColumn("found", F.when(F.col("id") % 9 == 0, F.array(F.struct(F.lit(5).cast("long").alias("query"), F.lit(0.25).alias("score")))))
    got = {(x["query"], x["rank"]): (x["id"], x["score"]) for x in B.nearest(df.where("id < 20"), extra, 6, B.cosine, others=True).collect()}
    s = np.round(B.cosine(m, m) + 0.25 * np.outer(np.arange(90) == 5, np.arange(90) % 9 == 0), 9)
    want = {}
    for i in range(20):
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], j))[:6]
        want |= {(i, k + 1): (j, s[i, j]) for k, j in enumerate(order)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_half_floats(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, None)], "id long, v array<float>")
    blobs = A.store_vectors(df, "v")
    assert [r["v"] and len(r["v"]) for r in blobs.orderBy("id").collect()] == [6, None]
    assert A.load_vectors(blobs, "v").orderBy("id").first()["v"] == [0.5, -1.0, 2.0]


def test_audio_on_sine_noise_and_silence(spark):
    t = np.arange(2048 * 4)
    waves = {1: np.sin(2 * np.pi * 440 * t / 48000), 2: np.random.default_rng(1).normal(size=len(t)), 3: np.zeros(len(t))}
    rows = [(k, i, 48000, w[2048 * i : 2048 * (i + 1)].tolist()) for k, w in waves.items() for i in range(4)]
    f = spark.createDataFrame(rows, "track_id long, frame_no int, sample_rate int, samples array<double>")
    q = {r["track_id"]: r for r in A.pool_quality(A.frame_spectra(f), A.crest_parts(f)).collect()}
    assert q[1]["snr"] == 40 and q[1]["crest"] == pytest.approx(2**0.5, abs=0.01) and int(np.argmax(q[1]["chroma"])) == 9
    assert q[2]["snr"] < q[1]["snr"] and q[2]["centroid"] > q[1]["centroid"]
    assert q[3]["crest"] == 1.0


def test_late_events_are_dropped(spark, tmp_path):
    schema = "event_id long, ts string, item_id long, value double, type string"
    dropped = []
    for i, at in enumerate(("2024-01-01 12:00:00", "2024-01-01 10:01:00")):
        part = spark.createDataFrame([(i, at, 1, 1.0, "bytes")], schema).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        q = R.bandwidth(R.watermarked(stream)).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        dropped.append(sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]))
    assert dropped[0] == 0 and dropped[1] > 0


def test_requeue(spark):
    t = spark.createDataFrame([(1, "processing", 0), (2, "processing", 3), (3, "pending", 1)], "k long, status string, retry_count int")
    got = {r["k"]: (r["status"], r["retry_count"]) for r in C.requeue(t, t.where("k < 3").select("k"), "k").collect()}
    assert got == {1: ("pending", 1), 2: ("failed", 4), 3: ("pending", 1)}


def test_repeated_keys_in_change_sets(spark):
    t = spark.createDataFrame([(1, 0, "pending", "x"), (2, 5, "pending", None), (3, 1, "completed", "y")], "k int, retry_count int, status string, error_message string")
    twice = t.where("k < 3").select("k")
    assert sorted(r["k"] for r in C.requeue(t, twice.unionByName(twice), "k").collect()) == [1, 2, 3]
    c = spark.createDataFrame([(1, "failed", None), (1, "completed", "a"), (9, "failed", "b")], "k int, status string, error_message string")
    got = {r["k"]: (r["status"], r["error_message"]) for r in C.apply_status(t, c, "k").collect()}
    assert got == {1: ("failed", None), 2: ("pending", None), 3: ("completed", "y")}
    assert sorted(r["k"] for r in C.upsert(t, t.unionByName(t), ["k"]).collect()) == [1, 2, 3]


def test_pills_without_keywords_match_nothing(spark):
    t = spark.createDataFrame([(1, 7, "Rock, jazz", "completed", None, None)], "track_id int, album_id int, tags string, status string, decision string, stream string")
    a = spark.createDataFrame([(7, "ambient")], "album_id int, subjects string")
    e = t.selectExpr("track_id", "0.5D as quality_score")
    assert C.pill_matches(spark.createDataFrame([(3, "jazz")], "pill_id int, keywords string"), t, e.where("track_id > 1"), a).isEmpty()  # no embedding
    p = spark.createDataFrame([(1, None), (2, ""), (3, "JAZZ , x"), (4, "ambient"), (5, "metal")], "pill_id int, keywords string")
    assert sorted(r["pill_id"] for r in C.pill_matches(p, t, e, a).collect()) == [3, 4]


def test_ten_thousand_pills(spark, monkeypatch):
    monkeypatch.setattr(C, "KEYWORD_BYTES", 20_000)
    p = spark.range(10_000).selectExpr("id as pill_id", "concat('word', id, ', also', id % 7) as keywords")
    t = spark.createDataFrame([(i, 1, f"word{i}, also3", "completed", None, None) for i in (5, 50, 500)], "track_id int, album_id int, tags string, status string, decision string, stream string")
    a = spark.createDataFrame([(1, None)], "album_id int, subjects string")
    e = t.selectExpr("track_id", "0.5D as quality_score")
    got = {}
    for r in C.pill_matches(p, t, e, a).collect():
        got.setdefault(r["track_id"], set()).add(r["pill_id"])
    third = set(range(3, 10_000, 7))
    assert got == {i: third | {int(str(i)[: n + 1]) for n in range(len(str(i)))} for i in (5, 50, 500)}


def test_pill_tracks_rank_by_the_quality_of_their_embedding(spark):
    t = spark.createDataFrame([(1, 7, "jazz", "completed", None, None, 0.9), (2, 7, "jazz", "completed", None, None, 0.1)], "track_id int, album_id int, tags string, status string, decision string, stream string, quality double")
    e = spark.createDataFrame([(1, 0.2), (2, 0.8)], "track_id int, quality_score double")
    a = spark.createDataFrame([(7, None)], "album_id int, subjects string")
    p = spark.createDataFrame([(3, "jazz")], "pill_id int, keywords string")
    assert {r["track_id"]: r["quality"] for r in C.pill_matches(p, t, e, a).collect()} == {1: 0.2, 2: 0.8}


def test_names_of_collections_without_titles(spark):
    c = spark.createDataFrame([(1, "zeta"), (2, "alpha"), (3, None), (4, ""), (5, "alpha")], "collection_id int, title string")
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10), (5, 10), (2, 11), (9, 12)], "collection_id int, album_id int")
    assert {r["album_id"]: r["names"] for r in C.collection_names(links, c).collect()} == {10: "3, 4, alpha, alpha, zeta", 11: "alpha"}


def test_removed_collection_takes_its_links_only(spark):
    c = spark.createDataFrame([(1,), (2,)], "collection_id int")
    links = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "collection_id int, album_id int")
    kept, kept_links = C.remove_collection(c, links, c.where("collection_id = 1"))
    assert [tuple(r) for r in kept.collect()] == [(2,)] and [tuple(r) for r in kept_links.collect()] == [(2, 10)]


def test_lexical_coverage_of_unknown_albums(spark):
    rows = [(1, "a", "completed"), (1, "", "completed"), (2, None, "completed"), (3, "b", "completed"), (None, "c", "completed"), (4, "d", "pending")]
    t = spark.createDataFrame(rows, "album_id int, tags string, status string")
    a = spark.createDataFrame([(1, "x", None), (2, "", "y"), (4, None, None)], "album_id int, subjects string, genres string")
    assert tuple(C.lexical_coverage(t, a).first()) == (3, 2, 1, 1, 2, 1)
    assert tuple(C.lexical_coverage(t.limit(0), a).first()) == (0, 0, 0, 0, 0, 0)


def test_backlogs_in_order_with_context(spark):
    rows = [(i, album, f"f{i}", None, None, None, None, status, version) for i, album, status, version in (
        (1, 1, "pending", None), (2, 2, "pending", None), (3, 3, "pending", None), (4, 4, "pending", None), (5, 9, "pending", None),
        (6, 1, "completed", "new"), (7, 1, "completed", "old"), (8, 2, "completed", None), (9, 9, "completed", None), (10, 2, "completed", "old"))]
    t = spark.createDataFrame(rows, "track_id int, album_id int, filename string, title string, duration double, bitrate int, tags string, status string, version string")
    a = spark.createDataFrame([(1, "A", None), (2, None, 0.5), (3, "C", None), (4, "D", None)], "album_id int, title string, album_score double")
    a = a.selectExpr("*", "concat('id', album_id) as identifier", "cast(null as string) as creator", "cast(null as string) as subjects", "cast(null as string) as genres")
    links = spark.createDataFrame([(10, 1), (20, 2), (7, 3), (10, 3)], "collection_id int, album_id int")
    c = spark.createDataFrame([(7, 1, "first"), (10, 5, "ten"), (20, 9, "twenty")], "collection_id int, created_seq int, title string")
    got = C.analysis_backlog(t, a, links, c, priority=7, n=10).orderBy("rank").collect()
    assert [(r["track_id"], r["album_title"], r["collection_name"], r["album_score"], r["duration"]) for r in got] == [(3, "C", "first", 0.0, 0.0), (2, "id2", "twenty", 0.5, 0.0), (1, "A", "ten", 0.0, 0.0), (4, "D", "", 0.0, 0.0)]
    assert [r["track_id"] for r in C.analysis_backlog(t, a, links, c, priority=99, n=2).orderBy("rank").collect()] == [2, 1]
    e = spark.createDataFrame([(8,)], "track_id int")
    old = C.rescore_backlog(t, a, e, "new", after=7, n=5).orderBy("track_id").collect()
    assert [(r["track_id"], r["album_score"], r["has_embedding"], r["title"]) for r in old] == [(8, 0.5, True, ""), (10, 0.5, False, "")]


def test_transitions_tell_why_and_when(spark):
    rows = [(1, 10, "failed", 2, "x", 0), (2, 10, "pending", 3, "y", 0), (3, 11, "processing", 0, None, 5), (4, 11, None, 0, "z", 0), (5, 10, "completed", 0, None, 0)]
    t = spark.createDataFrame(rows, "track_id int, album_id int, status string, retry_count int, error_message string, updated_at int")
    now = F.lit(9)

    def told(df):
        return {r["track_id"]: (r["status"], r["retry_count"], r["error_message"], r["updated_at"]) for r in df.collect()}

    same = {r[0]: (r[2], r[3], r[4], r[5]) for r in rows}
    assert told(C.reset_failed(t, now)) == same | {1: ("pending", 0, None, 9)}
    assert told(C.reset_stuck(t, "processing", F.lit(5), now)) == same
    assert told(C.reset_stuck(t, "processing", F.lit(6), now)) == same | {3: ("pending", 0, None, 9)}
    assert told(C.reset_stuck(t, "processing", F.lit(6), now, why="stuck")) == same | {3: ("pending", 0, "stuck", 9)}
    why = spark.createDataFrame([(1, "EOF"), (1, "EOF"), (2, None), (7, "x")], "track_id int, error_message string")
    assert told(C.requeue(t, why, "track_id", now=now)) == same | {1: ("pending", 3, "EOF", 9), 2: ("failed", 4, None, 9)}
    assert told(C.requeue(t, why, "track_id", count_failures=False, now=now))[2] == ("failed", 3, None, 9)
    a = spark.createDataFrame([(10, "unavailable", "gone"), (11, "resolved", None)], "album_id int, status string, error_message string")
    named = spark.createDataFrame([(5, "failed", "decoder")], "track_id int, status string, error_message string")
    done = C.cascade_album(t, a, named, now)
    assert told(done) == same | {2: ("unavailable", 3, "gone", 9), 5: ("failed", 0, "decoder", 9)}
    assert {r["track_id"] for r in done.where("stayed").collect()} == {1}
    assert [tuple(r) for r in C.cascade_counts(done).collect()] == [(10, 1)]
    c = spark.createDataFrame([(1, "failed", 7, "p4", "HTTP 500")], "collection_id int, status string, discovered_count int, last_cursor string, error_message string")
    assert tuple(C.reset_collections(c).first()) == (1, "pending", 0, "", None)


def test_rescoring_reads_embeddings_and_writes_all(spark):
    rows = [(i, 1, "A song", f"f{i}.mp3", 200.0, 256, "rock", 1.0, status, version, "old error") for i, status, version in ((1, "completed", "v1"), (2, "completed", None), (3, "completed", "v2"), (4, "pending", None))]
    rows.append((5, 1, "A song", "f5.mp3", 20.0, 256, "rock", 1.0, "completed", "v1", None))
    t = spark.createDataFrame(rows, "track_id long, album_id long, title string, filename string, duration double, bitrate int, tags string, quality double, status string, version string, error_message string")
    t = t.selectExpr("*", "0.1D as score", "'poor' as tier", "'default' as stream", "'demote' as decision", "1 as updated_at")
    a = spark.createDataFrame([(1, "A", "B", "rock", "rock")], "album_id long, title string, creator string, subjects string, genres string")
    e = spark.createDataFrame([(1, 0.9), (5, 0.9)], "track_id long, quality_score double")
    prompts = spark.createDataFrame([(i, 0.2, 0.3, 0.1, "noise") for i in (1, 2, 3, 4, 5)], "track_id long, margin double, positive double, negative double, strongest string")
    scores = C.rescore(t, a, e, prompts, "v2")
    got = {r["track_id"]: r for r in scores.collect()}
    assert set(got) == {1, 2, 5} and got[1]["components"]["technical_quality"] == 0.9 and got[2]["components"]["technical_quality"] == 0.0
    assert got[1]["components"]["content_type"] > got[2]["components"]["content_type"]  # prompts count for embedded tracks only
    done = {r["track_id"]: r for r in C.merge_scores(t, scores, mark=True, now=F.lit(7)).collect()}
    assert {i: (r["status"], r["checked_at"], r["updated_at"]) for i, r in done.items()} == {1: ("completed", 7, 1), 2: ("completed", 7, 1), 3: ("completed", None, 1), 4: ("pending", None, 1), 5: ("unavailable", 7, 7)}
    assert done[5]["error_message"] == f"listenability: exclude decision (score={got[5]['score']:.3f} tier={got[5]['tier']})"
    assert done[1]["reasons"] == got[1]["reasons"] and done[1]["tier"] == got[1]["tier"] and done[3]["reasons"] is None and done[3]["score"] == 0.1
