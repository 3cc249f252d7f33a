"""Item metadata into the catalogue: gates, new tracks, tags, licenses and album scores."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tonearm.functions import metadata as M
from tonearm.functions.text import generate_tags
from tonearm.operators import catalog as C
from tonearm.sources import items as I
from tonearm.sources.tables import materialised


class Resolved(NamedTuple):
    """Both tables as they then are, and how many items went which way."""

    albums: DataFrame
    tracks: DataFrame
    counters: dict[str, int]


#: Columns of the album table that resolving sets, and of new tracks.
ALBUM = {"prechecked": "boolean", "title": "string", "creator": "string", "collection": "string", "art_url": "string", "track_count": "long", "subjects": "string",
         "genres": "string", "license": "string", "error_message": "string", "score": "double", "tier": "string", "stream": "string", "decision": "string", "reasons": "array<string>"}


def gates(items: DataFrame, free_only: bool = True) -> DataFrame:
    """Plain items (album_id, ..., files) with their license, acceptable files, and the gate that stops each, or null."""
    c = F.col
    kept = F.filter("files", lambda f: M.is_acceptable_mp3(f["format"], f["bitrate"]) & (M.parse_duration(f["length"]) <= M.MAX_SECONDS))
    a = items.withColumns({"files": F.when(~c("restricted"), kept), "license": M.classify_license(c("licenseurl"))})
    music = M.music_reason(c("subjects"), c("genres"), c("mediatype"), c("title"), c("description"), c("creator"))
    unfree = F.lit(free_only) & ~c("license").isin(*M.COMMERCIAL)
    gate = (
        F.when(c("restricted"), "restricted").when(music.isNotNull(), "no_music").when(unfree, "unlicensed")
        .when(F.coalesce(F.size("files"), F.lit(0)) <= 0, "no_tracks")
    )
    reason = (
        F.when(c("gate") == "restricted", "access-restricted item").when(c("gate") == "no_music", music)
        .when(c("gate") == "unlicensed", F.concat(F.lit("excluded: non-free license ("), c("license"), F.lit(")")))
        .when(c("gate") == "no_tracks", "no acceptable MP3 tracks found")
    )
    return a.withColumn("gate", gate).withColumn("reason", reason)


def files_of(resolved: DataFrame) -> DataFrame:
    """The acceptable files of resolved items as pending tracks; ids are hashes of album and file name."""
    f = resolved.select("album_id", F.posexplode("files").alias("place", "f"))
    text = lambda name: F.col(f"f.{name}")
    return f.select(
        F.xxhash64("album_id", "f.name").alias("track_id"), "album_id", text("name").alias("filename"),
        F.coalesce(F.nullif(text("title"), F.lit("")), M.derive_title(text("name"))).alias("title"), M.parse_track_number(text("track")).alias("track_number"),
        text("format"), M.parse_bitrate(text("bitrate")).alias("bitrate"), M.parse_duration(text("length")).alias("duration"),
        M.download_url(F.col("album_id"), text("name")).alias("download_url"), F.lit("pending").alias("status"), "place",
    )


def resolve_albums(albums: DataFrame, tracks: DataFrame, items: DataFrame, bad_lines: Observation | None = None, free_only: bool = True, now: Column | None = None) -> Resolved:
    """Waiting albums (pending or resolving) by their scanned item metadata; albums without metadata stay as they are.

    Gates in order: restricted, no music, license (with ``free_only``), no acceptable file; what they stop is unavailable
    with the reason, and restricted albums take their pending tracks along. Others are resolved: files that the album
    lacks become tracks, ``track_count`` is their number, all tracks of the album get its words as tags, a known license is
    stored, and the album is scored by all its tracks. Of several items of one album the largest counts. ``bad_lines`` is
    the observation that ``scan_item_metadata`` was given. Items are parsed once, and counted in that pass.
    """
    waiting = albums.where("status in ('pending', 'resolving')").select("album_id")
    flat = I.plain_items(items).join(waiting, "album_id", "left_semi")
    gated = gates(C.one_per_key(flat, ["album_id"]), free_only)
    names = ("restricted", "no_music", "unlicensed", "no_tracks")
    seen = Observation()
    counts = [F.count_if(F.col("gate") == n).alias(n) for n in names]
    gated = materialised(gated.observe(seen, F.count(F.lit(1)).alias("items"), *counts, F.count_if(F.col("gate").isNull()).alias("resolved")), "gated")
    counters = dict(seen.get) | (dict(bad_lines.get) if bad_lines is not None else {})

    ok = gated.where("gate is null")
    new = files_of(ok)
    keys = ["album_id", "filename"]
    more = materialised(C.insert_or_ignore(new.limit(0), new, keys, ["place"]).drop("place").join(tracks.select(*keys), keys, "left_anti"), "inserted")
    restricted = gated.where("gate = 'restricted'").select("album_id", F.lit("unavailable").alias("status"))
    joined = [F.array_join(F.coalesce(x, F.array()), ", ").alias(x) for x in ("subjects", "genres")]
    said = ok.select("album_id", "title", "creator", "collection", *joined, "license")
    tags = said.select("album_id", generate_tags(*(F.col(c) for c in ("album_id", "title", "creator", "subjects", "genres"))).alias("tags"))

    merged = tracks.unionByName(more, allowMissingColumns=True)
    merged = C.apply_status(C.evolve_schema(merged, {"tags": F.lit(None).cast("string")}), tags.where("tags <> ''"), "album_id", now)
    merged = C.evolve_schema(merged, {"error_message": F.lit(None).cast("string")})
    merged = C.cascade_album(merged, restricted).withColumn("error_message", F.when(F.col("cascaded"), "access-restricted item").otherwise(F.col("error_message"))).drop("cascaded", "stayed")

    n = more.groupBy("album_id").agg(F.count("*").alias("track_count"))
    said = said.join(n, "album_id", "left").withColumn("track_count", F.coalesce("track_count", F.lit(0)))
    lengths = tracks.select("album_id", "title", "filename", "duration").unionByName(more.select("album_id", "title", "filename", "duration"))
    evidence = C.album_evidence(lengths.join(ok.select("album_id"), "album_id", "left_semi")).drop("track_count")
    scores = C.score_albums(said, evidence)
    won = said.join(scores, "album_id").select(
        "*", F.lit("resolved").alias("status"), F.lit(True).alias("prechecked"), M.art_url(F.col("album_id")).alias("art_url")
    ).withColumn("license", F.when(F.col("license") != "unknown", F.col("license")))
    lost = gated.where("gate is not null").select(
        "album_id", F.lit("unavailable").alias("status"), F.col("reason").alias("why_"), F.when(F.col("gate") == "unlicensed", F.col("license")).alias("license")
    )
    changes = won.unionByName(lost, allowMissingColumns=True)
    out = C.evolve_schema(albums, {c: F.lit(None).cast(t) for c, t in ALBUM.items()})
    out = C.apply_status(out, changes, "album_id", now)
    return Resolved(out.withColumn("error_message", F.coalesce("why_", "error_message")).drop("why_"), merged, counters)
