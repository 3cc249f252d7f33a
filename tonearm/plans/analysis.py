"""Registered jobs that take tracks and albums from metadata and audio to scores, each beside its SQL twin.

Frames are made from the embeddings: a vector over and over, only once at the start, or silence. For SQL the Fourier sums
of such frames are a table of waves (bin, place in the vector) joined with the vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import analysis, resolve
from tonearm.operators import audio as A
from tonearm.plans.catalog import LICENSE_SQL, WORDS_SQL, words_sql
from tonearm.plans.jobs import item_lines, written
from tonearm.plans.scoring import PRECHECK_REASON_SQL, album_score_sql, score_sql
from tonearm.plans.views import VIEWS, oracle, view
from tonearm.sources import items as I
from tonearm.sources import tables
from tonearm.sources.scratch import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


# ---------------------------------------------------------------- resolving

#: What the items say, as columns; the catalogue knows every third track already.
ITEMS_SQL = f"""it as (select a.album_id, a.title, a.creator, a.subjects, a.licenseurl, {LICENSE_SQL} as class, case when a.album_id % 4 = 0 then 'Radio 12' when a.album_id % 4 = 1 then 'netlabels' end as collection,
      a.album_id % 20 = 0 as restricted, a.album_id % 11 = 3 as texts, (select count(*) from v_tracks t where t.album_id = a.album_id and track_id % 5 <> 0 and duration <= 1920) as n_ok
    from v_albums a where a.status = 'pending' and a.album_id % 50 <> 7 and a.album_id in (select album_id from v_tracks)),
  g as (select *, case when restricted then 'access-restricted item' when texts then 'non-audio mediatype: texts' when class not in ('pd', 'cc0', 'cc-by', 'cc-by-sa') then 'excluded: non-free license (' || class || ')'
      when n_ok = 0 then 'no acceptable MP3 tracks found' end as reason from it),
  old as (select * from v_tracks where track_id % 3 = 0),
  fresh as (select t.* from v_tracks t join g on g.album_id = t.album_id where g.reason is null and t.track_id % 5 <> 0 and t.duration <= 1920 and t.track_id % 3 <> 0),
  named as (select * replace (coalesce(nullif(title, ''), array_to_string(list_transform(string_split(replace(filename[:-5], '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) as title) from fresh),
  words as (select album_id, array_to_string(list_sort(list_distinct(list_concat(list_concat({WORDS_SQL.format('album_id::varchar', words_sql('').rsplit('[', 1)[1].rsplit(']', 1)[0])}, {words_sql('title')}), list_concat({words_sql('creator')}, {words_sql('subjects')})))), ', ') as tags from g where reason is null),
  m_tracks as (select album_id, title, filename, duration from old union all select album_id, title, filename, duration from named),
  m_albums as (select g.album_id, g.title, g.creator, g.subjects, null as genres, (select count(*) from fresh f where f.album_id = g.album_id) as n_new from g where reason is null),
  sc as ({album_score_sql("m_albums", "m_tracks", "a.n_new")})"""


def _resolved(spark: SparkSession, sf_dir: str) -> resolve.Resolved:
    text = lambda df: df.withColumn("album_id", F.col("album_id").cast("string"))
    albums = text(view(spark, sf_dir, "albums").select("album_id", "status", "downloads"))
    tracks = text(view(spark, sf_dir, "tracks").where("track_id % 3 = 0").select("track_id", "album_id", "filename", "title", "track_number", "bitrate", "duration", "status", "tags"))
    seen = Observation()
    items = I.scan_item_metadata(spark, written(item_lines(spark, sf_dir), "items"), seen)
    return resolve.resolve_albums(albums, tracks, items, seen)


@query(f"""with {ITEMS_SQL} select a.album_id::varchar as album_id, a.downloads, case when g.album_id is null then a.status when g.reason is null then 'resolved' else 'unavailable' end as status, g.reason as error_message,
    case when ok then g.title end as title, case when ok then g.creator end as creator, case when ok then coalesce(g.collection, '') end as collection, case when ok then coalesce(g.subjects, '') end as subjects,
    case when g.class <> 'unknown' and (ok or starts_with(g.reason, 'excluded')) then g.class when starts_with(g.reason, 'excluded') then 'unknown' end as license, case when ok then 'https://archive.org/services/img/' || g.album_id end as art_url,
    case when ok then m.n_new end as track_count, coalesce(ok, false) as prechecked, sc.score, sc.tier, sc.stream, sc.decision, sc.reasons
    from v_albums a left join (select *, reason is null as ok from g) g on g.album_id = a.album_id left join m_albums m on m.album_id = a.album_id left join sc on sc.album_id = a.album_id""")
def resolve_albums(spark, sf_dir):
    """The album table once the metadata of all waiting albums was taken in."""
    a = _resolved(spark, sf_dir).albums
    told = {"reasons": F.array_join("reasons", "|"), "prechecked": F.coalesce("prechecked", F.lit(False))}
    return a.withColumns(told).select(
        "album_id", "downloads", "status", "error_message", "title", "creator", "collection", "subjects", "license", "art_url", "track_count", "prechecked", "score", "tier", "stream", "decision", "reasons"
    )


@query(f"""with {ITEMS_SQL}, m as (select album_id, filename, title, track_number, bitrate, duration, status, tags, null as format, null as download_url from old
      union all select album_id, filename, title, track_number, bitrate, duration, 'pending', null, 'VBR MP3', 'https://archive.org/download/' || album_id || '/' || replace(filename, ' ', '%20') from named)
    select m.album_id::varchar as album_id, m.filename, m.title, track_number, bitrate, round(duration, 6) as duration, format, download_url, coalesce(w.tags, m.tags) as tags,
    case when g.restricted and m.status = 'pending' then 'unavailable' else m.status end as status, case when g.restricted and m.status = 'pending' then 'access-restricted item' end as error_message
    from m left join g on g.album_id = m.album_id left join words w on w.album_id = m.album_id""")
def resolve_tracks(spark, sf_dir):
    """The track table: new files, tags of whole albums, and pending tracks of restricted albums."""
    t = _resolved(spark, sf_dir).tracks.withColumn("duration", F.round("duration", 6))
    return t.select("album_id", "filename", "title", "track_number", "bitrate", "duration", "format", "download_url", "tags", "status", "error_message")


@query(f"""with {ITEMS_SQL}, l as (select count(*) as lines, count_if(album_id % 50 = 7) as bad_lines from v_albums where album_id in (select album_id from v_tracks)),
    c as (select count(*) as items, count_if(restricted) as restricted, count_if(starts_with(reason, 'non-audio')) as no_music, count_if(starts_with(reason, 'excluded')) as unlicensed, count_if(starts_with(reason, 'no acceptable')) as no_tracks, count_if(reason is null) as resolved from g)
    select unnest(['lines', 'bad_lines', 'items', 'restricted', 'no_music', 'unlicensed', 'no_tracks', 'resolved']) as counter, unnest([lines, bad_lines, items, restricted, no_music, unlicensed, no_tracks, resolved]) as n from l, c""")
def resolve_counters(spark, sf_dir):
    """How many lines and items went which way, counted in the pass that parses them."""
    return spark.createDataFrame(sorted(_resolved(spark, sf_dir).counters.items()), "counter string, n long")


# ---------------------------------------------------------------- spectra

WAVES_SQL = """h as (select i, 0.5 * (1 - cos(2 * pi() * i / 2047)) as h from range(2048) r(i)),
  w as (select 'whole' as kind, k, i % 64 as j, sum(h * cos(2 * pi() * k * i / 2048)) as c, sum(h * sin(2 * pi() * k * i / 2048)) as s from h, range(1024) b(k) group by k, i % 64
        union all select 'burst', k, i, h * cos(2 * pi() * k * i / 2048), h * sin(2 * pi() * k * i / 2048) from h, range(1024) b(k) where i < 64),
  e as (select f.*, unnest(embedding)::double as x, unnest(range(64)) as j from f),
  b as (select track_id, frame_no, k, sum(x * c) * sum(x * c) + sum(x * s) * sum(x * s) as p from e join w on w.kind = e.kind and w.j = e.j group by track_id, frame_no, k),
  o as (select *, sqrt(p) as m, k * 48000 / 2048.0::double as hz, row_number() over (partition by track_id, frame_no order by p) as place from b),
  n as (select *, case when hz > 20 then cast(floor(12 * log2(hz / 440) + 69.5) as bigint) % 12 end as note from o),
  spectra as (select track_id, frame_no, sum(p) >= 1e-20 as has_power, sum(p) - sum(case when place <= 512 then p end) as signal, sum(case when place <= 512 then p end) as noise,
    case when sum(m) > 1e-12 then sum(m * hz) / sum(m) end as centroid, sum(case when note is not null then m end) as chroma from n group by track_id, frame_no),
  pooled as (select track_id, sum(case when has_power then signal end) as signal, sum(case when has_power then noise end) as noise, coalesce(avg(centroid), 0) as centroid from spectra group by track_id),
  q as (select track_id, case when noise is null or noise < 1e-20 then 40 when signal < 1e-20 then 0 else greatest(0, least(40, 10 * log10(signal / noise))) end::double as snr, centroid from pooled)"""
COMPOSITE_SQL = "case when snr < 10 then 0 else least(1, greatest(0, 0.5 * least(1, snr / 40) + 0.3 * least(1, centroid / 8000) + 0.2 * least(1, greatest(0, (crest - 1) / 9)))) end::double"


def _whole_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of 50 frames, each a vector over and over: tracks grow in number and not in length."""
    e = view(spark, sf_dir, "embeddings")
    samples = F.flatten(F.array_repeat("embedding", 32))
    return e.select(F.expr("vec_id div 50").alias("track_id"), (F.col("vec_id") % 50).cast("int").alias("frame_no"), F.lit(48000).alias("sample_rate"), samples.alias("samples"))


WHOLE_SQL = "f as (select vec_id // 50 as track_id, vec_id % 50 as frame_no, 'whole' as kind, embedding from embeddings)"


@query(f"with {WHOLE_SQL}, {WAVES_SQL} select track_id, frame_no, has_power, round(signal, 3) as signal, round(noise, 3) as noise, round(centroid, 3) as centroid, round(chroma, 3) as chroma from spectra")
def frame_spectra(spark, sf_dir):
    s = A.frame_spectra(_whole_tracks(spark, sf_dir)).withColumn("frame_no", F.col("frame_no").cast("long"))
    total = F.aggregate("chroma", F.lit(0.0), lambda t, x: t + x)
    return s.select("track_id", "frame_no", "has_power", *(F.round(c, 3).alias(c) for c in ("signal", "noise", "centroid")), F.round(total, 3).alias("chroma"))


@query(f"""with {WHOLE_SQL}, {WAVES_SQL}, c as (select track_id, max(list_max(list_transform(embedding, lambda x: abs(x::double)))) / sqrt(sum(32 * list_sum(list_transform(embedding, lambda x: x::double * x::double))) / sum(2048)) as crest from f group by track_id)
    select q.track_id, round(snr, 3) as snr, round(centroid, 3) as centroid, round(crest, 6) as crest, round({COMPOSITE_SQL}, 6) as quality, {", ".join(f"round(chroma_{i}, 3) as chroma_{i}" for i in range(12))}
    from q join c on c.track_id = q.track_id join (select track_id, {", ".join(f"sum(case when note = {i} then m end) / count(distinct frame_no) as chroma_{i}" for i in range(12))} from n group by track_id) t on t.track_id = q.track_id""")
def pool_quality(spark, sf_dir):
    """Quality with its parts and the mean of each of the twelve chroma sums, over all frames of a track."""
    f = _whole_tracks(spark, sf_dir)
    q = A.pool_quality(A.frame_spectra(f, seconds=None), A.crest_parts(f))
    chroma = [F.round(F.col("chroma")[i], 3).alias(f"chroma_{i}") for i in range(12)]
    return q.select("track_id", F.round("snr", 3).alias("snr"), F.round("centroid", 3).alias("centroid"), F.round("crest", 6).alias("crest"), F.round("quality", 6).alias("quality"), *chroma)


# ---------------------------------------------------------------- analysis

VIEWS |= {
    "audio_tracks": """
        select cast(p_partkey as bigint) as track_id, cast(p_size as bigint) as album_id, case when p_partkey % 9 = 5 then 'Untitled' when p_partkey % 9 <> 4 then p_name end as title,
               concat(p_name, '.mp3') as filename, cast(case p_partkey % 10 when 0 then 45.5 when 1 then 2000.0 when 2 then 0.0 when 3 then 75.0 else p_retailprice / 8 end as double) as duration,
               cast(p_size * 8 as int) as bitrate, case when p_partkey % 5 > 0 then replace(p_name, ' ', ', ') end as tags, case when p_partkey % 4 = 3 then 'failed' else 'pending' end as status,
               cast(p_partkey % 5 as int) as retry_count
        from {part}""",
    "audio_albums": """
        select distinct cast(p_size as bigint) as album_id, concat('set ', p_size) as title, 'ignored sfx' as creator,
               case p_size % 5 when 0 then 'sound effects' when 1 then 'folk tales' when 2 then 'field recording' end as subjects, case when p_size % 2 = 0 then 'rock' end as genres
        from {part}""",
}


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five frames a track, the last one short; every seventh track is a burst, and every seventh is silence."""
    e = view(spark, sf_dir, "embeddings").withColumn("track_id", F.expr("vec_id div 5 + 1"))
    length = F.when(F.col("vec_id") % 5 == 4, 1000).otherwise(A.FRAME)
    none = F.array_repeat(F.lit(0.0).cast("float"), A.FRAME)
    kind = F.col("track_id") % 7
    samples: Column = F.when(kind == 1, none).when(kind == 0, F.concat("embedding", none)).otherwise(F.flatten(F.array_repeat("embedding", 32)))
    return e.select(
        "track_id", (F.col("vec_id") % 5).cast("int").alias("frame_no"), F.lit(48000).alias("sample_rate"), F.slice(samples, F.lit(1), length).alias("samples"),
        F.slice(F.col("embedding").cast("array<double>"), 1, 20).alias("coef"),
    )


def loudness(heads) -> np.ndarray:
    """A model: the mean size of a head's eighths; no vector for silence."""
    m = np.array([[np.abs(p).mean() for p in np.array_split(np.asarray(h, float), 8)] for h in heads]).reshape(-1, 8)
    m[m.sum(axis=1) == 0] = np.nan
    return m


_T = "(select *, 0.0::double as quality from v_audio_tracks)"
_A = "(select * replace (null as creator) from v_audio_albums)"
ANALYSIS_SQL = f"""f as (select vec_id // 5 + 1 as track_id, vec_id % 5 as frame_no, case (vec_id // 5 + 1) % 7 when 0 then 'burst' when 1 then 'silence' else 'whole' end as kind, embedding from embeddings where vec_id % 5 < 4), {WAVES_SQL},
  a as (select vec_id // 5 + 1 as track_id, vec_id % 5 = 4 as short, (vec_id // 5 + 1) % 7 as kind, list_transform(embedding, lambda x: x::double) as v from embeddings),
  r as (select track_id, case when kind = 1 then 0 else list_max(list_transform(v, lambda x: abs(x))) end as peak, case when short then 1000 else 2048 end as n,
    case when kind = 1 then 0 when kind = 0 then list_sum(list_transform(v, lambda x: x * x)) when short then 15 * list_sum(list_transform(v, lambda x: x * x)) + list_sum(list_transform(v[1:40], lambda x: x * x)) else 32 * list_sum(list_transform(v, lambda x: x * x)) end as squares from a),
  c as (select track_id, case when sqrt(sum(squares) / sum(n)) < 1e-12 then 1 else max(peak) / sqrt(sum(squares) / sum(n)) end as crest from r group by track_id),
  silent as (select distinct track_id, 40::double as snr, 0::double as centroid from f where kind = 'silence'),
  heard as (select x.track_id, snr, centroid, crest, {COMPOSITE_SQL} as composite from (select * from q union all select * from silent) x join c on c.track_id = x.track_id),
  pre as ({score_sql(False, False, "where t.status = 'pending'", _T, _A)}),
  post as ({score_sql(False, False, "where t.status = 'pending'", "(select t.*, h.composite as quality from v_audio_tracks t join heard h on h.track_id = t.track_id)", _A)}),
  way as (select t.*, h.composite, h.snr, h.centroid, h.crest, case when t.status <> 'pending' then 'left' when p.decision = 'exclude' and p.stream = 'excluded' then 'excluded' when h.track_id is null then 'left' when h.composite < 0.3 then 'poor' when t.track_id % 7 = 1 then 'again' else 'done' end as way
    from v_audio_tracks t left join pre p on p.track_id = t.track_id left join heard h on h.track_id = t.track_id)"""


def _analysed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The track table after the job, which moved only what it changed out of the pending partition, and the embeddings."""
    path = scratch(spark, "tracks")
    tables.put(view(spark, sf_dir, "audio_tracks"), path)
    found = analysis.analyze_tracks(tables.waiting(spark, path, "pending", "1"), view(spark, sf_dir, "audio_albums"), _frames(spark, sf_dir), loudness)
    embeddings = tables.materialised(found.embeddings, "embedded")
    tables.move(spark, path, found.tracks, "track_id", "pending", "1")
    return path, embeddings


@query(f"""with {ANALYSIS_SQL} select w.track_id, w.album_id, w.title, round(w.duration, 6) as duration, case way when 'left' then w.status when 'done' then 'completed' when 'again' then case when retry_count >= 3 then 'failed' else 'pending' end else 'unavailable' end as status,
    cast(case when way = 'again' then retry_count + 1 else retry_count end as int) as retry_count, case when way = 'done' then o.score when way = 'excluded' then p.score end as score, case when way = 'done' then o.tier when way = 'excluded' then p.tier end as tier,
    case when way = 'done' then o.stream when way = 'excluded' then p.stream end as stream, case when way = 'done' then o.decision when way = 'excluded' then p.decision end as decision,
    case when way = 'done' then o.reasons when way = 'excluded' then p.reasons end as reasons, case when way in ('done', 'excluded') then 'listenability-v2' end as version,
    case way when 'again' then 'clap: no embedding' when 'poor' then 'low quality: score=' || printf('%.3f', round(composite, 3)) || ' snr=' || printf('%.1f', round(snr, 1)) || ' centroid=' || printf('%.0f', round(centroid, 0)) || ' crest=' || printf('%.1f', round(crest, 1))
      when 'excluded' then x.why end as error_message
    from way w left join pre p on p.track_id = w.track_id left join post o on o.track_id = w.track_id
    left join (select t.track_id, {PRECHECK_REASON_SQL} as why from v_audio_tracks t join pre s on s.track_id = t.track_id) x on x.track_id = w.track_id""")
def analyze_tracks(spark, sf_dir):
    """The whole track table after all pending tracks were analysed."""
    path, _ = _analysed(spark, sf_dir)
    t = tables.rows_of(spark, path)
    return t.withColumns({"reasons": F.array_join("reasons", "|"), "duration": F.round("duration", 6)}).select(
        "track_id", "album_id", "title", "duration", "status", "retry_count", "score", "tier", "stream", "decision", "reasons", "version", "error_message"
    )


@query(f"""with {ANALYSIS_SQL} select track_id, round(composite, 6) as quality_score, 'head' as sample_strategy, 8::int as clap, 40::int as mfcc, 12::int as chroma, 1.0::double as size from way where way = 'done'""")
def analyzed_embeddings(spark, sf_dir):
    """The embeddings of what was completed: lengths of the vectors, and the size of all three together over the root of 3."""
    _, e = _analysed(spark, sf_dir)
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x)
    size = F.sqrt((squares("clap") + squares("mfcc") + squares("chroma")) / 3)
    return e.select("track_id", F.round("quality_score", 6).alias("quality_score"), "sample_strategy", *(F.size(c).alias(c) for c in ("clap", "mfcc", "chroma")), F.round(size, 4).alias("size"))
