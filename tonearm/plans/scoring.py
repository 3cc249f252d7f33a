"""Registered queries: scoring, vectors, transitions and observation, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions import listenability as L
from tonearm.functions import metadata as M
from tonearm.functions import text as X
from tonearm.functions import vectors as V
from tonearm.operators import analysis
from tonearm.operators import catalog as C
from tonearm.operators import search as S
from tonearm.plans.catalog import COMBINED_SQL, EVIDENCE_SQL, LICENSE_SQL, TAGS_SQL, UNTAGGED_SQL, words_sql
from tonearm.plans.views import QUERY_TEXT, oracle, view
from tonearm.streaming import rates as R
from tonearm.streaming.state import backlog, remaining_time

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) for t in tables))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


# ---------------------------------------------------------------- listenability

AVG_CURVE = "case when {0} <= 0 then 0.0 when {0} < 30 then 0.1 when {0} < 60 then 0.1 + ({0} - 30) / 30 * 0.2 when {0} <= 90 then 0.3 + ({0} - 60) / 30 * 0.4 when {0} <= 1800 then 0.7 + ({0} - 90) / 1710 * 0.3 else 1.0 end::double"
DURATION = "case when duration < 60 then 0.0 when duration < 90 then 0.65 + (duration - 60) / 30 * 0.25 when duration <= 1800 then 1.0 when duration <= 2700 then 0.75 - (duration - 1800) / 900 * 0.75 else 0.0 end::double"
META = "lower(coalesce({0}title, '') || ' ' || coalesce({0}creator, '') || ' ' || coalesce({0}subjects, '') || ' ' || coalesce({0}genres, ''))"
NAMES = "lower(coalesce(t.title, '') || ' ' || coalesce(t.filename, ''))"
PATTERNS = f"""list_filter([case when regexp_matches({NAMES}, 'ch [1-5]|channel [12]|track [12]') then 'channel_dump_title_pattern' end, case when regexp_matches({NAMES}, 'test ?tone') then 'test_tone_pattern' end,
    case when contains({NAMES}, 'sine') and contains({NAMES}, 'hz') then 'sine_wave_pattern' end, case when contains({NAMES}, 'silence') then 'silence_pattern' end, case when contains({NAMES}, 'noise') and not contains({NAMES}, 'noisy') then 'noise_pattern' end], lambda x: x is not null)"""
BAD = "regexp_matches({0}, 'audiobook|spoken word|language instruction|sound effect|sfx|test tone|silence|noise')"
SEMI = "regexp_matches({0}, 'field recording|environmental sound|applause|crowd noise')"
STORY = "(" + " + ".join(f"contains({{0}}, '{w}')::int" for w in L.STORY) + ") >= 2"
HYGIENE = "greatest(0, 1.0::double - case when coalesce(t.title, '') = '' then 0.15 else 0 end - case when coalesce(t.filename, '') = '' then 0.1 else 0 end - case when coalesce(t.tags, '') = '' then 0.05 else 0 end - case when t.bitrate > 0 and t.bitrate < 64 then 0.1 else 0 end - case when t.bitrate > 0 and t.bitrate < 32 then 0.15 else 0 end - case when contains(lower(coalesce(t.title, '')), 'untitled') then 0.1 else 0 end)::double"
PROMPTS_SQL = "(select track_id, (track_id % 7 - 3) / 20.0::double as margin, (track_id % 7) / 20.0::double as positive, 3 / 20.0::double as negative, 'silence or test tone' as strongest from v_tracks where track_id % 5 < 3)"


def score_sql(evidence: bool, prompts: bool, where: str = "", tracks: str = "v_tracks", albums: str = "v_albums") -> str:
    e = EVIDENCE_SQL if evidence else "(select null::bigint as album_id, 0 as n_positive, 0.0 as avg_duration, 0.0 as short60 where false)"
    p = PROMPTS_SQL if prompts else "(select null::bigint as track_id, 0.0::double as margin, 0.0::double as positive, 0.0::double as negative, '' as strongest where false)"
    return f"""with j as (select t.track_id, t.album_id, coalesce(t.duration, 0) as duration, coalesce(e.n_positive, 0) as n_positive, coalesce(e.avg_duration, 0)::double as avg_duration, coalesce(e.short60, 0)::double as short60,
        coalesce(p.margin, 0) as margin, coalesce(p.positive, 0) as positive, coalesce(p.negative, 0) as negative, p.strongest, {META.format('a.')} as meta, {PATTERNS} as patterns, {HYGIENE} as hygiene, least(1.0::double, coalesce(t.quality, 0)) as q
      from {tracks} t left join {albums} a on a.album_id = t.album_id left join {e} e on e.album_id = t.album_id left join {p} p on p.track_id = t.track_id {where}),
    c as (select *, {BAD.format('meta')} as bad, {SEMI.format('meta')} as half, {STORY.format('meta')} as tells, {DURATION} as dur, case when n_positive > 0 then greatest(0.0, {AVG_CURVE.format('avg_duration')} * (1 - short60)) else 0.0 end as shape from j),
    d as (select *, case when positive = 0 and negative = 0 then greatest(0.0, 0.5::double - case when bad then 0.3 else 0 end - case when half then 0.15 else 0 end - 0.2 * len(patterns))::double
        when margin > 0 then 0.5 + least(0.5, margin * 1.5) else 0.5 - least(0.5, -margin * 1.5) end as content from c),
    s as (select *, case when duration <= 0 then 0 else round((dur * 0.30::double + shape * 0.25::double + content * 0.25::double + q * 0.15::double + hygiene * 0.05::double) * 10000) / 10000 end as score from d),
    r as (select *, case when duration < 60 or duration > 2700 then 'excluded' when duration > 1800 and score >= 0.25 then 'longform_candidate' when duration > 1800 or bad or tells then 'excluded' when score >= 0.25 then 'default' else 'excluded' end as stream,
        case when duration < 60 or duration > 2700 then 'exclude' when duration > 1800 and score >= 0.25 then 'demote' when duration > 1800 or bad or tells then 'exclude' when score >= 0.5 then 'include' when score >= 0.25 then 'demote' else 'exclude' end as decision,
        array_to_string(list_filter(list_concat(list_concat([case when duration <= 0 then 'duration_zero_or_missing' when duration < 60 then 'duration_below_60s' when duration < 90 then 'duration_below_90s' when duration > 2700 then 'duration_above_45m' when duration > 1800 then 'longform_candidate' end,
            case when duration <= 0 then 'no_audio_url' else 'has_audio_url' end], patterns), [case when short60 >= 0.8 then 'album_short60_ratio_above_80pct' end, case when n_positive > 0 and avg_duration < 30 then 'album_avg_duration_below_30s' end,
            case when margin < 0 then 'negative_prompt_dominant' end, case when margin < 0 then 'strongest_negative_' || strongest end, case when bad then 'non_music_metadata' end, case when half then 'semi_non_music_metadata' end]), lambda x: x is not null), '|') as reasons from s)
    select track_id, score, case when score >= 0.85 then 'excellent' when score >= 0.7 then 'good' when score >= 0.5 then 'borderline' when score >= 0.25 then 'poor' else 'unusable' end as tier, stream, decision, reasons from r"""


def _prompts(t: DataFrame) -> DataFrame:
    k = F.col("track_id") % 7
    return t.where("track_id % 5 < 3").select("track_id", ((k - 3) / 20).alias("margin"), (k / 20).alias("positive"), F.lit(0.15).alias("negative"), F.lit("silence or test tone").alias("strongest"))


#: When changes are made.
THEN = "timestamp_ntz '2000-01-01 00:00:00'"


def _told(s: DataFrame) -> DataFrame:
    return s.select("track_id", "score", "tier", "stream", "decision", F.array_join("reasons", "|").alias("reasons"))


@query("tracks", "albums", sql=score_sql(True, True))
def score_tracks(t, a):
    return _told(C.score_tracks(t.drop("score", "stream", "decision", "version"), a, C.album_evidence(t), _prompts(t)))


@query("tracks", "albums", sql=score_sql(False, False, "where t.status = 'pending'"))
def precheck_tracks(t, a):
    """Pending tracks from metadata alone: no album shape, no prompts, no quality."""
    pending = t.where("status = 'pending'").drop("score", "stream", "decision", "version")
    return _told(C.score_tracks(pending, a))


EMBEDDED = "(select t.* replace (e.quality_score as quality) from v_tracks t left join v_track_embeddings e on e.track_id = t.track_id)"
RESCORED_SQL = score_sql(True, True, "where t.status = 'completed' and t.version is distinct from 'listenability-v2'", EMBEDDED)


@query("tracks", "albums", "track_embeddings", sql=RESCORED_SQL)
def rescore_stale(t, a, e):
    """Only tracks with a missing or older version are scored; the evidence is that of whole albums."""
    return _told(C.rescore(t, a, e, _prompts(t), L.VERSION))


PRECHECK_REASON_SQL = """case when t.duration > 0 and t.duration < 60 then 'listenability: duration ' || printf('%.1f', round(t.duration, 1)) || 's below 60s minimum'
    else 'listenability: excluded by precheck (score=' || printf('%.3f', round(s.score, 3)) || ', reasons=[' || replace(s.reasons, '|', ' ') || '])' end"""


@query("tracks", "albums", sql=f"""with s as ({score_sql(False, False, "where t.status = 'pending'", "(select * replace (0.0::double as quality) from v_tracks)", "(select * replace (null as creator) from v_albums)")})
    select t.track_id, case when s.decision = 'exclude' then 'unavailable' else t.status end as status, case when s.decision = 'exclude' then {PRECHECK_REASON_SQL} end as error_message from v_tracks t left join s on s.track_id = t.track_id""")
def precheck_status(t, a):
    """What the precheck does to the table: excluded tracks are unavailable, with the reasons."""
    return analysis.precheck_tracks(t, a).select("track_id", "status", "error_message")


@query("tracks", "albums", "track_embeddings", sql=f"""with s as ({RESCORED_SQL}) select t.track_id, case when s.decision = 'exclude' then 'unavailable' else t.status end as status,
    case when s.decision = 'exclude' then 'listenability: exclude decision (score=' || s.score::decimal(10, 4)::decimal(10, 3)::varchar || ' tier=' || s.tier || ')' end as error_message, coalesce(s.score, t.score) as score, coalesce(s.tier, t.tier) as tier,
    coalesce(s.stream, t.stream) as stream, coalesce(s.decision, t.decision) as decision, case when s.track_id is not null then 'listenability-v2' else t.version end as version, s.reasons,
    case when s.track_id is not null then timestamp '2000-01-01' end as checked_at, cast(case when s.decision = 'exclude' then timestamp '2000-01-01' else t.updated_at end as timestamp) as updated_at
    from v_tracks t left join s on s.track_id = t.track_id""")
def rescore_merge(t, a, e):
    """What rescoring does to the table: new scores with all they tell, and excluded tracks unavailable."""
    scores = C.rescore(t, a, e, _prompts(t), L.VERSION)
    done = C.merge_scores(t, scores, mark=True, now=F.expr(THEN)).withColumn("reasons", F.array_join("reasons", "|"))
    return _stamped(done, "track_id", "status", "error_message", "score", "tier", "stream", "decision", "version", "reasons", "checked_at")


def album_score_sql(albums: str = "v_albums", tracks: str = "v_tracks", count: str = "e.track_count") -> str:
    return f"""with j as (select a.album_id, e.* exclude (album_id, track_count), {count} as track_count, {META.format('a.')} as meta from {albums} a join {EVIDENCE_SQL.replace('v_tracks', tracks)} e on e.album_id = a.album_id),
    c as (select *, {BAD.format('meta')} as bad, track_count >= 5 and avg_duration < 15 and short60 >= 0.8 as tiny, case when n_positive > 0 then {AVG_CURVE.format('avg_duration')} * (1 - short60) else 0.0 end as shape from j),
    o as (select *, case when tiny and channel_dump then greatest(shape, 0.25) when tiny then 0.0 else shape end as s1 from c),
    w as (select *, case when avg_duration < 30 then least(s1, 0.2) else s1 end as s2 from o), s as (select *, round((case when short60 >= 0.8 then least(s2, 0.3) else s2 end) * 10000) / 10000 as score from w)
    select album_id, score, case when score >= 0.85 then 'excellent' when score >= 0.7 then 'good' when score >= 0.5 then 'borderline' when score >= 0.25 then 'poor' else 'unusable' end as tier,
    case when bad then 'excluded' when tiny and channel_dump then 'longform_candidate' when tiny then 'excluded' when score >= 0.25 then 'default' else 'excluded' end as stream,
    case when bad then 'exclude' when tiny and channel_dump then 'demote' when tiny then 'exclude' when score >= 0.5 then 'include' when score >= 0.25 then 'demote' else 'exclude' end as decision,
    array_to_string(list_filter([case when tiny then 'album_avg_duration_below_15s' end, case when tiny then 'album_short60_ratio_above_80pct' end, case when avg_duration < 30 then 'album_avg_duration_below_30s' end, case when short60 >= 0.8 then 'album_short60_ratio_above_80pct' end], lambda x: x is not null), '|') as reasons from s"""


@query("albums", "tracks", sql=album_score_sql())
def score_albums(a, t):
    return C.score_albums(a, C.album_evidence(t)).withColumn("reasons", F.array_join("reasons", "|"))


@query("tracks", sql=f"select track_id, round({DURATION}, 6) as duration_score, round({AVG_CURVE.format('duration')}, 6) as avg_curve from v_tracks")
def duration_score(t):
    d = F.col("duration")
    return t.select("track_id", F.round(L.duration_score(d), 6).alias("duration_score"), F.round(L.album_avg_duration_score(d), 6).alias("avg_curve"))


@query("tracks", sql=f"select track_id, round({HYGIENE}, 6) as hygiene from v_tracks t")
def metadata_hygiene(t):
    return t.select("track_id", F.round(L.metadata_hygiene(*(F.col(c) for c in ("title", "filename", "tags", "bitrate"))), 6).alias("hygiene"))


@query("albums", sql=f"select album_id, {BAD.format(META.format(''))} as non_music, {SEMI.format(META.format(''))} as semi, {STORY.format(META.format(''))} as story from v_albums")
def metadata_flags(a):
    m = [F.col(c) for c in ("title", "creator", "subjects", "genres")]
    return a.select("album_id", L.non_music(*m).alias("non_music"), L.semi_non_music(*m).alias("semi"), L.story(*m).alias("story"))


@query("tracks", sql=f"select track_id, array_to_string({PATTERNS}, '|') as patterns from v_tracks t")
def title_patterns(t):
    return t.select("track_id", F.array_join(L.title_patterns(F.col("title"), F.col("filename")), "|").alias("patterns"))


@query("tracks", sql="select track_id, case when score >= 0.85 then 'excellent' when score >= 0.7 then 'good' when score >= 0.5 then 'borderline' when score >= 0.25 then 'poor' else 'unusable' end as tier from v_tracks")
def tier(t):
    return t.select("track_id", L.tier(F.col("score")).alias("tier"))


@query("tracks", sql="""with p as (select *, track_id % 9 - 4 as k from v_tracks) select track_id, round(case when k = 0 then 0.5::double when k > 0 then 0.5 + least(0.5, k / 10.0::double * 1.5) else 0.5 - least(0.5, -k / 10.0::double * 1.5) end, 6) as content from p""")
def content_score(t):
    k = F.col("track_id") % 9 - 4
    s = F.when(k == 0, 0.0).otherwise(0.2)
    c = L.content_score(s, s, k / 10, F.lit(False), F.lit(False), F.array().cast("array<string>"))
    return t.select("track_id", F.round(c, 6).alias("content"))


@query("tracks", "albums", sql=f"with q as ({score_sql(True, True)}) select track_id, len(string_split(reasons, '|')) as n_reasons, string_split(reasons, '|')[1] as first_reason from q")
def score_details(t, a):
    """Reasons as written to a table (JSON) and read back."""
    s = C.score_tracks(t.drop("score", "stream", "decision", "version"), a, C.album_evidence(t), _prompts(t))
    stored = s.select("track_id", F.to_json("reasons").alias("reasons"), F.to_json("components").alias("components"))
    read = stored.select("track_id", F.from_json("reasons", "array<string>").alias("r"), F.from_json("components", "map<string,double>").alias("c"))
    return read.where(F.map_contains_key("c", "duration")).select("track_id", F.size("r").alias("n_reasons"), F.col("r")[0].alias("first_reason"))


# ---------------------------------------------------------------- vectors


@query("embeddings", sql="select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as norm, 1.0::double as unit from embeddings")
def l2_normalize(e):
    v = F.col("embedding")
    return e.select("vec_id", F.round(V.norm(v), 4).alias("norm"), F.round(V.norm(V.l2_normalize(v)), 6).alias("unit"))


PAIR_SQL = "(select a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2]::double)) as dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


@query("embeddings", sql=f"select vec_id, round(dot, 6) as dot, round(1 - greatest(-1, least(1, dot)), 4) as distance from {PAIR_SQL}")
def dot_product(e):
    other = e.select(F.col("vec_id").alias("o"), F.col("embedding").alias("w"))
    j = e.withColumn("o", F.col("vec_id") + 1).join(other, "o")
    v, w = F.col("embedding"), F.col("w")
    return j.select("vec_id", F.round(V.dot_product(v, w), 6).alias("dot"), F.round(V.cosine_distance(v, w), 4).alias("distance"))


@query("embeddings", sql=f"select vec_id, round(1 - greatest(-1, least(1, -dot)), 4) as distance from {PAIR_SQL}")
def cosine_distance(e):
    """Against the next vector turned about and stretched, which changes the sign of the cosine alone."""
    other = e.select(F.col("vec_id").alias("o"), F.transform("embedding", lambda x: x * -7).alias("w"))
    j = e.withColumn("o", F.col("vec_id") + 1).join(other, "o")
    return j.select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.col("w")), 4).alias("distance"))


VLISTEN = "(coalesce(decision, '') <> 'exclude' and coalesce(stream, '') not in ('excluded', 'longform_candidate'))"
FUSED_SQL = "list_concat(list_concat(list_transform(embedding[1:48], lambda x: x::double * 0.6), list_transform(embedding[49:60], lambda x: x::double * 0.25)), list_transform(embedding[61:64], lambda x: x::double * 0.15))"


@query("embeddings", sql=f"select vec_id, unnest(generate_series(0, 63))::int as place, round(unnest({FUSED_SQL}), 6) + 0.0::double as x from embeddings")
def fuse_features(e):
    return e.select("vec_id", F.posexplode(S.fused(F.col("embedding"))).alias("place", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query("vtracks", sql=f"""with f as (select track_id, {FUSED_SQL} as f, {VLISTEN} as ok from v_vtracks), n as (select *, sqrt(list_sum(list_transform(f, lambda x: x * x))) as n from f),
    d as (select a.track_id as seed, b.track_id, 1 - greatest(-1, least(1, list_sum(list_transform(list_zip(a.f, b.f), lambda p: p[1] * p[2])) / (a.n * b.n))) as distance from n a join n b on a.track_id <> b.track_id and b.ok where a.track_id % 50 = 0)
    select seed, track_id, cast(row_number() over (partition by seed order by round(distance, 9), track_id) as int) as rank, round(round(distance, 9), 6) as distance from d qualify row_number() over (partition by seed order by round(distance, 9), track_id) <= 10""")  # fmt: skip
def similar_tracks(v):
    ok = C.listenable()
    return S.similar_tracks(v.select("track_id", "embedding", ok.alias("ok")), F.col("track_id") % 50 == 0, 10)


TEXT_SCORE_SQL = f"""(list_sum(list_transform(q, lambda w: case when list_contains(g, w) then 0.40 else 0 end + case when list_contains(b, w) then 0.35 else 0 end + case when list_contains(c, w) then 0.15 else 0 end + case when list_contains(n, w) then 0.10 else 0 end))::double / len(q))"""


@query("vtracks", "embeddings", sql=f"""with p as (select embedding[1:48] as p from embeddings where vec_id = 0), t as (select track_id, embedding[1:48] as e, p.p, {words_sql(f"'{QUERY_TEXT}'")} as q,
      list_filter(string_split(tags, ', '), lambda x: strlen(x) > 2) as g, {words_sql('album_title')} as b, {words_sql('creator')} as c, {words_sql('title')} as n from v_vtracks, p where {VLISTEN})
    select track_id, round(0.5 * list_sum(list_transform(list_zip(e, p), lambda x: x[1]::double * x[2]::double)) / sqrt(list_sum(list_transform(p, lambda x: x::double * x::double))) + 0.5 * {TEXT_SCORE_SQL}, 6) as score from t order by score desc, track_id limit 20""")  # fmt: skip
def search_by_text(v, e):
    prompt = e.where("vec_id = 0").select(F.slice("embedding", 1, 48).alias("prompt"), F.lit(QUERY_TEXT).alias("query"))
    return S.search_by_text(v.where(C.listenable()), prompt, 20)


@query("vtracks", "embeddings", "pills", sql=f"""with k as (select pill_id, p.keywords, e.embedding[1:48] as p from v_pills p join embeddings e on e.vec_id = p.pill_id where enabled),
    t as (select pill_id, track_id, embedding[1:48] as e, k.p, {words_sql('keywords')} as q, list_filter(string_split(tags, ', '), lambda x: strlen(x) > 2) as g, {words_sql('album_title')} as b, {words_sql('creator')} as c, {words_sql('title')} as n from v_vtracks, k where {VLISTEN}),
    s as (select pill_id, track_id, round(0.5 * list_sum(list_transform(list_zip(e, p), lambda x: x[1]::double * x[2]::double)) / sqrt(list_sum(list_transform(p, lambda x: x::double * x::double))) + 0.5 * {TEXT_SCORE_SQL}, 6) as score from t)
    select pill_id, track_id, cast(row_number() over (partition by pill_id order by score desc, track_id) as int) as rank, score from s qualify row_number() over (partition by pill_id order by score desc, track_id) <= 10""")  # fmt: skip
def pill_feed(v, e, p):
    prompts = p.where("enabled").join(e.select(F.col("vec_id").alias("pill_id"), F.slice("embedding", 1, 48).alias("prompt")), "pill_id")
    return S.pill_feed(v.where(C.listenable()), prompts.select("pill_id", "prompt", F.col("keywords").alias("query")), 10)


@query("vtracks", "embeddings", sql="""with p as (select vec_id, embedding[1:48] as p from embeddings where vec_id <= 10), d as (select track_id, vec_id, list_sum(list_transform(list_zip(embedding[1:48], p), lambda x: x[1]::double * x[2]::double)) as dot from v_vtracks, p),
    s as (select track_id, sum(case when vec_id < 4 then dot end) / 4 as pos, sum(case when vec_id >= 4 then dot end) / 7 as neg, max(case when vec_id >= 4 then dot end) as most, arg_max(vec_id, dot) filter (where vec_id >= 4) as which from d group by track_id)
    select track_id, round(pos, 6) as positive, round(neg, 6) as negative, round(pos - neg, 6) as margin, case when most > 0 then which end as strongest from s""")  # fmt: skip
def prompt_evidence(v, e):
    prompts = e.where("vec_id <= 10").select(F.col("vec_id").alias("prompt_id"), F.slice("embedding", 1, 48).alias("prompt"), (F.col("vec_id") < 4).alias("positive"))
    return S.prompt_evidence(v.select("track_id", F.slice("embedding", 1, 48).alias("clap")), prompts)


@query("vtracks", "embeddings", sql="""with p as (select vec_id as prompt_id, embedding[1:48] as p from embeddings where vec_id <= 8), d as (select prompt_id, track_id, genres, strategy, tags, round(list_sum(list_transform(list_zip(embedding[1:48], p), lambda x: x[1]::double * x[2]::double))
      / sqrt(list_sum(list_transform(p, lambda x: x::double * x::double))) / sqrt(list_sum(list_transform(embedding[1:48], lambda x: x::double * x::double))), 4) as score from (select *, creator as genres, case when track_id % 2 = 0 then 'head' else 'tail' end as strategy from v_vtracks), p)
    select prompt_id, track_id, genres, strategy, strlen(tags) as tags_bytes, cast(row_number() over (partition by prompt_id order by score desc, track_id) as int) as rank, score from d qualify row_number() over (partition by prompt_id order by score desc, track_id) <= 10""")  # fmt: skip
def eval_retrieval(v, e):
    prompts = e.where("vec_id <= 8").select(F.col("vec_id").alias("prompt_id"), F.slice("embedding", 1, 48).alias("prompt"))
    t = v.where("status = 'completed'").select(
        "track_id", F.slice("embedding", 1, 48).alias("clap"), F.col("creator").alias("genres"), F.when(F.col("track_id") % 2 == 0, "head").otherwise("tail").alias("strategy"), F.octet_length("tags").cast("long").alias("tags_bytes")
    )
    return S.eval_retrieval(t, prompts, 10)


# ---------------------------------------------------------------- transitions


@query("tracks", sql="""select track_id, case when track_id % 4 = 0 then 'processing' else status end as status, case when track_id % 4 = 0 then 'by worker ' || (track_id % 5) end as error_message,
    cast(case when track_id % 8 = 0 then 7 else retry_count end as int) as retry_count, cast(case when track_id % 4 = 0 then timestamp '2000-01-01' else updated_at end as timestamp) as updated_at from v_tracks""")
def apply_status(t):
    """Each key stands twice in the change set; errors, counters and times are set along."""
    error, tries = F.concat(F.lit("by worker "), F.col("track_id") % 5), F.when(F.col("track_id") % 8 == 0, 7)
    one = t.where("track_id % 4 = 0").select("track_id", F.lit("processing").alias("status"), error.alias("error_message"), tries.alias("retry_count"))
    done = C.apply_status(t, one.unionByName(one), "track_id", F.expr("timestamp_ntz '2000-01-01 00:00:00'"))
    return done.select("track_id", "status", "error_message", "retry_count", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


def _then_sql(hit: str) -> str:
    return f"cast(case when {hit} then timestamp '2000-01-01' else updated_at end as timestamp) as updated_at"


def _stamped(done, *columns: str):
    return done.select(*columns, F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("tracks", sql=f"""select track_id, case when track_id % 3 <> 0 then status when retry_count >= 3 then 'failed' else 'pending' end as status, cast(retry_count + case when track_id % 3 = 0 then 1 else 0 end as int) as retry_count,
    case when track_id % 3 = 0 then 'HTTP 503 ' || track_id end as error_message, {_then_sql("track_id % 3 = 0")} from v_tracks""")
def requeue_for_retry(t):
    failed = t.where("track_id % 3 = 0").select("track_id", F.concat(F.lit("HTTP 503 "), F.col("track_id")).alias("error_message"))
    return _stamped(C.requeue(t, failed, "track_id", now=F.expr(THEN)), "track_id", "status", "retry_count", "error_message")


@query("shelf", sql=f"""select album_id, case when album_id % 3 <> 0 then status when retry_count >= 3 then 'failed' else 'pending' end as status, cast(retry_count + case when album_id % 3 = 0 and retry_count < 3 then 1 else 0 end as int) as retry_count,
    case when album_id % 3 = 0 then 'EOF ' || album_id end as error_message, {_then_sql("album_id % 3 = 0")} from v_shelf""")
def requeue_albums(a):
    failed = a.where("album_id % 3 = 0").select("album_id", F.concat(F.lit("EOF "), F.col("album_id")).alias("error_message"))
    return _stamped(C.requeue(a, failed, "album_id", count_failures=False, now=F.expr(THEN)), "album_id", "status", "retry_count", "error_message")


@query("tracks", sql=f"select track_id, case when track_id % 6 = 0 and updated_at < timestamp '1995-06-01' then 'pending' when track_id % 6 = 0 then 'processing' else status end as status, {_then_sql("track_id % 6 = 0 and updated_at < timestamp '1995-06-01'")} from v_tracks")
def reset_stuck(t):
    busy = t.withColumn("status", F.when(F.col("track_id") % 6 == 0, "processing").otherwise(F.col("status")))
    return _stamped(C.reset_stuck(busy, "processing", F.expr("timestamp_ntz '1995-06-01 00:00:00'"), F.expr(THEN)), "track_id", "status")


@query("shelf", sql=f"""with x as (select *, album_id % 6 = 0 and updated_at < timestamp '1995-06-01' as stuck from v_shelf)
    select album_id, case when stuck then 'pending' when album_id % 6 = 0 then 'resolving' else status end as status, cast(case when stuck then 0 else retry_count end as int) as retry_count,
    case when stuck then 'stuck resolving (reset)' end as error_message, {_then_sql("stuck")} from x""")
def reset_stuck_albums(a):
    """Albums also tell why they wait again, and start untried."""
    busy = a.withColumn("status", F.when(F.col("album_id") % 6 == 0, "resolving").otherwise(F.col("status")))
    done = C.reset_stuck(busy, "resolving", F.expr("timestamp_ntz '1995-06-01 00:00:00'"), F.expr(THEN), why="stuck resolving (reset)")
    return _stamped(done, "album_id", "status", "retry_count", "error_message")


@query("tracks", "shelf", sql=f"""select 'track' as part, track_id as id, case when status = 'failed' then 'pending' else status end as status, cast(case when status = 'failed' then 0 else retry_count end as int) as retry_count,
    case when status <> 'failed' then 'was ' || status end as error_message, {_then_sql("status = 'failed'")} from v_tracks
    union all select 'album', album_id, case when down then 'pending' else status end, cast(case when down then 0 else retry_count end as int), case when not down then 'was ' || status end, {_then_sql("down")} from (select *, status = 'unavailable' and album_id % 2 = 1 as down from v_shelf)""")
def reset_failed(t, a):
    """Tracks and albums; every other unavailable album has failed here."""
    a = a.withColumn("status", F.when(F.expr("status = 'unavailable' and album_id % 2 = 1"), "failed").otherwise(F.col("status")))
    parts = []
    for part, df, key in (("track", t, "track_id"), ("album", a, "album_id")):
        done = C.reset_failed(df.withColumn("error_message", F.concat(F.lit("was "), F.col("status"))), F.expr(THEN))
        parts.append(_stamped(done.select(F.lit(part).alias("part"), F.col(key).alias("id"), "status", "retry_count", "error_message", "updated_at"), "part", "id", "status", "retry_count", "error_message"))
    return parts[0].unionByName(parts[1])


CASCADE_SQL = """j as (select t.track_id, t.album_id, t.status, t.updated_at, coalesce(a.status = 'unavailable', false) as gone, coalesce(t.track_id % 50 = 0, false) as named from v_tracks t left join v_albums a on a.album_id = t.album_id)"""


def _cascaded(t, a):
    named = t.where("track_id % 50 = 0").select("track_id", F.lit("failed").alias("status"), F.lit("decoder").alias("error_message"))
    why = F.when(F.col("status") == "unavailable", F.concat(F.lit("album "), F.col("album_id"), F.lit(" is gone")))
    return C.cascade_album(t, a.withColumn("error_message", why), named, F.expr(THEN))


@query("tracks", "albums", sql=f"""with {CASCADE_SQL}
    select track_id, case when named then 'failed' when gone and status = 'pending' then 'unavailable' else status end as status, case when named then 'decoder' when gone and status = 'pending' then 'album ' || album_id || ' is gone' end as error_message,
    gone and not named and status = 'pending' as cascaded, gone and not named and status <> 'pending' as stayed, {_then_sql("named or (gone and status = 'pending')")} from j""")
def cascade_album(t, a):
    return _stamped(_cascaded(t, a), "track_id", "status", "error_message", "cascaded", "stayed")


@query("tracks", "albums", sql=f"with {CASCADE_SQL} select album_id, count(*) as skipped from j where gone and not named and status = 'pending' group by album_id")
def cascade_counts(t, a):
    """What the report of a cascade tells: how many pending tracks each album took along."""
    return C.cascade_counts(_cascaded(t, a))


@query("tracks", "track_embeddings", sql="""with o as (select track_id from v_track_embeddings where sample_strategy <> 'head'), x as (select *, status = 'completed' and track_id in (select track_id from o) as hit from v_tracks)
    select track_id, case when hit then 'pending' else status end as status, case when not hit then 'was ' || status end as error_message, cast(case when hit then 0 else retry_count end as int) as retry_count from x""")
def reset_for_reembedding(t, e):
    t = t.withColumn("error_message", F.concat(F.lit("was "), F.col("status")))
    return C.reset_for_reembedding(t, e, "head").select("track_id", "status", "error_message", "retry_count")


@query("tracks", sql="""with x as (select * replace (case when status = 'failed' then 'unavailable' else status end as status), case when status <> 'failed' then null when track_id % 2 = 0 then 'listenability: excluded' else 'decode: EOF' end as error_message from v_tracks),
    y as (select *, coalesce(status = 'completed' and version = 'listenability-v1', false) as aged, coalesce(status = 'unavailable' and error_message like 'listenability:%', false) as back from x)
    select track_id, case when back then 'completed' else status end as status, case when not back and not aged then version end as version, case when not back then decision end as decision, case when not back then stream end as stream,
    case when not back then tier end as tier, case when not back then error_message end as error_message, cast(case when back or aged then timestamp '2000-01-01' else updated_at end as timestamp) as updated_at from y""")
def reset_score_version(t):
    """Completed tracks of the old version lose it, and tracks that scoring made unavailable are completed again, unscored."""
    error = F.when(F.col("status") == "failed", F.when(F.col("track_id") % 2 == 0, "listenability: excluded").otherwise("decode: EOF"))
    x = t.withColumn("error_message", error).withColumn("status", F.when(F.col("status") == "failed", "unavailable").otherwise(F.col("status")))
    done = C.reset_score_version(x, "listenability-v1", F.expr("timestamp_ntz '2000-01-01 00:00:00'"))
    return done.select("track_id", "status", "version", "decision", "stream", "tier", "error_message", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("albums", "tracks", sql="select album_id, coalesce(album_id in (select album_id from v_tracks where status = 'completed'), false) as prechecked, 'unset' as curator from v_albums")
def evolve_schema(a, t):
    done = t.where("status = 'completed'").select("album_id").distinct().withColumn("prechecked", F.lit(True))
    wider = C.evolve_schema(a.join(done, "album_id", "left"), {"curator": F.lit("unset")})
    return wider.select("album_id", F.coalesce("prechecked", F.lit(False)).alias("prechecked"), "curator")


@query("collections", sql="select collection_id, 'pending' as status, cast(0 as int) as discovered_count, '' as last_cursor, cast(null as varchar) as error_message, timestamp '2000-01-01' as updated_at from v_collections")
def reset_collections(c):
    begun = c.withColumns({"last_cursor": F.concat(F.lit("page "), F.col("collection_id")), "error_message": F.when(F.col("status") == "failed", "HTTP 500")})
    return C.reset_collections(begun, F.expr(THEN)).select("collection_id", "status", "discovered_count", "last_cursor", "error_message", "updated_at")


@query("albums", sql=f"""select album_id, case when album_id % 2 = 0 then 'live' else subjects end as subjects, case when album_id % 4 = 0 then 'folk' else genres end as genres,
    case when album_id % 2 = 0 then {LICENSE_SQL} end as license, case when album_id % 2 = 0 then 'a, b' end as tags, cast(case when album_id % 6 = 0 then 0.5 end as double) as score from v_albums""")
def update_annotations(a):
    """Tags, subjects, genres, license and score of every other album, each where it is given."""
    new = a.where("album_id % 2 = 0").select(
        "album_id", F.lit("live").alias("subjects"), F.when(F.col("album_id") % 4 == 0, "folk").alias("genres"), M.classify_license(F.col("licenseurl")).alias("license"),
        F.lit("a, b").alias("tags"), F.when(F.col("album_id") % 6 == 0, 0.5).alias("score"),
    )
    return C.update_annotations(a, new, "album_id").select("album_id", "subjects", "genres", "license", "tags", "score")


@query("tracks", "shelf", "track_embeddings", sql=f"""with u as (select a.album_id, {TAGS_SQL} as new from v_shelf a join {UNTAGGED_SQL} u on u.album_id = a.album_id where a.status in ('resolved', 'unavailable'))
    select track_id, case when coalesce(u.new, '') <> '' then u.new else t.tags end as tags from v_tracks t left join u on u.album_id = t.album_id""")
def tag_enhance(t, a, e):
    """The tracks after their untagged albums' words were written to them."""
    return C.tag_enhance(t, a, e, "identifier").select("track_id", "tags")


@query("shelf", "tracks", sql=f"""with w as (select album_id from v_shelf a where status in ('resolved', 'unavailable') and coalesce(license, '') = '' and exists (select 1 from v_tracks t where t.album_id = a.album_id and t.status = 'completed'))
    select album_id, case when album_id in (select album_id from w) and album_id % 7 <> 0 then {LICENSE_SQL} else license end as license from v_shelf""")
def license_enrich(a, t):
    """The albums after the metadata (which lack every seventh) gave licenses to those without."""
    return C.license_enrich(a, t, a.where("album_id % 7 <> 0").select("album_id", "licenseurl")).select("album_id", "license")


# ---------------------------------------------------------------- observation: batch twins of the streams


@query("activity", sql="""select w as window_start, type, count(*) as n, round(count(*) / greatest(1, epoch(w + interval 5 minute) - epoch(min(ts))), 6) as rate
    from (select *, unnest(generate_series(time_bucket(interval 1 minute, ts) - interval 4 minute, time_bucket(interval 1 minute, ts), interval 1 minute)) as w from v_activity) group by w, type""")
def completion_rates(e):
    return R.completion_rates(e)


@query("activity", sql="""select w as window_start, round(sum(value) / 300, 6) as bytes_per_second, round(least(100, sum(value) / 300 * 100 / 1048576), 6) as pct_of_limit
    from (select *, unnest(generate_series(time_bucket(interval 1 minute, ts) - interval 4 minute, time_bucket(interval 1 minute, ts), interval 1 minute)) as w from v_activity where type = 'bytes') group by w""")
def bandwidth(e):
    return R.bandwidth(e)


@query("activity", sql="""with s as (select time_bucket(interval 1 hour, ts) as w, coalesce(sum(case when type = 'api_call' then value end), 0) as n, coalesce(sum(case when type = 'analyzer' then value end), 0) as m, coalesce(sum(case when type = 'resolver' then value end), 0) as p from v_activity group by 1)
    select w as window_start, round(n * 100 / nullif(n + m + p, 0), 4) as network, round(m * 100 / nullif(n + m + p, 0), 4) as embed, round(p * 100 / nullif(n + m + p, 0), 4) as processing from s""")
def time_breakdown(e):
    return R.time_breakdown(e)


def staged(activity: DataFrame) -> DataFrame:
    """The activity with completions of all four stages: two of three calls stand for tags and licenses."""
    k = F.col("event_id") % 3
    kind = F.when((F.col("type") == "api_call") & (k == 0), "enhancer").when((F.col("type") == "api_call") & (k == 1), "license").otherwise(F.col("type"))
    return activity.withColumn("type", kind)


ETA_SQL = f"""with stats as ({COMBINED_SQL}), b as (select 'resolver' as stage, albums_pending as waiting, albums_resolving as in_flight from stats union all select 'analyzer', tracks_pending, tracks_processing from stats
      union all select 'enhancer', untagged, 0 from stats union all select 'license', unlicensed, 0 from stats),
    e as (select ts, case when type = 'api_call' and event_id % 3 = 0 then 'enhancer' when type = 'api_call' and event_id % 3 = 1 then 'license' else type end as type from v_activity),
    w as (select *, unnest(generate_series(time_bucket(interval 1 minute, ts) - interval 4 minute, time_bucket(interval 1 minute, ts), interval 1 minute)) as w from e),
    g as (select w.w, b.stage, b.waiting, b.in_flight, count(case when w.type = b.stage then 1 end) as n, min(case when w.type = b.stage then ts end) as first from w, b group by w.w, b.stage, b.waiting, b.in_flight),
    r as (select *, case when n > 0 then n / greatest(1.0::double, epoch_us(w + interval 5 minute) / 1e6::double - epoch_us(first) / 1e6::double) else 0 end as rate from g)
    select w as window_start, stage, case when rate > 0 and waiting > 0 then 'running' when waiting = 0 and in_flight = 0 then 'done' else 'unknown' end as state,
    cast(case when rate > 0 and waiting > 0 then floor((waiting + in_flight) / rate) end as bigint) as seconds from r"""


@query("activity", "shelf", "tracks", "track_embeddings", sql=ETA_SQL)
def eta(e, a, t, emb):
    """Remaining time of the four stages, in batch."""
    return remaining_time(staged(e), backlog(C.combined_stats(a, t, emb)))


@query("activity", sql="select time_bucket(interval 1 second, ts) as window_start, item_id, count(*) as n from v_activity where type = 'analyzer' group by 1, 2")
def batch_progress(e):
    return R.batch_progress(e)


@query("activity", sql="select item_id, arg_max(type, struct_pack(a := ts, b := event_id)) as status, max(ts) as ts from v_activity group by item_id")
def status_fold(e):
    return R.status_fold(e)
