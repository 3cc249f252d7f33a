"""Registered queries over the catalogue views, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import listenability as L
from tonearm.functions import metadata as M
from tonearm.functions import text as X
from tonearm.operators import catalog as C
from tonearm.plans.views import oracle, view
from tonearm.sources.tables import materialised

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

LISTENABLE = "(status = 'completed' and coalesce(decision, '') <> 'exclude' and coalesce(stream, '') not in ('excluded', 'longform_candidate'))"


def query(*tables: str, sql: str | None = None):
    """Register a function of DataFrames, named as in ``tables``, under its own name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) for t in tables))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


# ---------------------------------------------------------------- scalar rules over whole tables

WORDS_SQL = r"""list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[_\-\s.,;:!?()\[\]{{}}"''/\\|&]+'), lambda w: strlen(w) > 2 and not list_contains([{1}], w))"""


def words_sql(column: str) -> str:
    return WORDS_SQL.format(column, ", ".join(f"'{w}'" for w in X.STOPWORDS))


@query("tracks", sql=f"select track_id, array_to_string({words_sql('filename')}, ' ') as words from v_tracks")
def extract_words(t):
    return t.select("track_id", F.array_join(X.extract_words(F.col("filename")), " ").alias("words"))


TAGS_SQL = f"array_to_string(list_sort(list_distinct(list_concat(list_concat({words_sql('identifier')}, {words_sql('title')}), list_concat({words_sql('creator')}, list_concat({words_sql('subjects')}, {words_sql('genres')}))))), ', ')"


@query("shelf", sql=f"select album_id, {TAGS_SQL} as tags from v_shelf")
def generate_tags(a):
    return a.select("album_id", X.generate_tags(*(F.col(c) for c in ("identifier", "title", "creator", "subjects", "genres"))).alias("tags"))


RAW_SQL = "case p_size % 4 when 0 then concat(' ', p_name, ' ,', upper(p_type), ',,') when 1 then p_type when 2 then ' , ' end"


@query("part", sql=f"""select p_partkey, coalesce(array_to_string(list_filter(list_transform(string_split(lower({RAW_SQL}), ','), lambda k: trim(k)), lambda k: k <> ''), '|'), '') as keywords from part""")
def split_keywords(p):
    return p.select("p_partkey", F.array_join(X.split_keywords(F.expr(RAW_SQL)), "|").alias("keywords"))


@query("tracks", "albums", sql=f"""
with j as (select track_id, {words_sql("'small hot ring gear the widget'")} as q, coalesce(list_filter(list_transform(string_split(lower(coalesce(t.tags, '')), ', '), lambda x: trim(x)), lambda x: strlen(x) > 2), []) as g,
    {words_sql('a.title')} as b, {words_sql('a.creator')} as c, {words_sql('t.title')} as n from v_tracks t join v_albums a on a.album_id = t.album_id)
select track_id, round(list_sum(list_transform(q, lambda w: case when list_contains(g, w) then 0.40 else 0 end + case when list_contains(b, w) then 0.35 else 0 end
    + case when list_contains(c, w) then 0.15 else 0 end + case when list_contains(n, w) then 0.10 else 0 end))::double / len(q), 6) as pill_score from j""")  # fmt: skip
def pill_score(t, a):
    j = t.alias("t").join(a.alias("a"), "album_id")
    s = X.pill_score(F.lit("small hot ring gear the widget"), F.col("t.title"), F.col("t.tags"), F.col("a.title"), F.col("a.creator"))
    return j.select("track_id", F.round(s, 6).alias("pill_score"))


ERRORS = "case o_orderkey % 8 when 0 then 'stream: EOF' when 1 then 'HTTP 403 timeout' when 2 then 'got 503' when 3 then 'not found' when 4 then 'Connection Reset by peer' when 5 then '401' when 6 then 'I/O timeout' end"


@query("orders", sql=f"""select o_orderkey, coalesce(regexp_matches(lower({ERRORS}), 'stream:|rate limit:|clap:|timeout|connection refused|connection reset|no such host|eof|503|429|502|500|504')
    and not regexp_matches(lower({ERRORS}), '401|403'), false) as transient from orders""")
def is_transient_error(o):
    return o.select("o_orderkey", X.is_transient_error(F.expr(ERRORS)).alias("transient"))


LICENSE_SQL = """case when coalesce(licenseurl, '') = '' then 'unknown'
    when regexp_matches(lower(licenseurl), '^https?://creativecommons\\.org/publicdomain/(zero|mark)/') then 'pd'
    when regexp_matches(lower(licenseurl), '^https?://creativecommons\\.org/licenses/zero/|/cc0/|/cc0$') then 'cc0'
    when regexp_matches(lower(licenseurl), 'publicdomain|public_domain|pdmark|cc-pdm') then 'pd'
    when regexp_matches(lower(licenseurl), '^https?://creativecommons\\.org/licenses/(by|by-sa|by-nc|by-nd|by-nc-sa|by-nc-nd)/')
         then 'cc-' || regexp_extract(lower(licenseurl), 'licenses/(by[a-z-]*)/', 1) else 'other' end"""


@query("albums", sql=f"select album_id, {LICENSE_SQL} as license from v_albums")
def classify_license(a):
    return a.select("album_id", M.classify_license(F.col("licenseurl")).alias("license"))


@query("albums", sql=f"select album_id, downloads, licenseurl from v_albums where {LICENSE_SQL} in ('pd', 'cc0', 'cc-by', 'cc-by-sa')")
def filter_commercial(a):
    return a.where(M.commercially_usable(F.col("licenseurl"))).select("album_id", "downloads", "licenseurl")


LENGTHS = "case l_partkey % 6 when 0 then cast(l_linenumber * 37 as string) when 1 then concat(l_linenumber, ':', l_partkey % 60) when 2 then concat('1:', l_linenumber, ':', l_partkey % 60, '.5') when 3 then 'n/a' when 4 then '' when 5 then concat(l_partkey, '.25 s') end"


@query("lineitem", sql=f"""
with s as (select distinct l_partkey, l_linenumber, {LENGTHS.replace('as string', 'as varchar')} as length from lineitem), p as (select *, string_split(trim(length), ':') as p from s),
n as (select *, list_transform(p, lambda x: try_cast(regexp_extract(x, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1) as double)) as n from p)
select l_partkey, l_linenumber, coalesce(case len(n) when 2 then n[1] * 60 + n[2] when 3 then n[1] * 3600 + n[2] * 60 + n[3] else n[1] end, 0) as seconds from n""")
def parse_duration(li):
    s = li.select("l_partkey", "l_linenumber", F.expr(LENGTHS).alias("length")).distinct()
    return s.select("l_partkey", "l_linenumber", M.parse_duration(F.col("length")).alias("seconds"))


@query("part", sql="""select p_partkey, coalesce(try_cast(regexp_extract(x, '^\\s*([+-]?\\d+)', 1) as int), 0) as bitrate
from (select p_partkey, case p_partkey % 4 when 0 then p_size || ' kbps' when 1 then '' when 2 then 'VBR' else p_size::varchar end as x from part)""")
def parse_bitrate(p):
    return p.select("p_partkey", M.parse_bitrate(F.expr("case p_partkey % 4 when 0 then concat(p_size, ' kbps') when 1 then '' when 2 then 'VBR' else cast(p_size as string) end")).alias("bitrate"))


@query("part", sql="""select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then p_size when 2 then 0 else 0 end as track_number from part""")
def parse_track_number(p):
    return p.select("p_partkey", M.parse_track_number(F.expr("case p_partkey % 4 when 0 then concat(p_size, '/12') when 1 then concat('00', p_size) when 2 then 'x7' end")).cast("int").alias("track_number"))


@query("part", sql="""select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title from part""")
def derive_title(p):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("07 - ")).otherwise(F.lit("track 3_")), F.translate("p_name", " ", "_"), F.lit(".mp3"))
    return p.select("p_partkey", M.derive_title(name).alias("title"))


FORMATS = "case l_partkey % 5 when 0 then '64Kbps MP3' when 1 then 'VBR MP3' when 2 then 'MP3' when 3 then '192Kbps MP3' else 'Ogg Vorbis' end"


@query("tracks", sql="""select track_id, case track_id % 5 when 0 then false when 1 then true when 2 then bitrate >= 192 or bitrate <= 0 when 3 then bitrate >= 192 or bitrate <= 0 else false end as ok from v_tracks""")
def is_acceptable_mp3(t):
    kind = F.expr(FORMATS.replace("l_partkey", "track_id"))
    return t.select("track_id", M.is_acceptable_mp3(kind, F.col("bitrate").cast("string")).alias("ok"))


@query("tracks", sql="""select track_id, 'https://archive.org/download/' || album_id || '/' || replace(filename, ' ', '%20') as download_url, 'https://archive.org/services/img/' || album_id as art_url from v_tracks""")
def download_url(t):
    a = F.col("album_id").cast("string")
    return t.select("track_id", M.download_url(a, F.col("filename")).alias("download_url"), M.art_url(a).alias("art_url"))


@query("albums", sql="""select album_id, coalesce(subjects, '') as subjects, case when subjects is null then 0 when album_id % 2 = 0 then len(string_split(subjects, ', ')) else 1 end as n_subjects, album_id % 3 = 0 as restricted from v_albums""")
def flex_fields(a):
    """Polymorphic JSON: even ids carry an array and ``"true"``, odd ids a string and a boolean."""
    many = F.to_json(F.struct(F.split("subjects", ", ").alias("subject"), F.when(F.col("album_id") % 3 == 0, "true").alias("restricted")))
    one = F.to_json(F.struct(F.col("subjects").alias("subject"), (F.col("album_id") % 3 == 0).alias("restricted")))
    v = a.select("album_id", F.try_parse_json(F.when(F.col("album_id") % 2 == 0, many).otherwise(one)).alias("v"))
    return v.select(
        "album_id", M.flex_to_string(F.col("v"), "$.subject").alias("subjects"),
        F.size(M.flex_to_array(F.col("v"), "$.subject")).alias("n_subjects"), M.flex_bool(F.col("v"), "$.restricted").alias("restricted"),
    )


@query("tracks", sql="select track_id, case when quality > 0.7 then 'high_fidelity' when quality >= 0.3 then 'historical_vintage' else 'unusable' end as tier from v_tracks")
def quality_tier(t):
    return t.select("track_id", L.quality_tier(F.col("quality")).alias("tier"))


@query("lineitem", sql="""select l_orderkey, l_partkey, l_linenumber, l_suppkey, round(case when l_quantity < 10 then 0 else least(1, greatest(0, 0.5 * least(1, l_quantity / 40) + 0.3 * least(1, l_extendedprice / 8000)
    + 0.2 * least(1, greatest(0, (l_tax * 100 - 1) / 9)))) end, 6) as composite from lineitem""")
def composite_quality(li):
    q = L.composite_quality(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax") * 100)
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.round(q, 6).alias("composite"))


@query("tracks", "albums", sql="select track_id, coalesce(nullif(t.title, ''), filename) as name, coalesce(a.title, a.album_id::varchar) as album from v_tracks t join v_albums a using (album_id)")
def friendly_names(t, a):
    j = t.join(a.select("album_id", F.col("title").alias("a_title")), "album_id")
    return j.select("track_id", F.coalesce(F.nullif("title", F.lit("")), "filename").alias("name"), F.coalesce("a_title", F.col("album_id").cast("string")).alias("album"))


# ---------------------------------------------------------------- filters


@query("part", sql="select p_partkey, p_name from part where p_partkey % 9 = 2 or (p_brand not in (select p_brand from part where p_size = 7) and p_partkey % 9 not in (0, 1))")
def filter_denylist(p):
    """Ids: part brands on the list, derived ``..._librivox`` and ``librivox...`` names, and none at all."""
    ids = p.withColumn("identifier", F.expr("case p_partkey % 9 when 0 then concat('x_LibriVox', p_partkey) when 1 then concat('librivox', p_partkey) when 2 then null else p_brand end"))
    denied = p.where("p_size = 7").select(F.col("p_brand").alias("identifier"))
    return C.filter_denylist(ids, denied).select("p_partkey", "p_name")


@query("albums", sql="""select album_id, reason is null as is_music, reason from (select album_id, case when subjects = 'sound effects' then null
    when album_id % 7 = 0 then 'non-audio mediatype: texts' when album_id % 7 = 1 then 'non-music title pattern: "learn french"' when album_id % 7 = 2 then 'librivox creator' end as reason from v_albums where subjects is distinct from 'sound effects')
    union all select album_id, false, 'non-music subject: "Spoken Word"' from v_albums where subjects = 'sound effects'""")
def music_content(a):
    c = F.col
    subjects = F.array(F.when(c("subjects") == "sound effects", "Spoken Word").otherwise(F.coalesce(c("subjects"), F.lit("x"))))
    k = c("album_id") % 7
    reason = M.music_reason(
        subjects, F.array(F.lit("rock")), F.when(k == 0, "texts").otherwise("audio"),
        F.when(k == 1, "Learn French now").otherwise("x"), F.lit(""), F.when(k == 2, "LibriVox volunteers").otherwise(c("creator")),
    )
    return a.select("album_id", reason.isNull().alias("is_music"), reason.alias("reason"))


@query("tracks", sql=f"select track_id from v_tracks where {LISTENABLE}")
def listenable_filter(t):
    return t.where(C.listenable()).select("track_id")


PATTERN = "%WIDGET%"


EMBEDDED_SQL = f"v_tracks t join v_track_embeddings e on e.track_id = t.track_id join v_albums a on a.album_id = t.album_id where {LISTENABLE.replace('status', 't.status')}"


def _second(found: DataFrame, order: list[tuple[str, bool]], skip: int, n: int) -> DataFrame:
    """The page of n rows behind the first one of ``skip``, with the number of all rows, which the first page's scan has counted."""
    head, total = C.first_page(found, order, skip)
    rest = C.page(found, order, n, head[-1]) if len(head) == skip else found.limit(0)
    return rest.withColumn("total", F.lit(total).cast("long"))


@query("tracks", "track_embeddings", "albums", sql=f"""select t.track_id, t.album_id, count(*) over () as total from {EMBEDDED_SQL}
    and (t.title ilike '{PATTERN}' or filename ilike '{PATTERN}' or t.album_id::varchar ilike '{PATTERN}' or a.title ilike '{PATTERN}' or t.tags ilike '{PATTERN}')
    order by t.updated_at desc, t.track_id limit 50 offset 10""")  # fmt: skip
def search_tracks(t, e, a):
    found = C.embedded_tracks(t, e, a).where(C.matches(PATTERN, "title", "filename", "album_id", "a_title", "tags"))
    return _second(found, [("updated_at", True), ("track_id", False)], 10, 50).select("track_id", "album_id", "total")


COUNTS_SQL = """(select album_id, count(*) n, avg(quality_score) q, avg(score) s from v_tracks t left join v_track_embeddings e on e.track_id = t.track_id where t.status = 'completed' group by album_id)"""
ALBUM_COUNTS_SQL = f"left join {COUNTS_SQL} t on t.album_id = a.album_id where a.status = 'resolved'"
ALBUM_COLUMNS_SQL = "a.album_id, title, creator, coalesce(collection, '') as collection, track_count, downloads, coalesce(n, 0) as completed, round(coalesce(q, 0), 6) as avg_quality, round(coalesce(s, 0), 6) as avg_score, count(*) over () as total"


def _albums_told(found: DataFrame) -> DataFrame:
    c = F.coalesce("collection", F.lit("")).alias("collection")
    return found.select("album_id", "title", "creator", c, "track_count", "downloads", "completed", "avg_quality", "avg_score", "total")


@query("shelf", "tracks", "track_embeddings", sql=f"""select {ALBUM_COLUMNS_SQL} from v_shelf a {ALBUM_COUNTS_SQL}
    and (a.album_id::varchar ilike '%12%' or title ilike '%12%' or creator ilike '%12%' or collection ilike '%12%') order by downloads desc, updated_at desc, a.album_id limit 40 offset 5""")
def search_albums(a, t, e):
    found = C.search_albums(a, t, e, "%12%")
    return _albums_told(_second(found, [("downloads", True), ("updated_at", True), ("album_id", False)], 5, 40))


@query("shelf", "tracks", "track_embeddings", sql=f"select {ALBUM_COLUMNS_SQL} from v_shelf a {ALBUM_COUNTS_SQL} and track_count > 0 and track_count = coalesce(n, 0) order by downloads desc, updated_at desc, a.album_id limit 30 offset 5")
def search_completed_albums(a, t, e):
    """Without a pattern; only albums all of whose tracks are completed."""
    found = C.search_albums(a, t, e, None, completed_only=True)
    return _albums_told(_second(found, [("downloads", True), ("updated_at", True), ("album_id", False)], 5, 30))


@query("shelf", "tracks", "track_embeddings", sql=f"""select a.album_id, title, creator, coalesce(collection, '') as collection, track_count, status, coalesce(n, 0) as completed, downloads,
    round(coalesce(q, 0), 6) as avg_quality, round(coalesce(s, 0), 6) as avg_score, coalesce(license, '') as license from v_shelf a left join {COUNTS_SQL} t on t.album_id = a.album_id""")
def album_detail(a, t, e):
    """Every album with what is told of one."""
    told = [F.coalesce(c, F.lit("")).alias(c) if c in ("collection", "license") else c for c in ("album_id", "title", "creator", "collection", "track_count", "status", "completed", "downloads", "avg_quality", "avg_score", "license")]
    return C.with_counts(a, t, e).select(*told)


@query("tracks", sql="select track_id, duration from v_tracks where duration <= 1920")
def short_prefilter(t):
    return t.where(F.col("duration") <= M.MAX_SECONDS).select("track_id", "duration")


@query("shelf", sql=f"""select album_id, case when {LICENSE_SQL} in ('pd', 'cc0', 'cc-by', 'cc-by-sa') then status else 'unavailable' end as status, case when {LICENSE_SQL} not in ('pd', 'cc0', 'cc-by', 'cc-by-sa') then {LICENSE_SQL} else license end as license,
    case when {LICENSE_SQL} not in ('pd', 'cc0', 'cc-by', 'cc-by-sa') then 'excluded: non-free license (' || {LICENSE_SQL} || ')' end as error from v_shelf""")
def license_gate(a):
    """Albums that may not be used commercially become unavailable, for a reason that names the license, which is kept."""
    ok, found = M.commercially_usable(F.col("licenseurl")), M.classify_license(F.col("licenseurl"))
    error = F.when(~ok, F.concat(F.lit("excluded: non-free license ("), found, F.lit(")")))
    return a.select("album_id", F.when(ok, F.col("status")).otherwise("unavailable").alias("status"), F.when(ok, F.col("license")).otherwise(found).alias("license"), error.alias("error"))


@query("tracks", sql="select track_id, case when quality < 0.3 then 'unavailable' else status end as status from v_tracks")
def quality_gate(t):
    return t.select("track_id", F.when(F.col("quality") < 0.3, "unavailable").otherwise(F.col("status")).alias("status"))


KEYWORDS_SQL = "list_filter(list_transform(string_split(lower(keywords), ','), lambda k: trim(k)), lambda k: k <> '')"
PILL_MATCH_SQL = f"""k as (select pill_id, unnest({KEYWORDS_SQL}) as kw from v_pills), m as (select distinct pill_id, t.track_id, t.album_id, t.score, e.quality_score as quality
    from v_tracks t join v_track_embeddings e on e.track_id = t.track_id join v_albums a on a.album_id = t.album_id join k on contains(lower(coalesce(a.subjects, '')), kw) or contains(lower(coalesce(t.tags, '')), kw) where {LISTENABLE.replace('status', 't.status')})"""


@query("pills", "tracks", "track_embeddings", "albums", sql=f"with {PILL_MATCH_SQL} select pill_id, track_id from m")
def pill_match(p, t, e, a):
    return C.pill_matches(p, t, e, a).select("pill_id", "track_id")


# ---------------------------------------------------------------- joins


@query("vtracks", sql="select track_id, title, album_title, len(embedding) as dim from v_vtracks")
def tracks_with_embeddings(v):
    return v.select("track_id", "title", "album_title", F.size("embedding").alias("dim"))


@query("tracks", "track_embeddings", sql="""select album_id, t.track_id, filename, coalesce(title, filename) as title, coalesce(track_number, 0) as track_number, status, round(coalesce(quality_score, 0), 6) as quality, coalesce(score, 0) as score,
    cast(row_number() over (partition by album_id order by track_number nulls first, filename nulls first, t.track_id) as int) as place from v_tracks t left join v_track_embeddings e on e.track_id = t.track_id""")
def album_tracks(t, e):
    """Tracks with their place in their album, which is all the order there is: albums need no sorting among each other."""
    place = F.row_number().over(Window.partitionBy("album_id").orderBy("track_number", "filename", "track_id"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return C.with_embedding(t, e, "left").select(
        "album_id", "track_id", "filename", F.coalesce("title", "filename").alias("title"), F.coalesce("track_number", F.lit(0)).alias("track_number"), "status",
        F.round(zero("quality"), 6).alias("quality"), zero("score").alias("score"), place.alias("place"),
    )


@query("albums", "tracks", sql="select album_id from v_albums a where status in ('resolved', 'unavailable') and coalesce(licenseurl, '') = '' and exists (select 1 from v_tracks t where t.album_id = a.album_id and t.status = 'completed')")
def albums_unlicensed(a, t):
    bare = a.where("status in ('resolved', 'unavailable') and coalesce(licenseurl, '') = ''")
    return bare.join(t.where("status = 'completed'"), "album_id", "left_semi").select("album_id")


UNTAGGED_SQL = "(select t.album_id, count(*) as n from v_tracks t join v_track_embeddings e on e.track_id = t.track_id where t.status = 'completed' and coalesce(t.tags, '') = '' group by t.album_id)"


@query("albums", "tracks", "track_embeddings", sql=f"select a.album_id, u.n as n_untagged from v_albums a join {UNTAGGED_SQL} u on u.album_id = a.album_id where a.status in ('resolved', 'unavailable')")
def albums_untagged(a, t, e):
    return C.albums_untagged(a, t, e).select("album_id", "n_untagged")


@query("albums", sql="select album_id, title from v_albums where status = 'resolved' and coalesce(subjects, '') = ''")
def albums_missing_metadata(a):
    return a.where("status = 'resolved' and coalesce(subjects, '') = ''").select("album_id", "title")


@query("vtracks", "labels", sql="select track_id, title from v_vtracks where track_id in (select doc_id from labels where quality = 1)")
def lookup_by_key(v, labels):
    keys = labels.where("quality = 1").select(F.col("doc_id").alias("track_id"))
    return v.join(keys, "track_id", "left_semi").select("track_id", "title")


# ---------------------------------------------------------------- merges


@query("albums", "orders", sql="select album_id, title from v_albums where album_id % 3 <> 0 union all select o_orderkey, 'new ' || o_orderkey from orders where o_orderkey % 3 = 0")
def insert_or_ignore(a, o):
    new = o.select(F.col("o_orderkey").alias("album_id"), F.concat(F.lit("new "), F.col("o_orderkey")).alias("title"))
    return C.insert_or_ignore(a.where("album_id % 3 <> 0").select("album_id", "title"), new, ["album_id"], ["title"])


@query("albums", "links", sql="""with k as (select * from v_albums where album_id % 3 <> 0), n as (select distinct album_id from v_links where album_id not in (select album_id from k))
    select 'inserted' as part, cast(null as int) as collection_id, album_id from n union all select 'album', null, album_id from k union all select 'album', null, album_id from n union all select 'link', collection_id, album_id from v_links""")
def insert_with_links(a, links):
    """Albums and links of a list of links, where two thirds of the albums and half of the links are known."""
    links = materialised(links, "links")
    albums, all_links, new = C.insert_with_links(a.where("album_id % 3 <> 0").select("album_id"), links.where("album_id % 2 = 0"), links)
    none = F.lit(None).cast("int").alias("collection_id")
    parts = [df.select(F.lit(p).alias("part"), none, "album_id") for p, df in (("inserted", new), ("album", albums))]
    return parts[0].unionByName(parts[1]).unionByName(all_links.select(F.lit("link").alias("part"), "collection_id", "album_id"))


@query("embeddings", sql="""select vec_id, cast(case when vec_id % 10 = 0 then 2 else 1 end as int) as version, round(case when vec_id % 10 = 0 then 1.0 else sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) end, 4) as norm from embeddings""")
def upsert_embeddings(e):
    from tonearm.functions.vectors import l2_normalize, norm

    old = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit(1).alias("version"))
    new = e.where("vec_id % 10 = 0").select("vec_id", l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("v"), F.lit(2).alias("version"))
    return C.upsert(old, new, ["vec_id"]).select("vec_id", "version", F.round(norm(F.col("v")), 4).alias("norm"))


@query("links", sql="select collection_id, album_id from v_links where collection_id >= 5 union all select collection_id, album_id from v_links where collection_id < 5 and album_id % 2 = 0")
def replace_links(links):
    return C.replace_links(links, links.where("collection_id < 5 and album_id % 2 = 0"))


@query("links", sql="select distinct collection_id, album_id from (select collection_id, album_id from v_links where album_id % 2 = 0 union all select (collection_id + 1) % 25, album_id from v_links where album_id % 5 = 0)")
def link_albums(links):
    new = links.where("album_id % 5 = 0").select(((F.col("collection_id") + 1) % 25).cast("int").alias("collection_id"), "album_id")
    return C.insert_or_ignore(links.where("album_id % 2 = 0"), new, ["collection_id", "album_id"], ["album_id"])


@query("links", "collections", sql="""select 'collection' as part, collection_id, cast(null as bigint) as album_id from v_collections where status <> 'failed'
    union all select 'link', collection_id, album_id from v_links where collection_id not in (select collection_id from v_collections where status = 'failed')""")
def remove_collection(links, c):
    """Failed collections go with their links."""
    kept, kept_links = C.remove_collection(c, links, c.where("status = 'failed'"))
    parts = kept.select(F.lit("collection").alias("part"), "collection_id", F.lit(None).cast("bigint").alias("album_id"))
    return parts.unionByName(kept_links.select(F.lit("link").alias("part"), "collection_id", "album_id"))


@query("collections", "albums", "links", sql="""with m as (select * from v_links where collection_id < 10 and (album_id + collection_id) % 3 <> 0), k as (select album_id from v_albums where album_id % 3 <> 0),
    l as (select * from v_links where album_id % 2 = 0 union select * from m), n as (select collection_id, count(*) as n from m group by collection_id)
    select 'collection' as part, c.collection_id, cast(null as bigint) as album_id, case when n.n is not null then 'discovered' else status end as status, n.n as discovered_count from v_collections c left join n on n.collection_id = c.collection_id
    union all select 'link', collection_id, album_id, null, null from l
    union all select 'album', null, album_id, null, null from (select album_id from k union select album_id from m)""")
def sync_list(c, a, links):
    """Members become albums and links, and the list's counters are set to what it was given; nothing is ever removed."""
    members = links.where("collection_id < 10 and (album_id + collection_id) % 3 <> 0")
    return _tables(*C.sync_list(c, a.where("album_id % 3 <> 0").select("album_id"), links.where("album_id % 2 = 0"), members))


def _tables(c: DataFrame, albums: DataFrame, links: DataFrame) -> DataFrame:
    """Three tables as one result."""
    none = {k: F.lit(None).cast(t).alias(k) for k, t in (("collection_id", "int"), ("album_id", "bigint"), ("status", "string"), ("discovered_count", "bigint"))}
    count = F.col("discovered_count").cast("bigint").alias("discovered_count")
    out = c.select(F.lit("collection").alias("part"), "collection_id", none["album_id"], "status", count)
    out = out.unionByName(links.select(F.lit("link").alias("part"), "collection_id", "album_id", none["status"], none["discovered_count"]))
    return out.unionByName(albums.select(F.lit("album").alias("part"), none["collection_id"], "album_id", none["status"], none["discovered_count"]))


@query("collections", "albums", "links", sql=f"""with d as (select l.collection_id, a.album_id from v_links l join v_albums a on a.album_id = l.album_id where {LICENSE_SQL} in ('pd', 'cc0', 'cc-by', 'cc-by-sa') and a.album_id % 9 <> 0),
    k as (select album_id from v_albums where album_id % 4 = 0), l as (select * from v_links where album_id % 2 = 0 union select * from d), n as (select collection_id, count(case when album_id % 4 <> 0 then 1 end) as n from d group by collection_id)
    select 'collection' as part, c.collection_id, cast(null as bigint) as album_id, case when n.n is not null then 'discovered' else status end as status, coalesce(n.n, 0) as discovered_count from v_collections c left join n on n.collection_id = c.collection_id
    union all select 'link', collection_id, album_id, null, null from l
    union all select 'album', null, album_id, null, null from (select album_id from k union select album_id from d)""")
def discover(c, a, links):
    """Item dump, license filter, denylist, and the merge into what is known (every fourth album, every other link)."""
    links = materialised(links, "links")  # the dump, the denylist and the known links are all taken from it
    dump = links.join(a, "album_id").select("collection_id", F.col("album_id").cast("string").alias("identifier"), "album_id", "licenseurl")
    denied = dump.where("album_id % 9 = 0").select("identifier")
    known = a.where("album_id % 4 = 0").select("album_id")
    start = c.withColumn("discovered_count", F.lit(0))
    return _tables(*C.discover(start, known, links.where("album_id % 2 = 0"), dump, denied, M.commercially_usable(F.col("licenseurl")), ("licenseurl",)))


@query("nation", "links", sql="select distinct n_name as list_name from nation where n_nationkey in (select collection_id from v_links) and n_regionkey = 2")
def user_list_names(n, links):
    """Names in ``name:parent`` strings of one parent."""
    s = links.select("collection_id").distinct().join(n, F.col("collection_id") == F.col("n_nationkey"))
    parts = F.split(F.concat_ws(":", "n_name", "n_regionkey"), ":", 2)
    return s.select(parts.alias("p")).where("p[1] = '2'").select(F.col("p")[0].alias("list_name")).distinct()


# ---------------------------------------------------------------- aggregates


COMBINED_SQL = """select * from (select count(*) as albums, count_if(status = 'pending') as albums_pending, count_if(status = 'resolving') as albums_resolving, count_if(status = 'resolved') as albums_resolved, count_if(status = 'failed') as albums_failed, count_if(status = 'unavailable') as albums_unavailable from v_shelf),
    (select count(*) as unlicensed from v_shelf a where status in ('resolved', 'unavailable') and coalesce(license, '') = '' and exists (select 1 from v_tracks t where t.album_id = a.album_id and t.status = 'completed')),
    (select count(*) as tracks, count_if(status = 'pending') as tracks_pending, count_if(status = 'processing') as tracks_processing, count_if(status = 'completed') as tracks_completed, count_if(status = 'failed') as tracks_failed, count_if(status = 'unavailable') as tracks_unavailable,
      coalesce(round(avg(case when status = 'completed' then score end), 6), 0) as avg_score from v_tracks),
    (select count_if(coalesce(tags, '') = '') as untagged, coalesce(round(avg(quality_score), 6), 0) as avg_quality from v_tracks t join v_track_embeddings e on e.track_id = t.track_id where t.status = 'completed')"""


@query("shelf", "tracks", "track_embeddings", sql=COMBINED_SQL)
def combined_stats(a, t, e):
    return C.combined_stats(a, t, e)


@query("collections", "links", "tracks", "pills", sql="select * from (select count(*) as collections from v_collections), (select count(*) as links from v_links), (select count(*) as pills from v_pills), (select count_if(status = 'pending') as pending_tracks, count_if(status = 'completed') as completed_tracks from v_tracks)")
def catalog_counts(c, links, t, p):
    return C.catalog_counts(c, links, t, p)


COLLECTION_STATUS_SQL = "select count(*) as total, count_if(status = 'pending') as pending, count_if(status = 'discovering') as discovering, count_if(status = 'discovered') as discovered, count_if(status = 'failed') as failed from v_collections"


@query("collections", sql=COLLECTION_STATUS_SQL)
def collection_status_stats(c):
    return c.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "discovering", "discovered", "failed")))


@query("links", "shelf", "tracks", sql="""select collection_id, count(t.track_id) as total, count_if(t.status = 'completed') as analysed, coalesce(round(avg(case when t.status = 'completed' then t.score end), 6), 0) as avg_score,
    count_if(t.status = 'completed' and a.license in ('pd', 'cc0', 'cc-by', 'cc-by-sa')) as free, round(count_if(t.status = 'completed' and a.license in ('pd', 'cc0', 'cc-by', 'cc-by-sa')) * 100.0::double / count(*), 6) as free_pct
    from v_links l join v_shelf a on a.album_id = l.album_id join v_tracks t on t.album_id = l.album_id group by collection_id""")  # fmt: skip
def collection_track_stats(links, a, t):
    return C.collection_track_stats(links, a, t)


COVERAGE_OF_SCORES_SQL = """select count(*) as completed, count_if(version = 'listenability-v2') as current, count_if(version is null) as missing, count_if(version <> 'listenability-v2') as stale, count_if(decision = 'exclude') as excluded, count_if(duration > 0 and duration < 60) as short from v_tracks where status = 'completed'"""


@query("tracks", sql=COVERAGE_OF_SCORES_SQL)
def listenability_coverage(t):
    return C.listenability_coverage(t, L.VERSION).drop("by_tier", "by_decision")


@query("tracks", sql="""select 'tier' as kind, tier as name, count(*) as n from v_tracks where status = 'completed' and tier is not null group by tier
    union all select 'decision', decision, count(*) from v_tracks where status = 'completed' and decision is not null group by decision""")
def coverage_by_tier(t):
    """The two maps of the coverage, an entry a row."""
    c = C.listenability_coverage(t, L.VERSION)
    return c.select(F.lit("tier").alias("kind"), F.explode("by_tier").alias("name", "n")).unionByName(c.select(F.lit("decision").alias("kind"), F.explode("by_decision").alias("name", "n")))


LEXICAL_SQL = """with d as (select * from v_tracks where status = 'completed'), j as (select a.album_id, subjects, genres from d join (select * from v_albums where album_id % 8 <> 0) a using (album_id)),
    c as (select (select count_if(coalesce(tags, '') <> '') from d) as tagged, (select count_if(coalesce(tags, '') = '') from d) as untagged, count(distinct case when coalesce(subjects, '') = '' then album_id end) as no_subjects,
    count(distinct case when coalesce(genres, '') = '' then album_id end) as no_genres, count(distinct album_id) as n_albums from j) select *, n_albums - greatest(no_subjects, no_genres) as with_metadata from c"""


@query("tracks", "albums", sql=LEXICAL_SQL)
def lexical_coverage(t, a):
    """Tracks count whether or not the catalogue has their album (here it lacks every eighth)."""
    return C.lexical_coverage(t, a.where("album_id % 8 <> 0"))


@query("track_embeddings", sql="select sample_strategy as strategy, count(*) as n from v_track_embeddings group by sample_strategy")
def strategy_counts(e):
    return e.groupBy(F.col("sample_strategy").alias("strategy")).agg(F.count("*").alias("n"))


@query("tracks", sql="select album_id, round(avg(score), 6) as avg_score, round(avg(case when status = 'completed' then score end), 6) as avg_completed from v_tracks group by album_id")
def album_listenability(t):
    """All albums: the mean score of all their tracks, and of the completed ones."""
    done = F.when(F.col("status") == "completed", F.col("score"))
    return t.groupBy("album_id").agg(F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.avg(done), 6).alias("avg_completed"))


EVIDENCE_SQL = """(select album_id, count(*) as track_count, count(d) as n_positive, coalesce(avg(d), 0) as avg_duration, coalesce(median(d), 0) as median_duration, coalesce(sum(d), 0) as total_duration,
    coalesce(count_if(d < 30)::double / nullif(count(d), 0), 0) as short30, coalesce(count_if(d < 60)::double / nullif(count(d), 0), 0) as short60, coalesce(count_if(d < 90)::double / nullif(count(d), 0), 0) as short90,
    coalesce(bool_or(regexp_matches(lower(title || ' ' || filename), 'ch [1-4]|channel [12]|track [12]')), false) as channel_dump
    from (select *, case when duration > 0 then duration end as d from v_tracks) group by album_id)"""


@query("tracks", sql=f"""select album_id, track_count, n_positive, round(avg_duration, 6) as avg_duration, round(median_duration, 6) as median_duration, round(total_duration, 3) as total_duration,
    round(short30, 6) as short30, round(short60, 6) as short60, round(short90, 6) as short90, channel_dump from {EVIDENCE_SQL}""")
def album_evidence(t):
    e = C.album_evidence(t)
    return e.withColumns({c: F.round(c, n) for c, n in (("avg_duration", 6), ("median_duration", 6), ("total_duration", 3), ("short30", 6), ("short60", 6), ("short90", 6))})


COVERAGE_SQL = f"with {PILL_MATCH_SQL}, n as (select pill_id, count(distinct album_id) as n from m group by pill_id), p as (select p.pill_id, label, sort_order, coalesce(n, 0) as n_albums, enabled and coalesce(n, 0) >= min_library_count as active from v_pills p left join n on n.pill_id = p.pill_id)"


@query("pills", "tracks", "track_embeddings", "albums", sql=f"{COVERAGE_SQL} select pill_id, n_albums from p where n_albums > 0")
def pill_coverage(p, t, e, a):
    return C.pill_coverage(p, t, e, a).where("n_albums > 0").select("pill_id", "n_albums")


@query("pills", "tracks", "track_embeddings", "albums", sql=f"{COVERAGE_SQL} select pill_id, label, n_albums, cast(row_number() over (order by sort_order, pill_id) as int) as rank from p where active")
def active_pills(p, t, e, a):
    return _ranked(C.pill_coverage(p, t, e, a).where("active"), F.col("sort_order"), F.col("pill_id")).select("pill_id", "label", "n_albums", "rank")


@query("pills", "tracks", "track_embeddings", "albums", sql=f"{COVERAGE_SQL} select * from p")
def pills_with_coverage(p, t, e, a):
    return C.pill_coverage(p, t, e, a)


@query("links", "collections", sql="""with c as (select collection_id, case collection_id % 9 when 3 then null when 4 then '' else title end as title from v_collections)
    select album_id, string_agg(coalesce(nullif(title, ''), c.collection_id::varchar), ', ' order by title nulls first, c.collection_id) as names from v_links l join c on c.collection_id = l.collection_id group by album_id""")
def collection_names(links, c):
    """Ids stand for collections without a title (here every ninth, another ninth has an empty one); the order is that of the titles."""
    c = c.select("collection_id", F.expr("case collection_id % 9 when 3 then null when 4 then '' else title end").alias("title"))
    return C.collection_names(links, c)


@query("links", "albums", sql="select collection_id, count(*) as n_links, count_if(status = 'pending') as n_pending from v_links l left join (select * from v_albums where album_id % 8 <> 0) a on a.album_id = l.album_id group by collection_id")
def collection_sizes(links, a):
    """All links count, also those of albums that the catalogue lacks (here every eighth)."""
    j = links.join(a.where("album_id % 8 <> 0").select("album_id", "status"), "album_id", "left")
    return j.groupBy("collection_id").agg(F.count("*").alias("n_links"), F.count_if(F.col("status") == "pending").alias("n_pending"))


# ---------------------------------------------------------------- rankings

RECENCY_SQL = "r as (select album_id, max(created_seq) as rec, max(case when l.collection_id = 7 then 1 else 0 end) as priority from v_links l join v_collections c on c.collection_id = l.collection_id group by album_id)"


@query("albums", "links", "collections", sql=f"with {RECENCY_SQL} select album_id, cast(row_number() over (order by priority desc, rec desc, created_at, album_id) as int) as rank from v_albums join r using (album_id) where status = 'pending' qualify rank <= 100")
def resolve_backlog(a, links, c):
    order = (F.desc("priority"), F.desc("rec"), "created_at", "album_id")
    j = a.where("status = 'pending'").join(C.recency(links, c, 7), "album_id")
    return _ranked(j.orderBy(*order).limit(100), *order).select("album_id", "rank")


@query("tracks", "shelf", "links", "collections", sql=f"""with {RECENCY_SQL}, n as (select album_id, min(title) as name from v_links l join v_collections c on c.collection_id = l.collection_id group by album_id)
select t.track_id, t.album_id, t.filename, t.title, coalesce(a.title, a.identifier) as album_title, coalesce(n.name, '') as collection_name, round(coalesce(t.duration, 0), 4) as duration, coalesce(t.bitrate, 0) as bitrate, coalesce(t.tags, '') as tags,
    coalesce(a.subjects, '') as subjects, coalesce(a.genres, '') as genres, coalesce(a.album_score, 0) as album_score, cast(row_number() over (order by priority desc nulls last, rec desc nulls last, t.track_id) as int) as rank
from v_tracks t join v_shelf a on a.album_id = t.album_id left join r on r.album_id = t.album_id left join n on n.album_id = t.album_id where t.status = 'pending' qualify rank <= 200""")
def analysis_backlog(t, a, links, c):
    """With what the analysis needs to know; of several collections the name is that which is first in the alphabet."""
    return C.analysis_backlog(t, a, links, c, priority=7, n=200)


@query("tracks", "shelf", "track_embeddings", sql="""select t.track_id, t.album_id, coalesce(t.title, '') as title, filename, round(coalesce(duration, 0), 4) as duration, coalesce(bitrate, 0) as bitrate, coalesce(t.tags, '') as tags, coalesce(a.title, '') as album_title,
    coalesce(creator, '') as album_creator, coalesce(subjects, '') as subjects, coalesce(genres, '') as genres, a.album_score, e.track_id is not null as has_embedding
    from v_tracks t join v_shelf a on a.album_id = t.album_id left join v_track_embeddings e on e.track_id = t.track_id
    where t.status = 'completed' and version is distinct from 'listenability-v2' and t.track_id > 1000000 order by t.track_id limit 300""")
def rescore_backlog(t, a, e):
    return C.rescore_backlog(t, a, e, L.VERSION, after=1_000_000, n=300)


@query("pills", "tracks", "track_embeddings", "albums", sql=f"with {PILL_MATCH_SQL} select pill_id, track_id, cast(row_number() over (partition by pill_id order by score desc, quality desc, track_id) as int) as rank from m qualify row_number() over (partition by pill_id order by score desc, quality desc, track_id) <= 20")
def tracks_for_pill(p, t, e, a):
    w = Window.partitionBy("pill_id").orderBy(F.desc("score"), F.desc("quality"), "track_id")
    return C.pill_matches(p, t, e, a).withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("pill_id", "track_id", "rank")


@query("tracks", "track_embeddings", "albums", sql=f"select t.track_id, count(*) over () as total from {EMBEDDED_SQL} order by downloads desc, e.quality_score desc, t.updated_at desc, t.track_id limit 50 offset 50")
def browse_tracks(t, e, a):
    order = [("downloads", True), ("e_quality", True), ("updated_at", True), ("track_id", False)]
    return _second(C.embedded_tracks(t, e, a), order, 50, 50).select("track_id", "total")


@query("shelf", "tracks", "track_embeddings", sql=f"select {ALBUM_COLUMNS_SQL} from v_shelf a {ALBUM_COUNTS_SQL} order by downloads desc, updated_at desc, a.album_id limit 30 offset 30")
def browse_albums(a, t, e):
    """Resolved albums without a pattern, with their counts; the second page."""
    return _albums_told(_second(C.search_albums(a, t, e, None), [("downloads", True), ("updated_at", True), ("album_id", False)], 30, 30))


def _ranked(df: DataFrame, *order) -> DataFrame:
    """Rows of a small table with their place in an order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


@query("collections", sql="select collection_id, title, cast(row_number() over (order by created_seq desc, collection_id) as int) as rank from v_collections")
def list_collections(c):
    """Newest first; collections are few."""
    return _ranked(c, F.desc("created_seq"), F.col("collection_id")).select("collection_id", "title", "rank")


@query("collections", sql="select collection_id, expected_count, cast(row_number() over (order by expected_count, collection_id) as int) as rank from v_collections where status in ('pending', 'discovering')")
def pending_collections(c):
    """Those that wait and those begun, smallest first."""
    return _ranked(c.where("status in ('pending', 'discovering')"), F.col("expected_count"), F.col("collection_id")).select("collection_id", "expected_count", "rank")


@query("activity", sql="select event_id, type from v_activity order by ts desc, event_id desc limit 100")
def latest_events(e):
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "type")
