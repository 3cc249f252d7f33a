"""Registered queries of readers, writers, audio jobs and streams, over data that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.listenability import VERSION as LISTENABILITY
from tonearm.functions.metadata import commercially_usable
from tonearm.operators import audio as A
from tonearm.operators import catalog as C
from tonearm.plans import catalog
from tonearm.plans.catalog import COMBINED_SQL
from tonearm.plans.scoring import ORACLES as SCORED
from tonearm.plans.scoring import ETA_SQL as SCORED_ETA
from tonearm.plans.scoring import staged
from tonearm.plans.views import VIEWS, oracle, view
from tonearm.sources import items as I
from tonearm.sources.scratch import scratch
from tonearm.sources.tables import materialised
from tonearm.streaming import rates as R
from tonearm.streaming import state as S

#: SQL of catalogue statistics, without their views.
CATALOG_SQL = {"combined_stats": COMBINED_SQL, "lexical_coverage": catalog.LEXICAL_SQL, "collection_status_stats": catalog.COLLECTION_STATUS_SQL, "listenability_coverage": catalog.COVERAGE_OF_SCORES_SQL}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def written(df: DataFrame, what: str) -> str:
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "lz4").text(path)  # lines of JSON: mostly names that recur
    return path


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metadata as JSON lines: a field is a string or an array by turns, and every 50th line is broken."""
    a, t = view(spark, sf_dir, "albums"), view(spark, sf_dir, "tracks")
    files = t.groupBy("album_id").agg(F.sort_array(F.collect_list(F.struct(  # the tracks of one album
        F.col("filename").alias("name"), F.when(F.col("track_id") % 5 == 0, "Ogg Vorbis").otherwise("VBR MP3").alias("format"),
        "title", F.col("track_number").cast("string").alias("track"), F.col("bitrate").cast("string").alias("bitrate"),
        F.col("duration").cast("string").alias("length"),
    ))).alias("files"))
    meta = lambda subject, restricted: F.struct(
        F.col("album_id").cast("string").alias("identifier"), "title", "creator", subject.alias("subject"), "licenseurl",
        restricted.alias("access-restricted-item"), F.when(F.col("album_id") % 11 == 3, "texts").otherwise("audio").alias("mediatype"),
        F.when(F.col("album_id") % 4 == 0, "Radio 12").when(F.col("album_id") % 4 == 1, "netlabels").alias("collection"),
    )
    j = a.join(files, "album_id")
    r = F.col("album_id") % 20 == 0
    one = F.to_json(F.struct(meta(F.col("subjects"), r).alias("metadata"), "files"))
    many = F.to_json(F.struct(meta(F.split("subjects", ", "), F.when(r, "true")).alias("metadata"), "files"))
    line = F.when(F.col("album_id") % 50 == 7, "{broken").when(F.col("album_id") % 2 == 0, many).otherwise(one)
    return j.select(line.alias("value"))


PAGE = 500


def pages(items: DataFrame) -> DataFrame:
    """Items (album_id, identifier, downloads, licenseurl) as JSON pages of PAGE ids each: pages grow in number, not in length."""
    page = items.groupBy(F.floor(F.col("album_id") / PAGE).alias("p")).agg(F.collect_list(F.struct("identifier", "downloads", "licenseurl")).alias("items"))
    return page.select(F.to_json(F.struct("items")).alias("value"))


@query("select album_id::varchar as identifier, downloads from v_albums")
def scan_item_dump(spark, sf_dir):
    a = view(spark, sf_dir, "albums").select("album_id", F.col("album_id").cast("string").alias("identifier"), "downloads", "licenseurl")
    return I.scan_item_dump(spark, written(pages(a), "dump")).select("identifier", "downloads")


@query("""with j as (select album_id, album_id % 50 = 7 as bad, a.subjects, a.genres from v_albums a where album_id in (select album_id from v_tracks))
    select count(*) as n_lines, count_if(bad) as n_bad, count_if(not bad) as n_items, count(distinct case when not bad then album_id end) as n_ids, sum(case when not bad then (select count(*) from v_tracks t where t.album_id = j.album_id) end)::bigint as n_files,
    sum(case when bad or subjects is null then 0 else len(string_split(subjects, ', ')) end)::bigint as n_subjects from j""")
def scan_item_metadata(spark, sf_dir):
    """What is read of whole items; bad lines are counted in the same pass."""
    from pyspark.sql import Observation

    seen = Observation()
    items = materialised(I.plain_items(I.scan_item_metadata(spark, written(item_lines(spark, sf_dir), "items"), seen)), "items")
    subjects = F.flatten(F.transform("subjects", lambda x: F.split(x, ", ")))
    n = items.agg(F.count("*").alias("n_items"), F.count_distinct("album_id").alias("n_ids"), F.sum(F.size("files")).alias("n_files"), F.sum(F.size(subjects)).alias("n_subjects"))
    return n.select(F.lit(seen.get["lines"]).alias("n_lines"), F.lit(seen.get["bad_lines"]).alias("n_bad"), "*")


@query("select title as list_name, l.album_id::varchar as identifier from v_links l join v_collections c on c.collection_id = l.collection_id where c.collection_id % 5 <> 0")
def scan_list_members(spark, sf_dir):
    links, c = view(spark, sf_dir, "links"), view(spark, sf_dir, "collections")
    part = F.expr("abs(hash(album_id)) % 64")  # lists are written in parts
    m = links.groupBy("collection_id", part.alias("p")).agg(F.collect_list(F.struct(F.col("album_id").cast("string").alias("identifier"))).alias("members"))
    whole = m.join(c, "collection_id").select(F.to_json(F.struct((F.col("collection_id") % 5 != 0).alias("success"), F.struct(F.col("title").alias("list_name"), "members").alias("value"))).alias("value"))
    return I.scan_list_members(spark, written(whole, "lists")).select("list_name", "identifier")


@query("""with m as (select '@' || n_nationkey || '-' || lower(replace(n_name, ' ', '-')) as collection_id, case when n_nationkey % 3 = 0 then 'List of ' || n_regionkey else n_name end as title, album_id::varchar as identifier, album_id % 3 <> 0 as known from v_links join nation on n_nationkey = collection_id)
    select 'collection' as part, collection_id, title, null as identifier, count(distinct identifier) as discovered_count from m group by collection_id, title
    union all select 'link', collection_id, null, identifier, null from m group by collection_id, identifier
    union all select 'album', null, null, identifier, null from m where not known group by identifier""")
def import_list(spark, sf_dir):
    """Collections, links and new albums of imported lists; every third list comes with a title."""
    links, n = view(spark, sf_dir, "links"), view(spark, sf_dir, "nation")
    m = links.join(n, F.col("collection_id") == F.col("n_nationkey"))
    given = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("List of "), "n_regionkey")).otherwise("")
    m = m.select(F.col("n_nationkey").cast("string").alias("list_id"), F.col("n_name").alias("list_name"), F.col("album_id").cast("string").alias("identifier"), given.alias("given"))
    known = view(spark, sf_dir, "albums").where("album_id % 3 <> 0").select(F.col("album_id").cast("string").alias("identifier"))
    rows, more, new = I.import_list(m, known, F.col("given"))
    out = rows.select(F.lit("collection").alias("part"), "*")
    for part, df in (("link", more), ("album", new)):
        out = out.unionByName(df.select(F.lit(part).alias("part"), "*"), allowMissingColumns=True)
    return out.select("part", "collection_id", "title", "identifier", "discovered_count")


@query("select p_brand || ' \"' || p_partkey || '\"' as identifier from part where p_size % 7 = 0")
def scan_denylist(spark, sf_dir):
    """One id a line, in files that each hold an array; a file that is no array of strings gives none."""
    p = view(spark, sf_dir, "part").where("p_size % 7 = 0").withColumn("q", F.to_json(F.array(F.concat("p_brand", F.lit(' "'), "p_partkey", F.lit('"')))))
    path = written(p.select(F.col("q").alias("value")), "denied")
    p.limit(1).select(F.lit('{"no": "array"}').alias("value")).write.mode("append").text(path)
    return I.scan_denylist(spark, path)


SEED_SQL = """select 'pill' as kind, p_brand || '-' || p_partkey as id, p_name as label, upper(replace(p_name, ' ', ' , ')) as words, p_size % 3 <> 0 as enabled, cast(case when p_size % 4 = 0 then 5 else 10 end as int) as least from part where p_partkey % 5 > 0 and p_partkey % 2 = 1
    union all select 'pill', p_brand || '-' || p_partkey, 'tuned', null, false, 1 from part where p_partkey % 2 = 0
    union all select 'collection', 'part-' || p_partkey, p_name, p_type, null, p_size from part where p_partkey % 5 > 0"""


@query(SEED_SQL)
def scan_seed_tables(spark, sf_dir):
    """Seeds with their defaults: pills beside tuned ones, which stay, and collections into an empty table."""
    p = view(spark, sf_dir, "part")
    some = p.where("p_partkey % 5 > 0").withColumn("file", F.floor(F.col("p_partkey") / 100))
    ident = F.concat("p_brand", F.lit("-"), "p_partkey").alias("id")
    pill = F.struct(
        ident, F.col("p_name").alias("label"), F.upper(F.replace("p_name", F.lit(" "), F.lit(" , "))).alias("keywords"),
        F.when(F.col("p_size") % 3 == 0, False).alias("enabled"), F.when(F.col("p_size") % 4 == 0, 5).alias("min_library_count"),
    )
    collection = F.struct(F.concat(F.lit("part-"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_size").alias("item_count"))
    files = []
    for row, name in ((pill, "pills"), (collection, "collections")):
        path = scratch(spark, name)
        arrays = some.groupBy("file").agg(F.to_json(F.collect_list(row)).alias("value"))  # a hundred to an array
        arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
        files.append(path)
    tuned = p.where("p_partkey % 2 = 0").select(ident, F.lit("tuned").alias("label"), F.lit(None).cast("string").alias("keywords"), F.lit(False).alias("enabled"), F.lit(1).alias("min_library_count"))
    pills = I.seed(tuned, I.scan_seed_pills(spark, files[0]), "id")
    again = I.seed(pills, pills.limit(0), "id", only_if_empty=True)
    seeds = I.scan_seed_collections(spark, files[1])
    found = I.seed(seeds.limit(0), seeds, "collection_id", only_if_empty=True)
    of = lambda kind, *c: (F.lit(kind).alias("kind"), *(F.col(x).alias(n) for x, n in zip(c, ("id", "label", "words", "enabled", "least"), strict=True)))
    told = again.select(*of("pill", "id", "label", "keywords", "enabled", "min_library_count"))
    return told.unionByName(found.withColumn("none", F.lit(None).cast("boolean")).select(*of("collection", "collection_id", "title", "category", "none", "expected_count")))


#: Rows of a bucket, at most.
BUCKET_ROWS = 1_000_000


def buckets(rows: int) -> int:
    """How many buckets so many rows take: they grow in number, not in length."""
    return max(8, -(-rows // BUCKET_ROWS))


@query("""select collection_id, count(*) as n, round(avg(score), 6) as score, count(e.track_id) as embedded from v_tracks t join v_links l on l.album_id = t.album_id left join v_track_embeddings e on e.track_id = t.track_id group by collection_id""")
def bucketed_catalog(spark, sf_dir):
    """Tracks and embeddings in buckets of tracks, albums' tracks and links in buckets of albums: joins on them need no exchange."""
    unique, n = scratch(spark, "b").rsplit("-", 1)[1], buckets(view(spark, sf_dir, "lineitem").count())
    put = lambda df, name, key: I.write_bucketed(df, f"{name}_{unique}", scratch(spark, name), key, n)
    t = put(view(spark, sf_dir, "tracks").select("track_id", "album_id", "score"), "tracks", "track_id")
    e = put(view(spark, sf_dir, "track_embeddings").select("track_id", F.lit(1).alias("has")), "embeddings", "track_id")
    by_album = put(t.join(e.hint("merge"), "track_id", "left"), "album_tracks", "album_id")
    links = put(view(spark, sf_dir, "links"), "links", "album_id")
    sums = by_album.groupBy("album_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.count("score").alias("k"), F.count("has").alias("e"))
    g = links.hint("merge").join(sums, "album_id").groupBy("collection_id").agg(*(F.sum(c).alias(c) for c in ("n", "s", "k", "e")))
    return g.select("collection_id", "n", F.round(F.col("s") / F.col("k"), 6).alias("score"), F.col("e").alias("embedded"))


@query("select status, count(*) as n from v_tracks group by status")
def write_catalog(spark, sf_dir):
    path = scratch(spark, "catalog")
    I.write_catalog(view(spark, sf_dir, "tracks"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""with c as ({CATALOG_SQL['combined_stats']}), l as ({CATALOG_SQL['lexical_coverage']}), k as ({CATALOG_SQL['collection_status_stats']}), v as ({CATALOG_SQL['listenability_coverage']})
    select c.*, l.tagged, l.with_metadata, k.total as collections, k.failed as collections_failed, v.completed, v.stale, v.short, (select count(*) from v_track_embeddings) as embeddings,
    (select count(*) from v_track_embeddings where sample_strategy = 'head') as head, (select count(*) from v_tracks where status = 'completed' and tier = 'good') as good, (select count(*) from v_tracks where status = 'completed' and decision = 'exclude') as exclude from c, l, k, v""")
def write_stats_json(spark, sf_dir):
    """All statistics of the catalogue as one JSON document, read again."""
    path = scratch(spark, "stats")
    a, t, e, c = (view(spark, sf_dir, n) for n in ("shelf", "tracks", "track_embeddings", "collections"))
    strategies = e.groupBy("sample_strategy").agg(F.count("*").alias("n"))
    strategies = strategies.agg(F.sum("n").alias("count"), F.map_from_entries(F.collect_list(F.struct("sample_strategy", "n"))).alias("strategies"))  # a handful
    listen = C.listenability_coverage(t, LISTENABILITY)
    I.write_stats_json({
        "catalog": C.combined_stats(a, t, e), "lexical": catalog.QUERIES["lexical_coverage"](spark, sf_dir), "collections": catalog.QUERIES["collection_status_stats"](spark, sf_dir),
        "embeddings": strategies, "listenability": listen,
    }, path)
    s = spark.read.json(path)
    found = s.select("catalog.*", "lexical.tagged", "lexical.with_metadata", F.col("collections.total").alias("collections"), F.col("collections.failed").alias("collections_failed"),
                     "listenability.completed", "listenability.stale", "listenability.short", F.col("embeddings.count").alias("embeddings"),
                     F.col("embeddings.strategies.head").alias("head"), F.col("listenability.by_tier.good").alias("good"), F.col("listenability.by_decision.exclude").alias("exclude"))
    return found


@query(f"select prompt_id, rank, track_id, score, genres, strategy from ({SCORED['eval_retrieval']})")
def write_eval_report(spark, sf_dir):
    from tonearm.plans.scoring import QUERIES as scored

    path = scratch(spark, "report")
    I.write_eval_report(scored["eval_retrieval"](spark, sf_dir), path)
    r = spark.read.json(path)
    r = r.select("prompt_id", F.explode("results").alias("r"))
    return r.select("prompt_id", F.col("r.rank").cast("int").alias("rank"), "r.track_id", "r.score", "r.genres", "r.strategy")


# ---------------------------------------------------------------- audio: a vector repeated is a frame


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "embeddings")
    samples = F.flatten(F.array_repeat("embedding", 32))
    return e.select((F.col("vec_id") % 50).alias("track_id"), F.floor(F.col("vec_id") / 50).cast("int").alias("frame_no"), F.lit(48000).alias("sample_rate"), samples.alias("samples"))


@query("""select vec_id % 50 as track_id, vec_id // 50 as frame_no, round(list_max(list_transform(embedding, lambda x: abs(x::double))), 6) as peak, round(32 * list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as squares, 2048::int as n from embeddings""")
def crest_parts(spark, sf_dir):
    f = _frames(spark, sf_dir)
    c = A.crest_parts(f.withColumn("track_id", F.struct("track_id", "frame_no")))
    return c.select("track_id.*", F.round("peak", 6).alias("peak"), F.round("squares", 4).alias("squares"), "n").withColumn("frame_no", F.col("frame_no").cast("long"))


@query("""with c as (select vec_id % 50 as track_id, unnest(embedding[1:20]) as x, generate_subscripts(embedding[1:20], 1) as i from embeddings), s as (select track_id, i, avg(x::double) as m, stddev_pop(x::double) as s from c group by 1, 2)
    select track_id, 40::int as dim, round(sum(case when i = 1 then m end), 6) as first, round(sum(case when i = 20 then s end), 6) as last from s group by track_id""")
def pool_coefficients(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings")
    p = A.pool_coefficients(e.select((F.col("vec_id") % 50).alias("track_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 20).alias("coef")))
    return p.select("track_id", F.size("mfcc").alias("dim"), F.round(F.col("mfcc")[0], 6).alias("first"), F.round(F.col("mfcc")[39], 6).alias("last"))


@query("select vec_id, 128::int as n_bytes, true as close from embeddings")
def store_vectors(spark, sf_dir):
    """To half floats and back; no value moves by more than a half float's step."""
    e = view(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("embedding").alias("blob"))
    b = A.store_vectors(e, "blob").withColumn("n_bytes", F.octet_length("blob"))
    back = A.load_vectors(b, "blob")
    far = F.exists(F.zip_with("embedding", "blob", lambda x, y: F.abs(x - y)), lambda d: d > 0.001)
    return back.select("vec_id", "n_bytes", (~far).alias("close"))


def _letters(texts):
    import numpy as np

    return np.array([np.bincount(np.frombuffer(t.encode(), np.uint8) % 16, minlength=16) for t in texts], float).reshape(-1, 16)


@query("""with h as (select doc_id, unnest(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '.(.)', '\\1', 'g'), '')) as d from documents), c as (select doc_id, d, count(*) as n from h where d <> '' group by doc_id, d),
    s as (select doc_id, sqrt(sum(n * n)) as size from c group by doc_id), p as (select doc_id, unnest(range(16)) as place from documents)
    select p.doc_id, p.place::int as place, coalesce((c.n / s.size)::float, 0)::double as x from p left join s on s.doc_id = p.doc_id left join c on c.doc_id = p.doc_id and c.d = upper(to_base(p.place, 16))""")
def embed_column(spark, sf_dir):
    """Unit vectors of a model that counts the last four bits of all bytes of a text, a number a row."""
    d = view(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    e = A.embed_column(d, "text", _letters)
    return e.select("doc_id", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.col("x").cast("double"))


# ---------------------------------------------------------------- streams


def _streamed(spark: SparkSession, sf_dir: str, rates, mode: str = "complete") -> DataFrame:
    """Run a function of the activity stream to the end of the events; each batch's whole result replaces the last."""
    events = R.read_events(spark, f"{sf_dir}/events.parquet")
    activity = R.watermarked(spark.sql(VIEWS["activity"], events=events))
    out = scratch(spark, "stream")
    q = rates(activity).writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "offsets"))
    q = q.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query()
def completion_rates_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, R.completion_rates)


ORACLES["completion_rates_stream"] = SCORED["completion_rates"]


def _arrivals(spark: SparkSession, sf_dir: str, files: int = 6) -> DataFrame:
    """The activity as a stream of some files in order of arrival, a file a batch; every tenth event comes three files late."""
    a = view(spark, sf_dir, "activity")
    last = a.agg(F.max("event_id").alias("last"))  # one row
    at = F.floor(F.col("event_id") * files / (F.col("last") + 1)) + F.when(F.col("event_id") % 10 == 0, 3).otherwise(0)
    path = scratch(spark, "arrivals")
    split = a.crossJoin(F.broadcast(last)).withColumn("file", at).drop("last")
    schema = split.drop("file").schema
    split = materialised(split, "split")
    for k in range(files + 3):  # one after the other, for the order of files is their age
        split.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(path)
    return R.watermarked(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


@query()
def status_fold_stream(spark, sf_dir):
    """The log of changes that keyed state gives out, folded."""
    out = scratch(spark, "statuses")
    S.run_to_end(S.status_changes(R.watermarked(R.read_events(spark, f"{sf_dir}/events.parquet").transform(lambda e: spark.sql(VIEWS["activity"], events=e)))), out, scratch(spark, "offsets"), "update")
    return S.latest_status(S.batches(spark, out, S.STATUS))


ORACLES["status_fold_stream"] = SCORED["status_fold"]


@query(SCORED_ETA)
def eta_stream(spark, sf_dir):
    """Remaining times as a stream in update mode beside the backlog: of a window the latest batch counts."""
    out = scratch(spark, "eta")
    stats = C.combined_stats(*(view(spark, sf_dir, n) for n in ("shelf", "tracks", "track_embeddings")))
    stages = materialised(S.backlog(stats), "backlog")
    events = R.watermarked(R.read_events(spark, f"{sf_dir}/events.parquet").transform(lambda e: staged(spark.sql(VIEWS["activity"], events=e))))
    S.run_to_end(S.remaining_time(events, stages), out, scratch(spark, "offsets"), "update")
    log = S.batches(spark, out, "window_start timestamp, stage string, state string, seconds long")
    return log.groupBy("window_start", "stage").agg(F.max_by(F.struct("state", "seconds"), "batch").alias("x")).select("window_start", "stage", "x.state", "x.seconds")


@query("""with a as (select *, event_id * 6 // (max(event_id) over () + 1) + case when event_id % 10 = 0 then 3 else 0 end as file from v_activity),
    w as (select file, max(max(epoch_ms(ts))) over (order by file rows between unbounded preceding and 2 preceding) - 300000 as mark from a group by file),
    j as (select a.*, coalesce(epoch_us(ts) <= mark * 1000, false) as late from a join w on w.file = a.file)
    select type, count_if(not late) as n_kept, min(case when not late then event_id end) as first_kept, max(case when not late then event_id end) as last_kept, (select count_if(late) from j) as n_late, (select count(*) from j) as n_all from j group by type having count_if(not late) > 0""")
def deny_late(spark, sf_dir):
    """What the watermark of a real stream keeps of events that come late, and how many its listener saw dropped."""
    out = scratch(spark, "kept")
    events = _arrivals(spark, sf_dir)
    seen = S.kept_and_dropped(events, out, scratch(spark, "offsets"))
    kept = S.batches(spark, out, "event_id long, ts timestamp, item_id long, value double, type string")
    g = kept.groupBy("type").agg(F.count("*").alias("n_kept"), F.min("event_id").alias("first_kept"), F.max("event_id").alias("last_kept"))
    return g.withColumns({"n_late": F.lit(seen.rows).cast("long"), "n_all": F.lit(seen.input).cast("long")})


@query()
def bandwidth_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, R.bandwidth)


ORACLES["bandwidth_stream"] = SCORED["bandwidth"]


@query("select album_id::varchar as identifier, downloads, case when album_id % 3 = 0 then 1 else 0 end as run from v_albums where album_id % 12 in (1, 2, 3, 8, 10) and album_id % 9 <> 0")
def incremental_ingest(spark, sf_dir):
    """Pages arrive as files in two runs, the second with all items anew; only what the first had not is taken then.

    Known ids lie in the stream's state, each batch writes its own folder, and a run goes on where the last one stopped.
    """
    a = view(spark, sf_dir, "albums").select(F.col("album_id").cast("string").alias("identifier"), "downloads", "licenseurl", "album_id")
    path, offsets, out = scratch(spark, "pages"), scratch(spark, "offsets"), scratch(spark, "ingested")
    denied = materialised(a.where("album_id % 9 = 0").select("identifier"), "denied")
    marks = []
    for part in (a.where("album_id % 3 <> 0"), a):
        pages(part).write.mode("append").text(path)
        dump = I.scan_item_dump(spark, path, stream=True)
        new = C.filter_denylist(dump.where(commercially_usable(F.col("licenseurl"))), denied).select("identifier", "downloads")
        S.run_to_end(S.first_seen(new, "identifier"), out, offsets, "append")
        marks.append(S.batches(spark, out, "identifier string, downloads long").agg(F.max("batch")).first()[0])
    log = S.batches(spark, out, "identifier string, downloads long")
    return log.select("identifier", "downloads", (F.col("batch") > marks[0]).cast("int").alias("run"))
