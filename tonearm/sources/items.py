"""Readers of item dumps, item metadata, member lists, denylists and seed tables, and writers of results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import metadata as M

ITEM_PAGE = "items array<struct<identifier:string,downloads:bigint,licenseurl:string>>, count int, total int, cursor string"
MEMBER_LIST = "success boolean, value struct<id:int,list_name:string,description:string,members:array<struct<identifier:string,date_added:string>>>"


def scan_item_dump(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Items of pages, one JSON page a line; as a stream, its checkpoint is the cursor."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ITEM_PAGE).json(path).select(F.explode("items").alias("i")).select("i.*")


def scan_item_metadata(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """Item metadata, one JSON item a line, as VARIANT; lines that are no JSON drop out.

    ``seen`` counts ``lines`` and ``bad_lines`` while they are read.
    """
    v = spark.read.text(path).select(F.try_parse_json("value").alias("item"))
    if seen is not None:
        v = v.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("item").isNull()).alias("bad_lines"))
    return v.where("item is not null")


def flatten_items(items: DataFrame) -> DataFrame:
    """identifier, title, creator, subjects, genres, license and restriction of VARIANT items."""
    v = F.col("item")
    text = lambda p: F.try_variant_get(v, p, "string")
    return items.select(
        text("$.metadata.identifier").alias("identifier"), text("$.metadata.title").alias("title"),
        M.flex_to_string(v, "$.metadata.creator").alias("creator"), M.flex_to_string(v, "$.metadata.collection").alias("collection"), M.flex_to_array(v, "$.metadata.subject").alias("subjects"),
        M.flex_to_array(v, "$.metadata.genre").alias("genres"), text("$.metadata.licenseurl").alias("licenseurl"),
        M.flex_bool(v, "$.metadata['access-restricted-item']").alias("restricted"), text("$.metadata.mediatype").alias("mediatype"),
        M.flex_to_string(v, "$.metadata.description").alias("description"), "item",
    )


FILES = "array<struct<name:string,format:string,title:string,track:string,bitrate:string,length:string>>"


def plain_items(items: DataFrame) -> DataFrame:
    """VARIANT items as plain columns, their files as an array; items without an identifier drop out."""
    return (
        flatten_items(items).withColumn("files", F.try_variant_get("item", "$.files", FILES)).drop("item")
        .withColumnRenamed("identifier", "album_id").where("album_id is not null")
    )


def flatten_files(items: DataFrame) -> DataFrame:
    """Acceptable audio files of VARIANT items as tracks."""
    f = items.select("identifier", F.explode(F.try_variant_get("item", "$.files", FILES)).alias("f")).select("identifier", "f.*")
    f = f.where(M.is_acceptable_mp3(F.col("format"), F.col("bitrate"))).withColumn("duration", M.parse_duration(F.col("length")))
    return f.where(F.col("duration") <= M.MAX_SECONDS).select(
        F.col("identifier").alias("album_id"), F.col("name").alias("filename"),
        F.coalesce(F.nullif("title", F.lit("")), M.derive_title(F.col("name"))).alias("title"),
        M.parse_track_number(F.col("track")).alias("track_number"), "format", M.parse_bitrate(F.col("bitrate")).alias("bitrate"),
        "duration", M.download_url(F.col("identifier"), F.col("name")).alias("download_url"),
    )


def scan_list_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of lists; lists that failed or are empty give no rows."""
    lists = spark.read.schema(MEMBER_LIST).json(path).where("success")
    return lists.select("value.list_name", F.explode("value.members").alias("m")).select("list_name", "m.identifier", "m.date_added")


def list_collection_id(list_id: Column, list_name: Column) -> Column:
    """``@`` and the list's number, then its name in lower case with hyphens for spaces."""
    return F.concat(F.lit("@"), list_id, F.lit("-"), F.lower(F.replace(list_name, F.lit(" "), F.lit("-"))))


def import_list(members: DataFrame, albums: DataFrame, title: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collection rows, links, new albums) of imported lists (list_id, list_name, identifier); a blank title gives way
    to the list's name."""
    m = members.withColumn("collection_id", list_collection_id(F.col("list_id"), F.col("list_name"))).withColumn("title", F.coalesce(F.nullif(title, F.lit("")), "list_name"))
    rows = m.groupBy("collection_id", "title").agg(F.count_distinct("identifier").alias("discovered_count"))
    links = m.select("collection_id", "identifier").distinct()
    return rows, links, links.select("identifier").distinct().join(albums.select("identifier"), "identifier", "left_anti")


#: A line of a JSON array of strings that is written over any number of lines.
_STRING = r'"(?:[^"\\]|\\.)*"'
_IDS = rf"^\s*[\[,]?\s*(?:{_STRING}\s*(?:,\s*{_STRING}\s*)*)?,?\s*\]?\s*$"


def scan_denylist(spark: SparkSession, path: str) -> DataFrame:
    """Ids of JSON arrays of strings, in files of any number of lines; a missing file or one that is no such array gives none.

    Files are read by lines, so that a long list is no task's alone; a file with a line of anything else is left out.
    """
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException:
        return spark.createDataFrame([], "identifier string")
    bad = lines.where(~F.col("value").rlike(_IDS)).select("file").distinct()
    ids = lines.join(bad, "file", "left_anti").select(F.explode(F.regexp_extract_all("value", F.lit(f"({_STRING})"), F.lit(1))).alias("q"))
    return ids.select(F.from_json(F.concat(F.lit("["), "q", F.lit("]")), "array<string>")[0].alias("identifier"))


PILLS = "id string, label string, clap_prompt string, keywords string, sort_order int, enabled boolean, min_library_count int"
COLLECTIONS = "id string, title string, notes string, category string, curator string, url string, query string, item_count int"


def scan_seed_pills(spark: SparkSession, path: str) -> DataFrame:
    """Seed pills of files that each hold a JSON array; enabled unless said otherwise, ten albums unless said otherwise."""
    p = spark.read.schema(PILLS).option("multiLine", True).json(path)
    return p.withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "min_library_count": F.coalesce("min_library_count", F.lit(10))})


def scan_seed_collections(spark: SparkSession, path: str) -> DataFrame:
    """Seed collections of such files, as rows of the collection table: pending, nothing discovered."""
    c = spark.read.schema(COLLECTIONS).option("multiLine", True).json(path)
    return c.select(
        F.col("id").alias("collection_id"), "title", F.col("notes").alias("description"), "category", "curator", "url", "query",
        F.col("item_count").alias("expected_count"), F.lit("pending").alias("status"), F.lit(0).alias("discovered_count"),
    )


def seed(table: DataFrame, seeds: DataFrame, key: str, only_if_empty: bool = False) -> DataFrame:
    """The table with those seeds whose key it lacks; ``only_if_empty``: with none unless it has no rows."""
    from tonearm.operators.catalog import insert_or_ignore

    if only_if_empty and not table.isEmpty():
        return table
    return insert_or_ignore(table, seeds, [key], [c for c in seeds.columns if c != key])


def write_catalog(df: DataFrame, path: str, partition: str = "status") -> None:
    """A table in partitions, for jobs that work on one of them."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table in sorted buckets of a key, under a name: joins and groups of it by the key need no exchange.

    Rows are dealt by bucket first, so that a bucket is one file.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def catalog_batches(path: str):
    """A ``foreachBatch`` function that writes rows of a stream into their status' partition, under the batch's own name."""
    from tonearm.sources.tables import put

    return lambda df, batch: put(df, path, f"stream-{batch}")


def write_stats_json(stats: dict[str, DataFrame], path: str) -> None:
    """One JSON document of one-row statistics."""
    whole = None
    for name, df in stats.items():
        one = df.select(F.struct(*df.columns).alias(name))
        whole = one if whole is None else whole.crossJoin(one)
    whole.select(F.to_json(F.struct(*whole.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_eval_report(ranked: DataFrame, path: str) -> None:
    """Ranked results of each prompt as one JSON line."""
    more = [c for c in ranked.columns if c not in ("prompt_id", "rank", "track_id", "score")]
    rows = F.sort_array(F.collect_list(F.struct("rank", "track_id", "score", *more)))  # k rows a prompt
    ranked.groupBy("prompt_id").agg(rows.alias("results")).write.mode("overwrite").json(path)
