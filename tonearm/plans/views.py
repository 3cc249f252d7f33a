"""The catalogue as views over the given tables, in SQL that Spark and DuckDB both read.

A view names its inputs in braces. Spark binds them to DataFrames, an oracle gets them as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

#: Text query of the lexical and hybrid searches, and the prompt vectors: vec_id 0-3 positive, 4-10 negative.
QUERY_TEXT = "thre attion anea the src3"

VIEWS = {
    "albums": """
        select o_orderkey as album_id, concat('release ', o_orderkey) as title, c_name as creator,
               case c_mktsegment when 'FURNITURE' then 'sound effects' when 'HOUSEHOLD' then 'field recording'
                    when 'BUILDING' then 'folk tales' when 'AUTOMOBILE' then 'ambient, drone' end as subjects,
               case when o_orderkey % 3 = 0 then 'jazz' when o_orderkey % 3 = 1 then 'rock, blues' end as genres,
               case o_orderstatus when 'F' then 'resolved' when 'O' then 'pending' else 'unavailable' end as status,
               cast(floor(o_totalprice) as bigint) as downloads, o_orderdate as created_at,
               cast(o_orderkey % 4 as int) as retry_count,
               case o_orderkey % 12 when 0 then '' when 1 then 'http://creativecommons.org/publicdomain/zero/1.0/'
                    when 2 then 'https://creativecommons.org/licenses/by/4.0/' when 3 then 'https://creativecommons.org/licenses/by-sa/3.0/'
                    when 4 then 'http://creativecommons.org/licenses/by-nc/2.0/' when 5 then 'https://creativecommons.org/licenses/by-nc-sa/4.0/'
                    when 6 then 'https://creativecommons.org/licenses/by-nd/4.0/' when 7 then 'https://creativecommons.org/licenses/by-nc-nd/4.0/'
                    when 8 then 'https://example.org/CC0/' when 9 then 'https://www.creativecommons.org/licenses/by/4.0/'
                    when 10 then 'https://example.org/public_domain' end as licenseurl
        from {orders} join {customer} on c_custkey = o_custkey""",
    "tracks": """
        select l_orderkey * 1000000 + l_partkey as track_id, l_orderkey as album_id, min(l_linenumber) as track_number,
               min(l_extendedprice) / 35 * (case when l_orderkey % 10 = 0 then cast(0.02 as double) else cast(1.0 as double) end) as duration,
               cast(max(l_quantity) * 8 as int) as bitrate, max(l_discount) * 10 as quality,
               case max(l_returnflag) when 'A' then 'completed' when 'N' then 'pending' else 'failed' end as status,
               case l_partkey % 7 when 0 then null when 1 then concat('Ch 1 ', min(p_name)) when 2 then 'Sine 440 Hz' else min(p_name) end as title,
               concat(min(p_name), '-', l_partkey, '.mp3') as filename,
               case when l_partkey % 5 = 0 then null else replace(min(p_name), ' ', ', ') end as tags,
               cast(l_partkey % 4 as int) as retry_count,
               case l_partkey % 3 when 0 then 'listenability-v2' when 1 then 'listenability-v1' end as version,
               case when l_partkey % 11 = 0 then 'exclude' when l_partkey % 11 = 1 then 'demote' when l_partkey % 11 < 8 then 'include' end as decision,
               case when l_partkey % 11 = 0 then 'excluded' when l_partkey % 11 = 1 then 'longform_candidate' when l_partkey % 11 < 8 then 'default' end as stream,
               cast((l_partkey % 100) as double) / 100 as score,
               case when l_partkey % 13 = 0 then 'tail' else 'head' end as strategy,
               case l_partkey % 6 when 0 then 'excellent' when 1 then 'good' when 2 then 'borderline' when 3 then 'poor' when 4 then 'unusable' end as tier,
               min(l_shipdate) as updated_at
        from {lineitem} join {part} on p_partkey = l_partkey group by l_orderkey, l_partkey""",
    "shelf": """
        select a.*, case when album_id % 5 = 0 then null when album_id % 5 = 1 then '' when album_id % 12 in (1, 10) then 'pd' when album_id % 12 = 2 then 'cc-by'
                    when album_id % 12 = 3 then 'cc-by-sa' when album_id % 12 = 4 then 'cc-by-nc' when album_id % 12 = 8 then 'cc0' else 'other' end as license,
               case when album_id % 4 = 0 then 'Radio 12' when album_id % 4 = 1 then 'netlabels' end as collection,
               cast(album_id % 3 as int) as track_count, created_at as updated_at, concat('item_', album_id) as identifier,
               case when album_id % 7 <> 0 then cast(album_id % 100 as double) / 100 end as album_score
        from {albums} a""",
    "track_embeddings": """
        select track_id, quality as quality_score, strategy as sample_strategy from {tracks} where status = 'completed' and track_id % 5 <> 3""",
    "collections": """
        select n_nationkey as collection_id, n_name as title, cast(n_regionkey * 1000 as int) as expected_count,
               case n_nationkey % 4 when 0 then 'pending' when 1 then 'discovering' when 2 then 'discovered' else 'failed' end as status,
               cast(n_nationkey as int) as created_seq
        from {nation}""",
    "links": """
        select c_nationkey as collection_id, o_orderkey as album_id from {orders} join {customer} on c_custkey = o_custkey
        union
        select s_nationkey as collection_id, l_orderkey as album_id from {lineitem} join {supplier} on s_suppkey = l_suppkey""",
    "pills": """
        select * from (values
            (1, 'Small things', 'small, tiny', 1, true, 10), (2, 'Hot', 'hot, spicy', 2, true, 10),
            (3, 'Rings', 'ring,Widget', 3, true, 10), (4, 'Ambient', 'ambient, drone', 4, true, 10),
            (5, 'Field', 'field recording', 5, false, 10), (6, 'Gears', 'gear, red', 6, true, 1000000000)
        ) as p(pill_id, label, keywords, sort_order, enabled, min_library_count)""",
    "vtracks": """
        select d.doc_id as track_id, concat(d.source, ' no. ', d.doc_id) as title, d.source as album_title, d.lang as creator,
               replace(lower(d.text), ' ', ', ') as tags,
               case when l.quality = 0 then 'exclude' end as decision, case when l.toxic = 1 then 'longform_candidate' end as stream,
               'completed' as status, e.embedding
        from {documents} d join {embeddings} e on e.vec_id = d.doc_id left join {labels} l on l.doc_id = d.doc_id""",
    "activity": """
        select event_id, cast(ts as timestamp) as ts, user_id as item_id, value,
               case event_type when 'click' then 'api_call' when 'view' then 'bytes' when 'purchase' then 'analyzer'
                    when 'signup' then 'resolver' else 'failed' end as type
        from {events}""",
}


def inputs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view of it as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "tracks":
        return _tracks(view(spark, sf_dir, "lineitem"), view(spark, sf_dir, "part"))
    sql = VIEWS[name]
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in inputs(sql)})


def _tracks(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The view of tracks, grouped before it meets the parts.

    Lines are dealt by part, which serves their groups and the join; no group holds a text, so none is sorted.
    """
    lines = lineitem.where("l_partkey is not null").repartition("l_partkey").groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_linenumber").alias("line_"), F.min("l_extendedprice").alias("price_"), F.max("l_quantity").alias("quantity_"), F.max("l_discount").alias("discount_"),
        F.min("l_shipdate").alias("shipped_"), *(F.max(F.expr(e)).alias(n) for n, e in (("a_", "l_returnflag = 'A'"), ("over_a_", "l_returnflag > 'A'"), ("n_", "l_returnflag = 'N'"), ("over_n_", "l_returnflag > 'N'"))),
    )
    names = part.groupBy("p_partkey").agg(F.min("p_name").alias("name_"))
    least = {"min(l_linenumber)": "line_", "min(l_extendedprice)": "price_", "max(l_quantity)": "quantity_", "max(l_discount)": "discount_", "min(l_shipdate)": "shipped_", "min(p_name)": "name_",
             "max(l_returnflag)": "(case when a_ and not over_a_ then 'A' when n_ and not over_n_ then 'N' end)"}
    sql = VIEWS["tracks"]
    for told, name in least.items():
        sql = sql.replace(told, name)
    told = sql[: sql.index("from {lineitem}")]
    return lineitem.sparkSession.sql(f"{told} from {{j}}", j=lines.join(names.hint("shuffle_hash"), F.col("p_partkey") == F.col("l_partkey")))


def _counts(sql: str) -> str:
    """``count_if(x)`` as a count of a case, for DuckDB makes its sum a wider type."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(case when {sql[at + 9 : end - 1]} then 1 end){sql[end:]}"
    return sql


def oracle(sql: str) -> str:
    """The same views as common table expressions before a DuckDB query, which names them ``v_...``."""
    sql = _counts(sql)
    used: list[str] = []

    def use(name: str) -> None:
        for x in inputs(VIEWS[name]):
            if x in VIEWS:
                use(x)
        if name not in used:
            used.append(name)

    for n in VIEWS:
        if re.search(rf"\bv_{n}\b", sql):
            use(n)
    told = lambda n: re.sub(r"\{(\w+)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], VIEWS[n])
    ctes = ",\n".join(f"v_{n} as ({told(n)})" for n in used)
    body = sql.strip()
    if not used:
        return body
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"
