"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps: in turn every node points its larger, then its smaller neighbours to
    the least one. Minima are pre-aggregated, so a node with very many edges is no burden to one task. Each round is a
    table in the shared folder; it ends when a round changes nothing. Loops and repeated edges are harmless.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = mark(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        before, e = e, saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        dropped(before)
        now = mark(e)
        if now == last:
            break
        last = now
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = found.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = saved(found.unionByName(roots))
    dropped(e)
    return out
