"""Exact top-k search without random access: sorted lists are read in sequence, with bounds on every score.

Vectors that are null, empty or hold null or non-finite components take no part; vectors meet only those of their
own length. Equal scores go to the smaller id. Repeated rows each count: a query leaves out its own row only, so copies
of it are candidates, and each copy of a query row is a query. Rows with a null id take no part. Too few candidates
give fewer rows, an empty table none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import saved

#: Vectors a block of candidates and a block of queries hold at most; blocks of candidates that one task reads in turn.
CANDIDATES, QUERIES, RUN = 8192, 1024, 4
#: Part of the weightiest list that the first round reads, growth of it by round; candidates of a query that are resolved by products.
FIRST, GROWTH, OPEN = 1 / 16, 4, 16
#: Blocks of queries whose bars a task remembers.
BARS = 64


def read_lists(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray, bar: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(query row, candidate row) pairs that may be among the k best of each query, no true one missing, and the part of the lists read.

    A list per component holds the candidates by that component; a query reads it from its high end where the query's
    component is positive and from its low end where it is negative. The weight of a list is its spread times the
    queries' mean component; each round reads lists to a depth by weight, so the ones that decide come first. What is new
    adds to the partial scores; what is unread lies between the reading point and the list's far end, which gives the
    bounds. A candidate whose upper bound is under the k-th best lower bound cannot qualify. A query ends when so few can
    that their scores may be resolved; a candidate goes when no query is left that it could serve. At the lists' ends
    the bounds are the scores. ``own``: a query's own row or -1. ``bar``: a score that the query's k best reach anyhow,
    or -inf. ``slack``: by how much sums may be off at most.
    """
    n, width = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
    ordered, at = np.take_along_axis(x, order, 0), np.arange(width)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    weight = np.abs(q).mean(axis=0, dtype=float) * (ordered[-1] - ordered[0])
    weight = weight / max(weight.max(initial=0), 1e-300)
    live, cols, read, reach = np.arange(len(q)), np.arange(n), np.zeros(width, np.int64), FIRST
    part = np.zeros((len(q), n), q.dtype)
    found = [(np.zeros(0, np.int64),) * 2]
    while len(live) and len(cols):
        part_of = np.minimum(1, reach * weight) if reach < GROWTH**3 else np.ones(width)
        until = np.minimum(n, np.maximum(np.ceil(n * part_of).astype(np.int64), k + 1))
        unread_up, unread_down = rank < n - until, rank >= until
        new = np.concatenate([np.where(~unread_up & (rank < n - read), x, 0), np.where(~unread_down & (rank >= read), x, 0)], axis=1)
        part += np.concatenate([up, down], axis=1) @ new.T
        unread = np.concatenate([unread_up, unread_down], axis=1).astype(q.dtype).T
        high = part + np.concatenate([up * ordered[n - until, at], down * ordered[until - 1, at]], axis=1) @ unread
        low = part + np.concatenate([up * ordered[0], down * ordered[-1]], axis=1) @ unread
        for bound in (low, high):
            bound[own[live][:, None] == cols] = -np.inf
        if len(cols) >= k:
            bar = np.maximum(bar, -np.partition(-low, k - 1, axis=1)[:, k - 1] - slack)
        open_ = (high >= (bar - slack)[:, None]) & (high > -np.inf)
        done = (open_.sum(axis=1) <= OPEN * k) | bool((until == n).all())
        a, b = np.nonzero(open_[done])
        found.append((live[done][a], cols[b]))
        keep = open_[~done].any(axis=0)
        live, cols, read, reach = live[~done], cols[keep], until, reach * GROWTH
        part, up, down, x, rank = part[~done][:, keep], up[~done], down[~done], x[keep], rank[keep]
        bar, slack = bar[~done], slack[~done]
    rows, cols = (np.concatenate(c) for c in zip(*found, strict=True))
    return rows, cols, float(np.mean(read) / max(1, n))


def _sums_type(q: np.ndarray, x: np.ndarray) -> type:
    """The narrowest float whose sums of products of these integers are exact, float64 if none is."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 2**24 else np.float64


def _products(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a of q with rows b of x as integers."""
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) >= 2**53
    if not wide:
        parts = [np.einsum("ij,ij->i", q[a[i : i + 65_536]], x[b[i : i + 65_536]]).astype(np.int64) for i in range(0, len(a), 65_536)]
        return np.concatenate([np.zeros(0, np.int64), *parts])
    big_q, big_x = {i: [int(v) for v in q[i]] for i in np.unique(a).tolist()}, {j: [int(v) for v in x[j]] for j in np.unique(b).tolist()}
    return np.array([sum(map(int.__mul__, big_q[i], big_x[j])) for i, j in zip(a.tolist(), b.tolist(), strict=True)], object)


def best_of_block(qrows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bar: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query's row, vector id, score) of the k best of one block for each query, ties to the smaller id.

    With a ``bar`` for each query, those of the k best that reach it. Where no float holds the sums, bounds are wider by
    what rounding may take, and what stays open is multiplied as whole numbers.
    """
    order = np.argsort(rows)
    rows, ids, x = rows[order], ids[order], x[order]
    at = np.minimum(np.searchsorted(rows, qrows), len(rows) - 1)
    own = np.where(rows[at] == qrows, at, -1)
    kind = _sums_type(q, x)
    q, x = q.astype(kind), x.astype(kind)
    size = np.abs(q).astype(float) @ np.abs(x).max(axis=0, initial=0).astype(float)
    slack = np.where(size < (2**24 if kind is np.float32 else 2**53), 0, size * (x.shape[1] + 8) * 2.0**-50)
    a, b, _ = read_lists(q, x, k, own, np.full(len(q), -np.inf) if bar is None else bar, slack)
    score = _products(q, x, a, b)
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    best = np.arange(len(a)) - np.searchsorted(a, a) < k
    return list(zip(qrows[a[best]].tolist(), ids[b[best]].tolist(), score[best].tolist(), strict=True))


def higher_bar(best: np.ndarray, qrows: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The k best scores of each query of a block, as doubles no greater than they are, with those found in one more block."""
    k = best.shape[1]
    at = {r: i for i, r in enumerate(qrows.tolist())}
    more = np.full_like(best, -np.inf)
    seen = dict.fromkeys(at, 0)
    for r, _, score in found:
        more[at[r], seen[r]] = score - abs(score) * 2.0**-50 if abs(score) >= 2**53 else score
        seen[r] += 1
    return -np.sort(-np.concatenate([best, more], axis=1), axis=1)[:, :k]


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest of three types; numbers no 64-bit integer holds stay floats."""
    most = np.abs(v).max(initial=0)
    return v.astype(np.int8 if most < 127 else np.int32 if most < 2**31 else np.int64) if most < 2**63 else v


def _blocks(df: DataFrame, most: int, name: str) -> DataFrame:
    """Rows of up to ``most`` packed vectors of one cell and length: rows, ids and vectors as bytes, and the vectors' type."""

    def run(batches):
        import pandas as pd

        held: dict[tuple[int, int], list] = {}

        def packed(key, rows):
            v = _narrow(np.array([x for _, _, x in rows]))
            number, ids = (np.array([r[c] for r in rows], np.int64).tobytes() for c in (0, 1))
            return pd.DataFrame({"cell": [key[0]], "width": [key[1]], f"{name}_rows": [number], f"{name}_ids": [ids], name: [v.tobytes()], f"{name}_type": [v.dtype.str]})

        for b in batches:
            for cell, r, i, v in zip(b["cell"], b["row"], b["id"], b["vector"], strict=True):
                rows = held.setdefault((cell, len(v)), [])
                rows.append((r, i, v))
                if len(rows) == most:
                    yield packed((cell, len(v)), held.pop((cell, len(v))))
        for key, rows in held.items():
            yield packed(key, rows)

    return df.mapInPandas(run, f"cell int, width int, {name}_rows binary, {name}_ids binary, {name} binary, {name}_type string")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The k best by inner product of floor(scale * x) for every query row, over all other rows.

    Rows are numbered in a table first. Queries fall into slots and candidates into shards by hash, with a block's worth
    of each, and RUN shards make a run; each pair of a slot and a run is one key of an equi-join of packed blocks, so every
    task holds a block or two of either however many there are, and the merge sees k rows at most for each query and
    block. Blocks of candidates that meet the same queries in one task hand on the k-th best score so far.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("is_query")).where(
        F.col("v").isNotNull()
        & F.col("id").isNotNull()
        & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    whole = sound.select("id", "is_query", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("vector"))
    whole = saved(whole.withColumn("row", F.monotonically_increasing_id()))
    sizes = whole.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    slots, shards = max(1, -(-sizes["q"] // QUERIES)), max(1, -(-sizes["n"] // CANDIDATES))

    def dealt(df: DataFrame, cells: int, most: int, name: str, cell: str) -> DataFrame:
        df = df.withColumn("cell", F.expr(f"cast(pmod(xxhash64(row), {cells}) as int)")).select("cell", "row", "id", "vector")
        return _blocks(df.repartition(cells, "cell"), most, name).withColumnRenamed("cell", cell)

    q = dealt(whole.where("is_query"), slots, QUERIES, "queries", "slot").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // RUN))))
    x = dealt(whole, shards, CANDIDATES, "candidates", "shard").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    x = x.withColumn("run", F.expr(f"cast(shard div {RUN} as int)"))
    pairs = x.hint("shuffle_hash").join(q, ["slot", "run", "width"])

    def run(batches):
        import pandas as pd

        numbers = lambda raw: np.frombuffer(raw, np.int64)
        bars: dict[bytes, np.ndarray] = {}  # the k best scores so far, of the last blocks of queries
        for b in batches:
            for r in b.itertuples():
                q, x = (np.frombuffer(v, kind).reshape(-1, r.width).astype(float) for v, kind in ((r.queries, r.queries_type), (r.candidates, r.candidates_type)))
                qrows, qids = numbers(r.queries_rows), numbers(r.queries_ids)
                best = bars.pop(r.queries_rows, np.full((len(q), k), -np.inf))
                rows = best_of_block(qrows, q, numbers(r.candidates_rows), numbers(r.candidates_ids), x, k, best[:, -1])
                bars[r.queries_rows] = higher_bar(best, qrows, rows)
                if len(bars) > BARS:
                    del bars[next(iter(bars))]
                found = pd.DataFrame(rows, columns=["row", "vec_id", "score"])
                id_of = pd.Series(qids, index=qrows)
                yield found.assign(query_id=id_of.reindex(found["row"]).to_numpy())[["row", "query_id", "vec_id", "score"]]

    found = pairs.mapInPandas(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as w from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.w, b.w), lambda p: p[1] * p[2])) as bigint) as score
      from v a join v b on a.vec_id <> b.vec_id and len(a.w) = len(b.w) where a.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
