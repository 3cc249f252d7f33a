"""Nearest rows for many queries at once: matrix products of blocks of queries and blocks of candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.sources.tables import materialised

#: Rows of a block of queries and of a block of candidates; bytes of queries up to which they are broadcast.
QUERIES, CANDIDATES, SENT = 512, 4096, 32 << 20

FOUND = "array<struct<query:bigint,score:double>>"


def vectors_of(column) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(df: DataFrame, most: int) -> DataFrame:
    """(id, v, found) as blocks of up to ``most`` rows of an Arrow batch: ids, vectors end to end, width, what was found."""
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("width", pa.int32()), ("found", pa.list_(pa.list_(pa.struct([("query", pa.int64()), ("score", pa.float64())]))))])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                m = vectors_of(part.column("v"))
                cells = [part.column("id").to_pylist()], [m.astype("<f8").tobytes()], [m.shape[1]], [part.column("found").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, kind, strict=True)], schema=kind)

    v = F.col("v").cast("array<double>")
    found = F.col("found") if "found" in df.columns else F.lit(None)
    rows = df.where("v is not null").select("id", v.alias("v"), found.cast(FOUND).alias("found"))
    return rows.mapInArrow(run, f"ids array<long>, v binary, width int, found array<{FOUND}>")


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of all pairs, 0 where either vector is zero."""
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    return np.clip(unit(q) @ unit(c).T, -1, 1)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties to smaller ids; -inf does not count."""
    if score.shape[1] > k:
        bar = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        a, b = np.nonzero((score >= bar) & (score > -np.inf))
    else:
        a, b = np.nonzero(score > -np.inf)
    order = np.lexsort((ids[b], -score[a, b], a))
    a, b = a[order], b[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep]


def nearest(queries: DataFrame, candidates: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], others: bool = False) -> DataFrame:
    """(query, id, rank, score) of the k best candidates of each query, ties to smaller ids.

    ``queries`` (id, v) and ``candidates`` (id, v, perhaps ``found``: an array of (query, score) whose scores are added).
    ``score`` takes a matrix of queries and one of candidates. With ``others`` a query does not meet its own id. Blocks of
    queries are sent to the tasks while they have SENT bytes at most, and else meet those of the candidates under a key of
    both blocks; in either way each meeting gives k rows a query, which a window merges.
    """
    q = materialised(packed(queries, QUERIES).drop("found").withColumn("slot", F.monotonically_increasing_id()), "queries")
    c = packed(candidates, CANDIDATES)
    q = q.select("slot", F.col("ids").alias("q_ids"), F.col("v").alias("q"), F.col("width").alias("q_width"))
    size = q.agg(F.coalesce(F.sum(F.octet_length("q")), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= SENT:
        pairs = c.crossJoin(F.broadcast(q))
    else:
        slots = q.agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # a number for each QUERIES queries
        shard = F.monotonically_increasing_id()
        dealt = materialised(c.withColumn("shard", shard), "candidates")
        keys = dealt.select("shard").crossJoin(F.broadcast(slots)).select("shard", F.explode("slots").alias("slot"))
        pairs = keys.join(dealt, "shard").join(q, "slot")
    shape = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                if r["width"] != r["q_width"]:
                    raise ValueError("vectors of different lengths")
                q_ids, ids = np.array(r["q_ids"], np.int64), np.array(r["ids"], np.int64)
                whole = lambda raw: np.frombuffer(raw, "<f8").reshape(-1, r["width"])  # noqa: B023, E731
                s = np.array(score(whole(r["q"]), whole(r["v"])), float)
                if any(r["found"]):
                    row = {x: i for i, x in enumerate(r["q_ids"])}
                    for j, found in enumerate(r["found"]):
                        for f in found or ():
                            if f["query"] in row:
                                s[row[f["query"]], j] += f["score"]
                s = np.round(s, 9)
                if others:
                    s[q_ids[:, None] == ids] = -np.inf
                x, y = best(ids, s, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[x]), pa.array(ids[y]), pa.array(s[x, y])], schema=shape)

    found = pairs.mapInArrow(run, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
