"""Best-fit packing of token sequences with exact-complement hashing.

A document's ids are its text's, then an end id. Documents longer than a sequence are cut, from their end, into full
pieces; the first piece may be shorter. Only piece lengths decide the packing, so it is planned on their histogram: at
most ``size`` numbers, whatever the input. Null and empty texts are a lone end id; repeated rows are packed each;
an empty table gives an empty result; rows with a null id are packed too. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import map_columns, saved
from tonearm.llm.tokens import json_encoder, packed

SIZE, END = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of full length but perhaps the first."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """The token pieces of every document, with their ids (little-endian unsigned 32-bit) if asked for."""

    def run(ids, texts):
        encode = json_encoder(vocabulary)
        out = []
        for doc, text in zip(ids, texts, strict=True):
            raw = packed([*encode(text or ""), END])
            for i, (start, length) in enumerate(cut(len(raw) // 4, size)):
                part = raw[4 * start : 4 * (start + length)]
                out.append((doc, i, start, length, zlib.crc32(part), part if keep_ids else None))
        return list(zip(*out, strict=True)) or [[]] * 6

    return map_columns(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, PIECES)


class Sums:
    """The index of exact fillings: of every sum, its pairs and triples of lengths that can be had.

    ``pairs[s]`` lists the longer members a of the pairs (a, s - a), ``triples[s]`` the longest members a of triples
    whose rest is a pair of s - a. Counts only fall, so an entry whose lengths have run out is struck off when met.
    """

    def __init__(self, have: list[int]) -> None:
        self.have, size = have, len(have) - 1
        there = [x for x, n in enumerate(have) if n and x]
        self.pairs: list[list[int]] = [[] for _ in have]
        self.triples: list[list[int]] = [[] for _ in have]
        for i, a in enumerate(there):
            for b in there[: i + (have[a] > 1)]:
                if a + b > size:
                    break
                self.pairs[a + b].append(a)
        for a in there:
            for rest in range(2, min(2 * a, size - a) + 1):
                if self.pairs[rest] and self.pairs[rest][0] <= a:
                    self.triples[a + rest].append(a)

    def pair(self, total: int, left: list[int], longest: int) -> tuple[int, int] | None:
        """Two lengths with this sum, the longer one as long as can be but at most ``longest``."""
        known = self.pairs[total]
        for i in range(bisect_right(known, longest) - 1, -1, -1):
            a, b = known[i], total - known[i]
            if self.have[a] <= (a == b) or not self.have[b]:
                del known[i]
            elif left[a] > (a == b) and left[b]:
                return a, b
        return None

    def fill(self, gap: int, left: list[int]) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to the gap exactly, the longest first."""
        if left[gap]:
            return (gap,)
        found = self.pair(gap, left, gap)
        if found:
            return found
        known = self.triples[gap]
        for i in range(len(known) - 1, -1, -1):
            a = known[i]
            if not self.have[a]:
                del known[i]
            elif left[a]:
                left[a] -= 1
                rest = self.pair(gap - a, left, a)
                left[a] += 1
                if rest:
                    return (a, *rest)
        return None


def plan(available: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences follow each, for a histogram of lengths.

    From the longest length down: the gap it leaves is looked up in the index of single, pair and triple sums; an exact
    filling is used as often as counts allow. Where none is, the longest length that fits goes in (best fit), and the
    smaller gap is looked up again.
    """
    have = [0] * (size + 1)
    for length, n in available.items():
        have[length] += n
    sums = Sums(have)
    out: list[tuple[tuple[int, ...], int]] = []
    top = size
    while True:
        while top and not have[top]:
            top -= 1
        if not top:
            return out
        left = have.copy()
        pattern, gap = [top], size - top
        left[top] -= 1
        while gap:
            exact = sums.fill(gap, left)
            if exact:
                pattern += exact
                break
            best = next((x for x in range(gap, 0, -1) if left[x]), 0)
            if not best:
                break
            pattern.append(best)
            left[best] -= 1
            gap -= best
        need = {x: pattern.count(x) for x in set(pattern)}
        times = min(have[x] // c for x, c in need.items())
        for x, c in need.items():
            have[x] -= c * times
        out.append((tuple(pattern), times))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ranks from which a slot's pieces come, the slot's first sequence, and its offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def place(cut_up: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to saved pieces.

    Equal lengths are told apart by a rank: pieces fall into buckets by hash, a window ranks each (length, bucket), and
    the buckets' counts, added up in order, give its first rank. A common length is thus spread over all buckets.
    """
    n = cut_up.count()
    buckets = max(1, n // 4096)
    p = cut_up.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, start), {buckets})"))
    counts = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    where = slots(plan(histogram, size))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = p.withColumn("row", F.row_number().over(order)).join(firsts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("row") - 1)
    columns = [c for c in cut_up.columns if c != "ids"] + (["ids"] if "ids" in cut_up.columns else [])
    kinds = dict(cut_up.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    at = columns.index("length")

    def run(ranks, *rest):
        sequence, offset = [], []
        for rank, length in zip(ranks, rest[at], strict=True):
            ranks_of, first, off = where[length]
            i = int(np.searchsorted(ranks_of, rank, "right")) - 1
            sequence.append(int(first[i] + rank - ranks_of[i]))
            offset.append(int(off[i]))
        return [*rest, sequence, offset]

    return map_columns(ranked.select("rank", *columns), run, schema, 4096)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places; tokenised once, into a table in the shared folder."""
    cut_up = pieces(docs, vocabulary, id_col, text_col, keep_ids=keep_ids)
    return place(saved(cut_up if keep_ids else cut_up.drop("ids")))


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
