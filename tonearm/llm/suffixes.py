"""Suffix-array dedup by bucket-pointer refinement, distributed.

Suffixes that begin alike share a bucket, named by a hash of the bytes that its suffixes share. Initial buckets are
q-gram buckets, of one suffix for each window of LENGTH bytes: its anchor, the leftmost of its q-grams with the least
name, so that equal windows have equal anchors at equal places. Buckets of one suffix are done and drop out. The others
are refined by the names of later offsets: a bucket twice as deep is named by the pair of the bucket at a place and the
one as many bytes on, and these names are used again for the next depth, up to LENGTH. Refinement stops early where a
whole stretch of windows is equal elsewhere, or where not even the bytes all windows of a stretch share are. Sorting by
bucket names is Spark's: buckets are grouped, never gathered. Names that only rule windows out have 64 bits; names by
which bytes go have 128, of two independent hashes.

Null and empty texts have no bytes. Repeated rows repeat each other and are removed entirely from LENGTH bytes on. Rows
with null ids are treated like others; an empty table gives an empty result; other columns are kept or not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import dropped, map_columns, saved, slices, unused
from tonearm.llm.hashing import Powers, mix, names, prefix_sums

LENGTH, Q, STRETCH = 200, 50, 16
#: Bytes of a text that are looked at together; longer texts overlap by a window less a byte.
SEGMENT = 1 << 19


def gram_names(sums: np.ndarray, q: int = Q, which: int = 0) -> np.ndarray:
    """The initial bucket of every place: the name of its q-gram."""
    _, down = Powers.upto(len(sums), which)
    n = len(sums) - q
    return mix((sums[q:] - sums[:-q]) * down[:n])


def refine(bucket: np.ndarray, depth: int) -> np.ndarray:
    """Buckets twice as deep, named by the bucket at a place and the bucket ``depth`` bytes on."""
    return mix(bucket[:-depth] * np.uint64(0xD6E8FEB86659FD93) + bucket[depth:])


def anchors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's place, its q-gram bucket): runs of windows with one anchor."""
    n = len(sums) - 1 - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = gram_names(sums)
    low = np.uint64((1 << 20) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # name, then place: the leftmost of the least
    width, span = LENGTH - Q + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    at = place[first]
    return first, count, at, grams[at]


def _segments(raw: np.ndarray):
    """(place, bytes) of overlapping parts of a text that hold each window once."""
    step = SEGMENT - LENGTH + 1
    for s in range(0, max(1, len(raw) - LENGTH + 1), step):
        yield s, raw[s : s + SEGMENT]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _occurrences(docs: DataFrame) -> DataFrame:
    """Of (key, text): key, bucket, ctx and ctx2 (names of all bytes of the run's windows), first, count, rel."""
    schema = "key long, bucket long, ctx long, ctx2 long, first long, count int, rel int"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    cols = ["key", "bucket", "ctx", "ctx2", "first", "count", "rel"]

    def run(batches):
        for b in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in cols]
            for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for place, raw in _segments(_bytes(text)):
                    sums = prefix_sums(raw)
                    first, count, at, bucket = anchors(sums)
                    rel, size = at - first, count + LENGTH - 1
                    ctx = names(sums, first, size) ^ mix((rel * 1024 + count).astype(np.uint64))
                    ctx2 = names(prefix_sums(raw, 1), first, size, 1)
                    for o, x in zip(out, (np.full(len(first), key), bucket.view(np.int64), ctx.view(np.int64), ctx2.view(np.int64), first + place, count, rel), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else [], k) for o, k in zip(out, kinds, strict=True)], cols)

    return docs.mapInArrow(run, schema)


def deep_names(raw: np.ndarray, which: int) -> np.ndarray:
    """The bucket of every place of some bytes at depth LENGTH, refined from its q-gram's."""
    return refine(refine(gram_names(prefix_sums(raw, which), Q, which), Q), 2 * Q)


def _stretches_of(raw: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of runs (rows first, count, rel; places in ``raw``): which run, and numbers (stretch, near, far, hull, hull2, core)."""
    first, count, rel = r
    anchor, far = first + rel, rel
    near = anchor - first - count + 1  # distances of the windows from the anchor
    low = near // STRETCH
    parts = far // STRETCH - low + 1
    i = np.repeat(np.arange(len(first)), parts)
    k = low[i] + np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
    a, b = np.maximum(near[i], k * STRETCH), np.minimum(far[i], (k + 1) * STRETCH - 1)
    s, e = anchor[i] - b, anchor[i] - a
    sums, sums2 = (prefix_sums(raw, w) for w in (0, 1))
    tag = mix((a * 512 + b).astype(np.uint64))
    hull = names(sums, s, e - s + LENGTH) ^ tag
    hull2 = names(sums2, s, e - s + LENGTH, 1)
    core = names(sums, anchor[i] - k * STRETCH, np.full(len(i), LENGTH - STRETCH + 1)) ^ mix(k.astype(np.uint64))
    return i, [k, a, b, hull.view(np.int64), hull2.view(np.int64), core.view(np.int64)]


def _windows_of(raw: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of parts of runs (rows anchor, near, far; places in ``raw``): which part, and each window's (d, name, name2)."""
    anchor, near, far = r
    n = far - near + 1
    i = np.repeat(np.arange(len(n)), n)
    d = near[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return i, [d, *(deep_names(raw, w)[anchor[i] - d].view(np.int64) for w in (0, 1))]


def _in_texts(docs: DataFrame, look, start, end, schema: str, told: int) -> DataFrame:
    """What ``look`` finds in the texts of (text, list of structs), with the first ``told`` fields of each struct before it.

    The other three fields are handed to ``look``, the first of them counted from the bytes it gets: those of structs that
    lie together, from the least ``start`` to the greatest ``end`` of these fields.
    """
    names_, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = [{"int": pa.int32(), "long": pa.int64()}[t] for t in types]

    def run(batches):
        for b in slices(batches, 256):
            out: list[list[np.ndarray]] = [[] for _ in kinds]
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            fields = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in lists.values.flatten()]
            for text, lo, hi in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                whole, mine = _bytes(text), [f[lo:hi] for f in fields]
                first = start(*mine[told:])
                at = np.argsort(first, kind="stable")
                first, cut = first[at], 0
                while cut < len(at):
                    to = int(np.searchsorted(first, first[cut] + SEGMENT // 2))
                    some, base = [f[at[cut:to]] for f in mine], int(first[cut])
                    raw = whole[base : int(end(*some[told:]).max())]
                    i, found = look(raw, np.stack([some[told] - base, *some[told + 1 :]]))
                    for o, x in zip(out, (*(f[i] for f in some[:told]), *found), strict=True):
                        o.append(x)
                    cut = to
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else [], k) for o, k in zip(out, kinds, strict=True)], names_)

    return docs.mapInArrow(run, schema)


def _stretches(docs: DataFrame) -> DataFrame:
    """Windows of chosen runs (ctx, ctx2, w, first, count, rel), in stretches of STRETCH by distance from the anchor.

    hull, hull2: names of all bytes of the stretch; core: of the bytes that any windows of such a stretch share.
    """
    schema = "ctx long, ctx2 long, w int, stretch int, near int, far int, hull long, hull2 long, core long"
    return _in_texts(docs, _stretches_of, lambda first, count, rel: first, lambda first, count, rel: first + count - 1 + LENGTH, schema, 3)


def _windows(docs: DataFrame) -> DataFrame:
    """Windows of parts of runs (ctx, ctx2, w, anchor, near, far), by their buckets refined to LENGTH bytes."""
    schema = "ctx long, ctx2 long, w int, d int, name long, name2 long"
    return _in_texts(docs, _windows_of, lambda anchor, near, far: anchor - far, lambda anchor, near, far: anchor - near + LENGTH, schema, 3)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Of (key, text): a table of key and the list of [lo, hi] window starts whose LENGTH bytes also start elsewhere."""
    occurrences = saved(_occurrences(docs))
    # what is joined to hot buckets is a table, so that both sides are plain shuffles, whose large parts Spark splits
    again = saved(occurrences.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    found = saved(occurrences.join(again, "bucket"))
    dropped(occurrences, again)
    each = found.groupBy("ctx", "ctx2").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "first", "count", "rel")).alias("r"), F.min("bucket").alias("bucket")
    )
    each = saved(each.select("ctx", "ctx2", "bucket", F.least("n", F.lit(2)).cast("int").alias("w"), "r.*"))
    kinds = saved(each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("w").alias("least")).where("n > 1 and least = 1").select("bucket"))
    open_ = each.join(kinds, "bucket")
    runs = open_.groupBy("key").agg(F.collect_list(F.struct("ctx", "ctx2", "w", "first", "count", "rel")).alias("runs"))
    parts = saved(_stretches(docs.join(runs, "key").select("text", "runs")))
    hulls = saved(parts.groupBy("hull", "hull2").agg(F.least(F.sum("w"), F.lit(2)).cast("int").alias("hw")))
    known = saved(parts.join(hulls, ["hull", "hull2"]).select("ctx", "ctx2", "near", "far", "w", "core", "hw"))
    dropped(kinds, parts, hulls)
    cores = saved(known.groupBy("core").agg(F.sum("w").alias("cw"), F.min("hw").alias("hw")).where("cw > 1 and hw = 1").select("core"))
    doubt = known.join(cores, "core").select("ctx", "ctx2", "near", "far", "hw")
    # the names of single windows are worked out only where stretches leave doubt
    of_run = each.select("ctx", "ctx2", "key", (F.col("first") + F.col("rel")).alias("anchor"))
    opened = doubt.join(of_run, ["ctx", "ctx2"]).groupBy("key").agg(F.collect_list(F.struct("ctx", "ctx2", "hw", "anchor", "near", "far")).alias("parts"))
    opened = saved(opened)
    alone = saved(_windows(docs.join(opened, "key").select("text", "parts")))
    dropped(cores, opened)
    twice = saved(alone.groupBy("name", "name2").agg(F.sum("w").alias("n")).where("n > 1").select("name", "name2"))
    more = alone.where("w = 1").join(twice, ["name", "name2"]).select("ctx", "ctx2", F.col("d").alias("near"), F.col("d").alias("far"))
    kept = known.where("w = 1 and hw > 1").select("ctx", "ctx2", "near", "far").unionByName(more)
    lists = kept.groupBy("ctx", "ctx2").agg(F.collect_list(F.struct("near", "far")).alias("parts"))
    state = saved(each.select("ctx", "ctx2", "w").join(lists, ["ctx", "ctx2"], "left").where("w > 1 or parts is not null"))
    dropped(each, known, alone, twice)
    whole = F.array(F.struct(F.col("first").alias("lo"), (F.col("first") + F.col("count") - 1).alias("hi")))
    anchor = F.col("first") + F.col("rel")
    some = F.transform("parts", lambda p: F.struct((anchor - p["far"]).alias("lo"), (anchor - p["near"]).alias("hi")))
    by_run = found.select("key", "ctx", "ctx2", "first", "count", "rel").join(state, ["ctx", "ctx2"])
    by_run = by_run.select("key", F.when(F.col("w") > 1, whole).otherwise(some).alias("runs"))
    out = saved(by_run.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    dropped(found, state)
    return out


def _spans(n: int, runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    edge = np.zeros(n + 1, np.int32)
    for r in runs or []:
        edge[r["lo"]] += 1
        edge[r["hi"] + LENGTH] -= 1
    gone = np.concatenate([[False], np.cumsum(edge[:n]) > 0, [False]])
    at = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
    return list(zip(at[::2], at[1::2], strict=True))


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(raw)], strict=True))


def _with_runs(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    key = unused(docs, "suffix_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    runs = repeated_runs(keyed.where(F.length(text_col) > 0).select(F.col(key).alias("key"), F.col(text_col).alias("text")))
    found = unused(docs, "suffix_runs")
    small = runs.select(F.col("key").alias(key), F.col("runs").alias(found))
    return keyed.join(small, key, "left").drop(key), found


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every document."""
    whole, found = _with_runs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")

    def run(ids, texts, runs):
        rows = []
        for doc, text, r in zip(ids, texts, runs, strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans = _spans(len(raw), r)
            kept = _cut(raw, spans)
            rows.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        return list(zip(*rows, strict=True)) or [[]] * 6

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return map_columns(whole.select("doc_id", "text", found), run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut from the text; a character cut through goes with them. All columns stay."""
    whole, found = _with_runs(docs, id_col, text_col)
    at = docs.columns.index(text_col)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns)

    def run(*cols):
        texts = []
        for text, r in zip(cols[at], cols[-1], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            texts.append(_cut(raw, _spans(len(raw), r)).decode("utf-8", "ignore") if r else text)
        return [*cols[:at], texts, *cols[at + 1 : -1]]

    return map_columns(whole.select(*docs.columns, found), run, schema)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
