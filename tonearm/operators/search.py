"""Vector and hybrid retrieval for many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions import text as X
from tonearm.functions.text import pill_score
from tonearm.functions.vectors import dot_product, fuse_features, l2_normalize
from tonearm.operators.blocks import cosine, nearest, vectors_of

#: Lengths of the three blocks; production vectors are 512, 40 and 12 long.
SIZES = (48, 12, 4)
#: Prompts that evidence is gathered from, at most.
PROMPTS = 1024


def fused(v: Column, sizes: tuple[int, int, int] = SIZES) -> Column:
    a, b, c = sizes
    return fuse_features(F.slice(v, 1, a), F.slice(v, a + 1, b), F.slice(v, a + b + 1, c), sizes)


def similar_tracks(vectors: DataFrame, is_seed: Column, k: int) -> DataFrame:
    """The k nearest listenable tracks of each seed by fused cosine distance (to nine places), itself left out."""
    f = vectors.select(F.col("track_id").alias("id"), "ok", fused(F.col("embedding")).alias("v"), is_seed.alias("seed_"))
    d = nearest(f.where("seed_"), f.where("ok"), k, cosine, others=True)
    return d.select(F.col("query").alias("seed"), F.col("id").alias("track_id"), "rank", F.round(F.round(1 - F.col("score"), 9), 6).alias("distance"))


def word_scores(tracks: DataFrame, queries: DataFrame) -> DataFrame:
    """(track_id, found) of tracks that hold words of the queries (query, text): the mean weight of each query's words.

    A track's fields become words once, with the weights of the fields that hold each; the words meet those of the queries
    by an equi-join.
    """
    each = queries.select("query", X.extract_words(F.col("text")).alias("words"))
    asked = each.select("query", F.size("words").alias("n"), F.explode("words").alias("word")).groupBy("query", "n", "word").agg(F.count("*").alias("times"))
    fields = ((X.tag_words(F.col("tags")), X.TAG), (X.extract_words(F.col("album_title")), X.ALBUM), (X.extract_words(F.col("creator")), X.CREATOR), (X.extract_words(F.col("title")), X.TRACK))
    entries = F.concat(*(F.transform(F.array_distinct(words), lambda w, x=weight: F.struct(w.alias("word"), F.lit(x).alias("weight"))) for words, weight in fields))
    held = tracks.select("track_id", F.explode(entries).alias("e")).select("track_id", "e.word", "e.weight")
    met = held.join(asked, "word").groupBy("track_id", "query", "n").agg(F.sum(F.col("weight") * F.col("times")).alias("s"))
    found = F.struct("query", (F.col("s") / F.col("n")).alias("score"))
    return met.groupBy("track_id").agg(F.collect_list(found).alias("found"))  # a number a query at most


def _hybrid(j: DataFrame) -> Column:
    words = pill_score(F.col("query"), F.col("title"), F.col("tags"), F.col("album_title"), F.col("creator"))
    return F.round(0.5 * dot_product(l2_normalize(F.col("prompt")), F.slice("embedding", 1, SIZES[0])) + 0.5 * words, 6)


def search_by_text(tracks: DataFrame, prompt: DataFrame, n: int) -> DataFrame:
    """The n best by half the prompt's dot product and half the words' score; ``prompt`` is one row (prompt, query)."""
    j = tracks.crossJoin(F.broadcast(prompt.limit(1)))
    return j.select("track_id", _hybrid(j).alias("score")).orderBy(F.desc("score"), "track_id").limit(n)


def pill_feed(tracks: DataFrame, prompts: DataFrame, n: int) -> DataFrame:
    """The same for every pill (pill_id, prompt, query): products of blocks, to which the words' scores are added."""
    q = prompts.select(F.col("pill_id").cast("long").alias("query"), "prompt", F.col("query").alias("text"))
    words = word_scores(tracks, q)
    half = F.transform("found", lambda f: F.struct(f["query"].alias("query"), (0.5 * f["score"]).alias("score")))
    t = tracks.join(words, "track_id", "left").select(F.col("track_id").alias("id"), F.slice("embedding", 1, SIZES[0]).alias("v"), half.alias("found"))

    def score(prompt, clap):
        size = np.linalg.norm(prompt, axis=1, keepdims=True)
        return np.round(0.5 * (prompt / np.where(size > 0, size, 1)) @ clap.T, 12)

    s = nearest(q.select(F.col("query").alias("id"), F.col("prompt").alias("v")), t, n, score)
    return s.select(F.col("query").alias("pill_id"), F.col("id").alias("track_id"), "rank", F.round("score", 6).alias("score"))


def prompt_evidence(tracks: DataFrame, prompts: DataFrame, n_positive: int = 4, n_negative: int = 7) -> DataFrame:
    """Mean similarity to positive and negative prompts, the margin, and the strongest negative where it is over 0.

    Prompts are a handful and go along with the tasks; a batch of tracks meets them all in one product.
    """
    rows = prompts.orderBy("prompt_id").limit(PROMPTS + 1).collect()
    if len(rows) > PROMPTS:
        raise ValueError(f"more than {PROMPTS} prompts")
    ids, good = np.array([r["prompt_id"] for r in rows], np.int64), np.array([r["positive"] for r in rows], bool)
    p = np.array([r["prompt"] for r in rows], float)
    shape = pa.schema([("track_id", pa.int64()), ("p", pa.float64()), ("q", pa.float64()), ("most", pa.float64()), ("which", pa.int64())])

    def run(batches):
        for b in batches:
            dots = vectors_of(b.column("clap")) @ p.T
            bad = dots[:, ~good]
            most = bad.max(axis=1, initial=-np.inf)
            which = ids[~good][bad.argmax(axis=1)] if bad.shape[1] else np.zeros(len(dots), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b.column("track_id")), pa.array(dots[:, good].sum(axis=1) / n_positive), pa.array(bad.sum(axis=1) / n_negative), pa.array(most), pa.array(which)], schema=shape)

    clap = F.col("clap").cast("array<double>").alias("clap")
    g = tracks.where("clap is not null").select(F.col("track_id").cast("long").alias("track_id"), clap).mapInArrow(run, "track_id long, p double, q double, most double, which long")
    return g.select(
        "track_id", F.round("p", 6).alias("positive"), F.round("q", 6).alias("negative"), F.round(F.col("p") - F.col("q"), 6).alias("margin"),
        F.when(F.col("most") > 0, F.col("which")).alias("strongest"),
    )


def eval_retrieval(tracks: DataFrame, prompts: DataFrame, k: int) -> DataFrame:
    """The k best completed tracks of each prompt by cosine, to four places, with what is known of them."""
    t = tracks.select(F.col("track_id").alias("id"), F.col("clap").alias("v"))
    q = prompts.select(F.col("prompt_id").cast("long").alias("id"), F.col("prompt").alias("v"))
    s = nearest(q, t, k, lambda a, b: np.round(cosine(a, b), 4))
    top = s.select(F.col("query").alias("prompt_id"), F.col("id").alias("track_id"), "rank", F.round("score", 4).alias("score"))
    more = [c for c in tracks.columns if c not in ("track_id", "clap")]
    return top.join(tracks.select("track_id", *more), "track_id") if more else top
