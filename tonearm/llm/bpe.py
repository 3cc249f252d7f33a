"""Byte-level BPE over overlapping chunks, and decoding.

Every text is a row of chunks that overlap, most texts of one. Each chunk is split into pre-tokens from its own first
character, right or wrong, in parallel. Where a chunk and the one before it share a pre-token boundary, they have
resynchronised: all later boundaries of the later chunk are right, for a split depends only on what follows it. The
chunks are stitched at the last such boundary of an overlap, and the pieces between these places are encoded, again in
parallel; where an overlap has none, both chunks are one piece. Boundaries within AHEAD characters of a chunk's end
don't count, as what follows could change them, nor those after white space, where a piece that ends there could be
split in another way.

Null and empty texts have no ids. Equal rows encode alike, an empty table gives an empty result, other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import map_columns, saved
from tonearm.llm.tokens import packed, tiktoken_encoding

CHUNK, OVERLAP, AHEAD = 16_384, 256, 8
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_STATE: dict[tuple[str, str], tuple] = {}


def _tools(vocabulary: str, pattern: str):
    """The tokenizer and the bytes of each id, once for each worker process."""
    if (vocabulary, pattern) not in _STATE:
        enc = tiktoken_encoding(vocabulary, pattern)
        raw = {i: enc.decode_single_token_bytes(i) for i in range(enc.n_vocab) if i <= enc.max_token_value}
        _STATE[vocabulary, pattern] = enc, raw
    return _STATE[vocabulary, pattern]


def seen_ends(chunk: str, pattern, overlap: int) -> tuple[list[int], list[int]]:
    """Where pre-tokens of a chunk end, among its first and among its last ``overlap`` characters, as far as they count."""
    first, last = len(chunk) - overlap, len(chunk) - AHEAD
    ends = [0, *(m.end() for m in pattern.finditer(chunk))]
    ends = [e for e in ends if (e <= overlap or e >= first) and e <= last and (not e or not chunk[e - 1].isspace())]
    return [e for e in ends if e <= overlap], [e for e in ends if e >= first]


def _pieces(chunks: DataFrame, pattern: str) -> DataFrame:
    """(key, doc_id, place, text) of the pieces of saved chunks (key, doc_id, place, chunk), from the places where they stitch."""
    overlap = OVERLAP

    def ends(keys, places, texts):
        import regex

        rx = regex.compile(pattern)
        both = [seen_ends(t, rx, overlap) for t in texts]
        told = [[[p + e for e in side] for side in sides] for p, sides in zip(places, both, strict=True)]
        return [keys, places, [len(t) + p for p, t in zip(places, texts, strict=True)], [h for h, _ in told], [t for _, t in told]]

    schema = "key long, place long, stop long, head array<long>, tail array<long>"
    seen = map_columns(chunks.select("key", "place", "chunk"), ends, schema)
    order = Window.partitionBy("key").orderBy("place")
    met = seen.withColumn("at", F.array_max(F.array_intersect("head", F.lag("tail").over(order))))
    spots = met.select(
        "key", "place",
        F.coalesce("at", F.lag("stop").over(order), F.lit(0)).alias("lo"),
        F.coalesce(F.lead("at").over(order), "stop").alias("hi"),
        F.count("at").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"),
    )
    part = F.substr("chunk", (F.col("lo") - F.col("place") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    parts = chunks.join(spots, ["key", "place"]).select("key", "doc_id", "piece", "place", part.alias("part"))
    whole = parts.groupBy("key", "piece").agg(F.first("doc_id").alias("doc_id"), F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "part"))).alias("p"))
    return whole.select("key", "doc_id", "place", F.array_join("p.part", "").alias("text"))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Ids of every text; with ``digests`` their count and digests and that of the decoded bytes, else the ids as bytes.

    Texts of one chunk are one piece, encoded where they are read. Only the chunks of longer ones are shuffled, one key
    a chunk; the ids of a text meet again at the end.
    """
    schema = SCHEMA if digests else "doc_id long, ids binary"
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def told(docs_, encoded):
        raw = _tools(vocabulary, pattern)[1]
        if not digests:
            return [docs_, encoded]
        ids = [np.frombuffer(x, "<u4").tolist() for x in encoded]
        sha = [hashlib.sha256(x).hexdigest() for x in encoded]
        return [docs_, [len(x) for x in ids], sha, [hashlib.sha256(b"".join(map(raw.__getitem__, x))).hexdigest() for x in ids]]

    def ids_of(texts):
        encoding = _tools(vocabulary, pattern)[0]
        return [packed(encoding.encode_ordinary(t)) for t in texts]

    size, step = F.length("text"), CHUNK - OVERLAP
    near = map_columns(plain.where(size <= CHUNK), lambda ids, texts: told(ids, ids_of(texts)), schema)
    spots = F.transform(
        F.sequence(F.lit(0), ((size - OVERLAP - 1) / step).cast("int")),
        lambda i: F.struct((i * step).cast("long").alias("place"), F.substr("text", i * step + 1, F.lit(CHUNK)).alias("chunk")),
    )
    far = plain.where(size > CHUNK).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    chunks = far.select("key", "doc_id", F.explode(spots).alias("c")).select("key", "doc_id", "c.place", "c.chunk")
    chunks = saved(chunks.repartition("key", "place"))  # dealt before they are written, so that this shuffle goes at once
    encoded = map_columns(_pieces(chunks, pattern), lambda k, d, p, t: [k, d, p, ids_of(t)], "key long, doc_id long, place long, ids binary", 64)
    gathered = encoded.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("p"))
    long = map_columns(gathered.select("doc_id", "p.ids"), lambda ids, parts: told(ids, [b"".join(x) for x in parts]), schema, 16)
    return near.unionByName(long)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text as bytes) from (doc_id, ids as bytes): the raw bytes of the ids, one after the other."""

    def run(docs, ids):
        raw = _tools(vocabulary, pattern)[1]
        return [docs, [b"".join(map(raw.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]]

    return map_columns(encoded.select("doc_id", "ids"), run, "doc_id long, text binary")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
