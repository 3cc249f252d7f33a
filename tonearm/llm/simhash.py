"""SimHash near-dedup: fingerprints that differ in two bits at most, found by deletion variants of their halves.

A fingerprint has a bit set where over half of the text's 3-word shingles (repeats included) have it set in their XXH64.
Two fingerprints that differ in two bits at most differ in one bit at most in one of their two 32-bit halves. So every
distinct fingerprint enters an index once for each bit of each half, with that bit left out; those that share a variant
meet there and are compared as a whole. Where one value of a half belongs to more than CROWD different fingerprints, these,
and all whose half is one bit from it, leave the index: each names the 64 numbers one bit away and itself, and those with
a common name, which are 65 at most, are two bits apart at most, so all of them link to the least. No bucket of either
way grows with the data, and no link is lost.

Null texts and texts without words have the fingerprint zero and link as any other; texts of one or two words are one
shingle. Equal texts have equal fingerprints and are one node, however many there are. Every row gets its component, the
smallest doc_id that links lead to; rows with null ids too, but they give no component its name, so it is null where no
other row is linked. Repeated rows each come out. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import documents, dropped, map_columns, saved
from tonearm.llm.components import components

#: Words in a shingle, seed of the hash, bits that links may differ in.
WORDS, SEED, MOST = 3, 42, 2
#: Different fingerprints that may share the value of a half before they leave the index.
CROWD = 64
#: Shingles hashed together.
STEP = 1 << 16

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed number."""
    raw = (text or "").encode("utf-8", "replace").lower().translate(_SPACES).strip()
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    if not raw:
        return 0
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    width = min(WORDS, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    often = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), STEP):
        at = zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist(), strict=True)
        h = np.array([digest(raw[s:e], SEED) for s, e in at], "<u8")
        often += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * often > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row, as numbers."""

    def run(ids, texts):
        return ids, [fingerprint(t) for t in texts]

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_columns(rows, run, "id long, fingerprint long")


def _halves(prints: DataFrame) -> DataFrame:
    f = F.col("fingerprint")
    both = F.array(f.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f, 32))
    return prints.select("fingerprint", F.posexplode(both).alias("half", "value"))


def _variants(halves: DataFrame) -> DataFrame:
    """Every half 32 times, each time without one bit: ``key`` holds the half, the bit's place and the other bits."""
    each = halves.select("fingerprint", "half", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("place"))
    bit = F.expr("shiftleft(1L, place)")
    key = F.expr("shiftleft(cast(half * 32 + place as bigint), 32)").bitwiseOR(F.col("value").bitwiseAND(F.bitwise_not(bit)))
    return each.select(key.alias("key"), "fingerprint", (F.col("value").bitwiseAND(bit) != 0).alias("bit"), (F.col("place") == 0).alias("first"))


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints of ``prints`` (one row each) whose components are those of all links."""
    halves = _halves(prints)
    crowded = saved(halves.groupBy("half", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("half", "value"))
    beside = F.expr("transform(sequence(0, 31), p -> value ^ shiftleft(1L, p))")
    around = crowded.unionByName(crowded.select("half", F.explode(beside).alias("value"))).distinct()
    # Spark tells the size of exploded rows by their width, not by their number, and would send 64 rows a fingerprint to all
    apart = saved(halves.join(around.hint("merge"), ["half", "value"], "left_semi").select("fingerprint").distinct())
    index = _variants(halves.join(crowded, ["half", "value"], "left_anti"))
    a, b = (index.select("key", F.col("fingerprint").alias(n), F.col("bit").alias(f"{n}_bit"), "first") for n in "ab")
    # two with the same half would meet under every place: the first is enough
    meet = (F.col("a") < F.col("b")) & ((F.col("a_bit") != F.col("b_bit")) | F.col("first"))
    met = a.join(b.drop("first").hint("merge"), "key").where(meet & _near("a", "b")).select("a", "b")
    balls = F.expr("concat(array(fingerprint), transform(sequence(0, 63), p -> fingerprint ^ shiftleft(1L, p)))")
    named = apart.select("fingerprint", F.explode(balls).alias("name"))
    stars = named.groupBy("name").agg(F.collect_list("fingerprint").alias("all")).where(F.size("all") > 1)  # 65 at most
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    out = saved(met.unionByName(stars).distinct())
    dropped(crowded, apart)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; the fingerprint as a number."""
    each = saved(fingerprints(docs, id_col, text_col))
    prints = saved(each.groupBy("fingerprint").agg(F.min("id").alias("first")))
    edges = links(prints.select("fingerprint"))
    rooted = components(edges)
    of = prints.join(rooted.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(of.join(least, "root").select("fingerprint", "component_id"))
    dropped(prints, edges, rooted)
    return each.join(named, "fingerprint").select("id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are linked to a smaller id. Repeated rows and rows with null ids stay."""
    found = near_copies(docs, id_col, text_col)
    go = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(id_col)).distinct()
    return docs.join(go, id_col, "left_anti").select(*docs.columns)


def op11_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_copies(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
