"""Vector code compression: product codes of integer vectors, with distances from dictionaries of values.

Components become integers floor(scale * x). Blocks of vectors hold, for each dimension, the dictionary of the integers
that occur there and a code a vector. In a round every block tabulates the squared differences of each dictionary's
integers to all entries of the codebook; a part's distances are gathers from these tables by code, added up over its
dimensions. New entries are sums, which are counts of the codes times the dictionaries, divided by counts, rounded down.
Only codebooks and their sums (parts x entries x dimensions) pass through the driver. Dictionaries belong to a block and
have no more integers than it has vectors, so nothing grows with the data; all arithmetic is exact at any size of numbers.

Vectors that are null, empty or hold null or non-finite components take no part, nor do those whose width is not the
most frequent one. Repeated rows count each; first entries are the vectors of the smallest ids (rows with null ids last,
equal ids by vector), and with fewer vectors there are fewer entries. A width that is no multiple of the number of parts
gives longer parts first; one under it gives empty parts, all of index 0. Ties go to the lower index, unused entries stay. Sums no
long holds are null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tonearm.llm.common import saved
from tonearm.llm.vectors import joined, matrix, sound

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6

#: A codebook: for each part a matrix of entries x dimensions.
Books = list[np.ndarray]


def _whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v) as doubles, which hold these integers exactly."""
    return np.floor(scale * v)


def _integers(v: np.ndarray, wide: bool) -> np.ndarray:
    return np.array([int(x) for x in v.ravel()], object).reshape(v.shape) if wide else v.astype(np.int64)


def _packed(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """Blocks: ids, labels, the sizes of the dictionaries, their integers end to end, and the codes."""
    label = to_arrow_type(rows.schema["label"].dataType)
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(label)), ("sizes", pa.list_(pa.int32())), ("values", pa.binary()), ("codes", pa.binary())])

    def run(batches):
        for t in joined(batches, width):
            x = _whole(matrix(t["v"], width), scale)
            found = [np.unique(x[:, i], return_inverse=True) for i in range(width)]
            codes = np.stack([c for _, c in found]).astype("<u2")
            held = ([t["id"].to_pylist()], [t["label"].to_pylist()], [[len(v) for v, _ in found]], [np.concatenate([v for v, _ in found]).astype("<f8").tobytes()], [codes.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, kind, strict=True)], schema=kind)

    shape = f"ids array<long>, labels array<{rows.schema['label'].dataType.simpleString()}>, sizes array<int>, values binary, codes binary"
    return saved(rows.mapInArrow(run, shape))


class Block:
    """The vectors of a block as dictionaries and codes."""

    def __init__(self, sizes: list[int], values: bytes, codes: bytes, books: Books):
        flat = np.frombuffer(values, "<f8")
        most = max([float(np.abs(flat).max(initial=0)), *(float(max(map(abs, b.ravel().tolist()), default=0)) for b in books)])
        self.wide = 4 * most * most * len(sizes) >= 2.0**62  # then Python's integers stand in the same arrays
        self.values = np.split(_integers(flat, self.wide), np.cumsum(sizes)[:-1])
        self.codes = np.frombuffer(codes, "<u2").reshape(len(sizes), -1)
        self.books = books

    def assigned(self) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each part and vector, squared distance of each vector over all parts)."""
        n, at = self.codes.shape[1], 0
        entry, error = np.zeros((len(self.books), n), np.uint8), np.zeros(n, object if self.wide else np.int64)
        for p, book in enumerate(self.books):
            far = np.zeros((n, len(book)), error.dtype)
            for d in range(book.shape[1]):
                table = (self.values[at + d][:, None] - book[None, :, d].astype(error.dtype)) ** 2
                far += table[self.codes[at + d]]
            entry[p] = far.argmin(axis=1)
            error += far[np.arange(n), entry[p]]
            at += book.shape[1]
        return entry, error

    def sums(self, entry: np.ndarray):
        """(part, entry, place, sum) of the vectors assigned to each entry; place -1 has their number."""
        at = 0
        for p, book in enumerate(self.books):
            members = entry[p].astype(np.int64)
            for e, c in enumerate(np.bincount(members, minlength=len(book)).tolist()):
                yield p, e, -1, c
            for d in range(book.shape[1]):
                v = self.values[at + d]
                often = np.bincount(members * len(v) + self.codes[at + d], minlength=len(book) * len(v)).reshape(len(book), len(v))
                for e, s in enumerate((often.astype(v.dtype) @ v).tolist()):
                    yield p, e, d, s
            at += book.shape[1]


def _limbs(s: int) -> list[int]:
    """A number as signed digits to the base 2**32, so that columns of longs can add up numbers of any size."""
    sign, s, out = (1 if s >= 0 else -1), abs(s), []
    while s:
        out.append(sign * (s & 0xFFFFFFFF))
        s >>= 32
    return out


def _round(blocks: DataFrame, books: Books) -> Books:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""

    def run(batches):
        total: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for r in b.to_pylist():
                block = Block(r["sizes"], r["values"], r["codes"], books)
                for *key, s in block.sums(block.assigned()[0]):
                    total[tuple(key)] = total.get(tuple(key), 0) + s
        rows = [(*k, i, x) for k, s in total.items() for i, x in enumerate(_limbs(s))]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "place", "limb", "s"])

    parts = blocks.select("sizes", "values", "codes").mapInArrow(run, "part int, entry int, place int, limb int, s long")
    total: dict[tuple[int, int, int], int] = {}
    for r in parts.groupBy("part", "entry", "place", "limb").agg(F.sum("s").alias("s")).collect():  # bounded by the codebooks
        key = r["part"], r["entry"], r["place"]
        total[key] = total.get(key, 0) + (r["s"] << 32 * r["limb"])
    out = [b.copy() for b in books]
    for (p, e, place), count in total.items():
        if place == -1:
            out[p][e] = [total.get((p, e, d), 0) // count for d in range(out[p].shape[1])]
    return out


def _told(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Books]:
    """((id, label, code, error) of every vector, codebooks): indexes of two hex digits in the order of the parts."""
    plain = vectors.select(F.col(id_col).alias("key"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows, width = sound(plain, "key", "vector", scale, "label")
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect() if width else []
    start = np.array([[int(x) for x in _whole(np.array(r["v"]), scale)] for r in first], object).reshape(len(first), width)
    books = np.array_split(start, parts, axis=1)
    blocks = _packed(rows, width, scale)
    for _ in range(rounds if first else 0):
        books = _round(blocks, books)
    label = to_arrow_type(rows.schema["label"].dataType)

    def run(batches):
        for b in batches:
            for r, ids, labels in zip(b.select(["sizes", "values", "codes"]).to_pylist(), b.column("ids"), b.column("labels"), strict=True):
                entry, error = Block(r["sizes"], r["values"], r["codes"], books).assigned()
                told = np.ascontiguousarray(entry.T).tobytes().hex()
                code = [told[i : i + 2 * parts] for i in range(0, len(told), 2 * parts)]
                held = pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, labels.values.cast(label), pa.array(code, pa.string()), held], names=["id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return blocks.mapInArrow(run, f"id long, label {kind}, code string, error long"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = saved(coded)
    whole = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count("*"), whole).alias("label_error"))
    both = coded.join(total, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(_told(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB's rounds one after the other."""
    near = """a{r} as (select p.vec_id, p.part, p.s, b.entry, list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
      from p join b{r} b on b.part = p.part qualify row_number() over (partition by p.vec_id, p.part order by d, b.entry) = 1)"""
    mean = """m{r} as (select part, entry, list(m order by i) as s from (select part, entry, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as m
      from (select part, entry, unnest(s) as x, unnest(range(len(s))) as i from a{r}) group by all) group by all)"""
    book = "b{n} as (select b.part, b.entry, coalesce(list_transform(m.s, lambda x: cast(x as bigint)), b.s) as s from b{r} b left join m{r} m on m.part = b.part and m.entry = b.entry)"
    steps = [t.format(r=r, n=r + 1) for r in range(ROUNDS) for t in (near, mean, book)] + [near.format(r=ROUNDS)]
    return f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as w from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select vec_id, part, w[part * len(w) // {PARTS} + 1 : (part + 1) * len(w) // {PARTS}] as s from v, unnest(range({PARTS})) as t(part)),
b0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, s from p where vec_id in (select vec_id from v order by vec_id limit {ENTRIES})),
{", ".join(steps)},
k as (select sha256(string_agg(array_to_string(s, ','), ',' order by part, entry)) as h from b{ROUNDS}),
e as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by vec_id)
select e.vec_id, code, error, cast(sum(error) over (partition by v.label) as bigint) as label_error, k.h as codebooks_sha256 from e join v on v.vec_id = e.vec_id, k
"""


ORACLE = _oracle()
