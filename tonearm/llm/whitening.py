"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

Entries become integers floor(scale * c) + shift, packed in blocks. Each step multiplies the blocks by a right vector v
(Xv, an entry a row) and gives back the sums of Xᵀ times the result, in one pass of which no row leaves its task. Left
vectors are held by the vectors w with u = Xw; a new one is made orthogonal to all before by its products with them,
which come from the same pass, and again if much cancelled; right vectors are made orthogonal to all before twice. So
X V = U B with a bidiagonal B of at most width x width numbers, whose SVD gives components and their deviations. Steps end
early only if the components wanted have converged and what is left of the trace is too little to hide another one.
Where a product vanishes the process goes on from a new direction; repeated deviations are found so.

Vectors that are null, empty or hold null or non-finite entries take no part, nor do those with entries whose integers
are over 2**53 or whose width is not the most frequent one. All others are fitted and come out, repeated rows and null
ids too. Directions without any spread are no components: an empty table, one row or equal rows give no rows.
``deviation`` is null where its exact value is over 2**63 - 1. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import saved
from tonearm.llm.vectors import joined, matrix, sound

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Sizes against the largest deviation that count as zero, and as converged.
ZERO, CLOSE = 1e-12, 1e-14

OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _packed(rows: DataFrame, width: int, scale: int, shift: int) -> DataFrame:
    """Blocks: ids, and the integers as bytes."""
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary())])

    def run(batches):
        for t in joined(batches, width):
            x = np.floor(scale * matrix(t["v"], width)).astype("<i8") + shift
            yield pa.RecordBatch.from_arrays([pa.array([t["id"].to_pylist()], kind.field(0).type), pa.array([x.tobytes()], pa.binary())], schema=kind)

    small = rows.where(~F.exists("v", lambda c: F.abs(c) * scale >= float(1 << 53)))
    return saved(small.mapInArrow(run, "ids array<long>, x binary"))


def _sums(blocks: DataFrame, partial: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all blocks of a function from a block's integers to a vector; tasks add theirs up first."""

    def run(batches):
        total = None
        for b in batches:
            for raw in b.column("x"):
                p = partial(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, width))
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total)), pa.int32()), "part": pa.array(total, pa.float64())})

    parts = blocks.select("x").mapInArrow(run, "place int, part double")
    got = parts.groupBy("place").agg(F.sum("part").alias("s")).collect()  # a row for each number of one such vector
    out = np.zeros(len(got))
    for r in got:
        out[r["place"]] = r["s"]
    return out


def totals(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension. Integers are split in two, so no partial sum overflows."""

    def run(batches):
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            for raw in b.column("x"):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, width)
                n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0)
        place = np.arange(-1, width, dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"place": pa.array(place), "low": pa.array(np.append(n, low)), "high": pa.array(np.append(0, high))})

    parts = blocks.select("x").mapInArrow(run, "place int, low long, high long").groupBy("place")
    wide = {c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "high")}
    got = {r["place"]: int(r["low"]) + (int(r["high"]) << 32) for r in parts.agg(*wide.values()).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(width)]


class Centre:
    """Subtracts the mean S / n of the integers: whole part exactly, then the rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole, self.rest = (np.array(a, np.int64) for a in zip(*(divmod(s, n) for s in sums), strict=True))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S)**2; None where a long cannot hold one."""
        far = x - self.whole
        most = (int(np.abs(far).max(initial=0)) + 1) * self.n
        y = far * self.n - self.rest if most * most * x.shape[1] < 1 << 63 else far.astype(object) * self.n - self.rest
        return [d if d < 1 << 63 else None for d in map(int, (y * y).sum(axis=1))]


def bidiagonalise(product: Callable, width: int, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as rows, deviations, trace) of the k largest, where ``product(w, W)`` gives Xᵀ(Xw), (XW)ᵀ(Xw), |Xw|² and |X|²."""
    rng = np.random.default_rng(seed)
    right, left, back, alphas, betas = [], [], [], [], []

    def orthogonal(q: np.ndarray) -> np.ndarray:
        basis = np.array(right).reshape(-1, width)
        for _ in range(2):
            q = q - basis.T @ (basis @ q)
        return q

    v, beta = rng.normal(size=width), 0.0
    v /= np.linalg.norm(v)
    while True:
        w = v - beta * left[-1] if left else v
        right.append(v)
        basis = np.array(left).reshape(-1, width)
        while True:
            g, c, square, trace = product(w, basis)
            w = w - basis.T @ c
            g = g - np.array(back).reshape(-1, width).T @ c
            stays = square - c @ c
            if stays > 0.5 * square or square <= trace * ZERO**2:  # else much cancelled: once more
                break
        if stays <= trace * ZERO**2:  # no spread along v beyond the left vectors so far
            alpha, w, g, q = 0.0, np.zeros(width), np.zeros(width), np.zeros(width)
        else:
            alpha = np.sqrt(stays)
            w, g = w / alpha, g / alpha
            q = orthogonal(g - alpha * v)
        alphas.append(alpha)
        left.append(w)
        back.append(g)
        beta = np.linalg.norm(q)
        b = np.diag(alphas) + np.diag(betas, 1)
        p, s, qt = np.linalg.svd(b)
        last = len(right) == width
        hidden = trace - (b * b).sum() - beta * beta
        if not last and len(s) > k and s[0] > 0:
            last = (beta * np.abs(p[-1, :k]) <= CLOSE * s[0]).all() and hidden < 0.999 * s[k - 1] ** 2
        if last:
            found = s > s[0] * ZERO
            comps = (qt @ np.array(right))[found][:k]
            return comps / np.linalg.norm(comps, axis=1, keepdims=True), s[found][:k], trace
        if beta <= ZERO * np.sqrt(trace):
            beta, q = 0.0, orthogonal(rng.normal(size=width))
        betas.append(beta)
        v = q / np.linalg.norm(q)


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each vector and component: projection over the component's deviation, and what the fit tells."""
    spark = vectors.sparkSession
    rows, width = sound(vectors, id_col, vector_col, scale)
    empty = spark.createDataFrame([], OUT)
    if not width:
        return empty
    blocks = _packed(rows, width, scale, shift)
    n, sums = totals(blocks, width)
    if not n:
        return empty
    centre = Centre(n, sums)

    def product(w: np.ndarray, basis: np.ndarray):
        def partial(x):
            y = centre(x)
            u = y @ w
            return np.concatenate([u @ y, (y @ basis.T).T @ u, [u @ u, (y * y).sum()]])

        got = _sums(blocks, partial, width)
        return got[:width], got[width:-2], got[-2], got[-1]

    if product(np.zeros(width), np.zeros((0, width)))[3] == 0:
        return empty
    comps, deviation, trace = bidiagonalise(product, width, k)
    project = comps.T * (np.sqrt(n) / deviation)
    explained = deviation**2 / trace
    many = len(deviation)

    def spread(x):
        z = centre(x) @ project
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    got = _sums(blocks, spread, width) / n
    off = got[many:].reshape(many, many) - np.outer(got[:many], got[:many]) - np.eye(many)
    error = float(np.abs(off).max())

    def run(batches):
        for b in batches:
            for ids, raw in zip(b.column("ids"), b.column("x"), strict=True):
                ids, every = ids.values, np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, width)
                for i in range(0, len(every), 4096):
                    x = every[i : i + 4096]
                    m = len(x)
                    yield pa.RecordBatch.from_pydict({
                        "id": ids.slice(i, m).take(pa.array(np.repeat(np.arange(m), many))), "component": pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), m)),
                        "n": pa.array(np.full(m * many, n)), "deviation": pa.array([d for d in centre.deviations(x) for _ in range(many)], pa.int64()),
                        "whitened": pa.array((centre(x) @ project).ravel()), "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * many, error)),
                    })

    return blocks.mapInArrow(run, OUT)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
