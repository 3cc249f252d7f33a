"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares of the three blocks of a fused vector.
WEIGHTS = (0.60, 0.25, 0.15)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot_product(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n), lambda x, y: x * y)
    return F.aggregate(both, F.lit(0.0), lambda t, x: t + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda t, x: t + x * x))


def l2_normalize(v: Column) -> Column:
    """A unit vector; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within 0 and 2; 1 where either vector is zero."""
    size = norm(a) * norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_product(a, b) / size))
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - cosine)


def _scaled(v: Column, weight: float) -> Column:
    return F.transform(v, lambda x: x * weight)


def fuse_features(clap: Column, mfcc: Column, chroma: Column, sizes: tuple[int, int, int]) -> Column:
    """The three blocks, weighted, end to end; a wrong length is an error."""
    parts = []
    for block, weight, size in zip((clap, mfcc, chroma), WEIGHTS, sizes, strict=True):
        ok = F.when(F.size(block) == size, doubles(block)).otherwise(F.raise_error(F.lit(f"expected {size} values")).cast("array<double>"))
        parts.append(_scaled(ok, weight))
    return F.concat(*parts)
