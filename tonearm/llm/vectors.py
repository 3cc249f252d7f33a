"""What the operators on vectors share: sound rows of one width, and blocks of rows for tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers a block holds at most, rows a block holds at most (their numbers fit 16 bits).
NUMBERS, ROWS = 1 << 22, 1 << 16


def sound(vectors: DataFrame, id_col: str, vector_col: str, scale: int, *more: str) -> tuple[DataFrame, int]:
    """Rows (id, v, ...) with whole vectors of the most frequent width (the larger of equally frequent ones), and that width.

    Vectors that are null, empty, or hold null or non-finite components go, and so do those with a component that is no
    longer finite times ``scale``. Of several widths only one can be fitted together.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *(F.col(c) for c in more))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    most = widths.orderBy(F.desc("n"), F.desc("width")).first()
    width = most["width"] if most else 0
    return rows.where(F.size("v") == width), width


def joined(batches, width: int) -> Iterator:
    """Record batches of a task put together to tables of ROWS rows and about NUMBERS numbers at most."""
    import pyarrow as pa

    most, held, rows = max(1, min(ROWS, NUMBERS // max(1, width))), [], 0
    for b in batches:
        for i in range(0, b.num_rows, most):
            part = b.slice(i, most)
            if held and rows + part.num_rows > most:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def matrix(column, width: int) -> np.ndarray:
    """A column of lists of ``width`` doubles as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
