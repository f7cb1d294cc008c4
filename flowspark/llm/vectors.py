"""Which vectors take part in comparisons, and exact measures between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column, size: int) -> Column:
    """True for vectors of ``size`` finite components, not all zero."""
    x = vector.cast("array<double>")
    return F.coalesce((F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def vector_size(rows: DataFrame, vector: str) -> int:
    """The commonest length among non-null vectors (the longer on a tie);
    vectors of other lengths cannot be compared. 0 without vectors."""
    top = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return int(top["d"]) if top else 0


def matrix(column: pa.Array | pa.ChunkedArray, size: int, kind=np.float64) -> np.ndarray:
    """List arrays of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, size)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``a`` to that of ``b`` in double
    precision, components in order, so that equal pairs give equal results."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, as above."""
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        ab += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return ab / (np.sqrt(aa) * np.sqrt(bb))
