"""Distances of vectors: Catalyst expressions, and the same in NumPy for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = ("l2", "cosine", "ip")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, space: str) -> Column:
    """``l2``: squared Euclidean; ``cosine``: 1 - cosine, 1 for a zero vector; ``ip``: 1 - inner product.

    Null if a vector is null, holds a null, or the lengths differ.
    """
    if space == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if space == "cosine":
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / norms)
    if space == "ip":
        return 1.0 - dot(a, b)
    raise ValueError(f"unknown space {space!r}; one of {SPACES}")


def normalized(a: Column) -> Column:
    """The unit vector of ``a``; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") / n))


def matrix(a: np.ndarray, b: np.ndarray, space: str) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``, in double precision."""
    if space == "l2":
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T), 0.0)
    if space == "cosine":
        na, nb = (np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        return 1.0 - (a / np.where(na == 0, 1, na)) @ (b / np.where(nb == 0, 1, nb)).T
    if space == "ip":
        return 1.0 - a @ b.T
    raise ValueError(f"unknown space {space!r}; one of {SPACES}")


def exact(q: np.ndarray, x: np.ndarray, space: str) -> np.ndarray:
    """Distances of one vector from the rows of ``x`` without the expansion that costs ``l2`` digits."""
    return ((x - q) ** 2).sum(1) if space == "l2" else matrix(q[None], x, space)[0]


def as_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the positions of the vectors of length ``dim`` without nulls in a list column, and their values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = lengths == dim
    if column.values.null_count:
        ok &= np.array([v is not None and None not in v for v in column.to_pylist()])
    at = np.flatnonzero(ok)
    flat = column.take(pa.array(at, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return at, flat.reshape(len(at), dim)
