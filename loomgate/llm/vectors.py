"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that a rotation is fitted on at most: those with the smallest hash of vec_id.
FIT_ROWS = 4096


def finite(embedding: str | Column) -> Column:
    """Not null, without null, NaN or infinite components."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return e.isNotNull() & F.coalesce(~odd, F.lit(False))


def usable(embedding: str | Column) -> Column:
    """Finite, and not zero."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    return finite(e) & F.exists(e, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix, in the type they came in."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows in double precision, each by the power of two that brings its largest component near 1: squares stay finite, and cosines the same bits."""
    m = m.astype(np.float64)
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, initial=1e-300, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def lengths(vectors: DataFrame, column: str = "embedding") -> list[int]:
    """How long the vectors are: most tables have one length."""
    return sorted(r[0] for r in vectors.select(F.size(column)).distinct().collect())


def sample(vectors: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """At most so many vectors, of the length that most of them have."""
    got = [r[0] for r in vectors.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(rows).select("embedding").collect()]
    if not got:
        return np.zeros((0, 0))
    sizes = [len(v) for v in got]
    common = max(sorted(set(sizes)), key=sizes.count)
    return np.array([v for v in got if len(v) == common], np.float64)
