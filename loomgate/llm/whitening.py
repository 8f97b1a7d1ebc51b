"""Embedding whitening by LOBPCG: leading eigenvectors of the covariance without the covariance.

Vectors become integers x = floor(SCALE * c) + OFFSET. One pass sums them exactly (n, S). The covariance V of the rows
around S / n is only ever used as a product: V times a block B is the sum over rows of y (y' B), y centred first, so each
pass over the written rows gives a (dimensions x block) matrix, summed by Spark cell by cell. Around it runs LOBPCG: in
every round Rayleigh-Ritz on the iterate's block, the residuals' and the previous directions', all orthonormal (what
depends on others is dropped, so short vectors and equal eigenvalues do no harm); GUARD more columns than asked for speed it up. It ends
only when the residuals |V u - e u| of a fresh product of the final block are within TOLERANCE of the largest
eigenvalue, and raises if that is not reached in MOST rounds. Then every row is projected and scaled.

The driver holds blocks of (dimensions x 3 * (K + GUARD)) numbers, whatever the rows. Rows whose vector is null or holds
null or non-finite entries are dropped, as are those with an entry that has no long (|SCALE * c| of 2^62 or more).
Vectors of different lengths share no covariance: each length is whitened by itself, with its own n; so are repeated
rows rows of their own, and ties (equal eigenvalues) get any orthonormal basis. A component without variance (an eigenvalue
below 16 * dimensions * 2^-52 of the largest) can't be scaled to one: it gives no rows, nor do equal or single rows. Empty vectors have no
component. deviation is exact; where it is beyond a long, null. Eigenvectors have their largest entry positive. Further
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import discard, materialize, read
from .vectors import finite, lengths, matrix

K, SCALE, OFFSET = 32, 64, 1_000_000
GUARD, TOLERANCE, MOST = 8, 1e-12, 500
#: Rows of a product at a time.
_ROWS = 4096
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_EPS = float(np.finfo(float).eps)


def orthonormal(w: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what w's columns add to the orthonormal columns of against; none may be left."""
    length = np.sqrt(np.einsum("ij,ij->j", w, w))
    w = w[:, length > 0] / length[length > 0]
    for _ in range(2):
        w = w - against @ (against.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    u = u[:, s > 1e-8]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and coefficients of V within the span of the orthonormal q."""
    g = q.T @ vq
    e, c = np.linalg.eigh((g + g.T) / 2)
    return e[::-1], c[:, ::-1]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int = K, guard: int = GUARD, tolerance: float = TOLERANCE, most: int = MOST, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns, residuals) of the k leading ones of a symmetric map of d dimensions without negative eigenvalues."""
    k = min(k, d)
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    vx, p, fresh = product(x), np.zeros((d, 0)), True
    for _ in range(most):
        e, c = ritz(x, vx)
        x, vx = x @ c, vx @ c
        r = vx - x * e
        size = np.sqrt(np.einsum("ij,ij->j", r, r))
        limit = tolerance * max(e[0], 0)
        if (size[:k] <= limit).all():
            if fresh:
                return e[:k], x[:, :k], size[:k]
            x = np.linalg.qr(x)[0]
            vx, fresh = product(x), True
            continue
        w = orthonormal(np.concatenate([r[:, size > limit], p], 1), x)
        vw = product(w)
        q, vq = np.concatenate([x, w], 1), np.concatenate([vx, vw], 1)
        c = ritz(q, vq)[1][:, :m]
        p, x, vx, fresh = w @ c[m:], q @ c, vq @ c, False
    raise RuntimeError("the residuals did not reach the tolerance")


class Centre:
    """Sums of n rows of integers, and rows around their mean: whole parts in integers, then the rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)
        self.part = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum over dimensions of (n x - S)^2, with n x - S = n y - rest."""
        y, r = x - self.base, self.rest
        small = self.n < 1 << 30 and np.abs(y).max(initial=0) < 1 << 24 and len(r) < 1 << 9
        y, r = (y, r.astype(np.int64)) if small else (y.astype(object), r)
        squares, products = (y * y).sum(1).tolist(), (y * r).sum(1).tolist()
        last = sum(int(v) ** 2 for v in self.rest)
        found = [self.n * self.n * a - 2 * self.n * b + last for a, b in zip(squares, products)]
        return [v if v < 1 << 63 else None for v in found]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integers) of rows, a few thousand at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part.column(0), matrix(part.column(1))


def _summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of work(integers) over all rows: each task adds its own, Spark adds the tasks' cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _parts(batches):
            total = work(x) if total is None else total + work(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    t = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[t["cell"].to_numpy()] = t["value"].to_numpy()
    return out.reshape(shape)


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number and exact sums of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _parts(batches):
            n += len(x)
            small = np.abs(x).max(initial=0) < 1 << 48
            total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array([str(v) for v in [*total, n]])], ["cell", "value"])

    got = rows.mapInArrow(run, "cell long, value string").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    by = {r.cell: int(r.value) for r in got}
    return by.get(d, 0), [by.get(i, 0) for i in range(d)]


def integers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, x of the rows that take part."""
    fits = ~F.exists("embedding", lambda c: F.abs(c.cast("double") * scale) >= float(1 << 62))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(finite("embedding")).filter(fits)
    return good.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + offset).alias("x"))


def whiten(vectors: DataFrame, k: int = K, scale: int = SCALE, offset: int = OFFSET, tolerance: float = TOLERANCE) -> DataFrame:
    """vectors: vec_id, embedding. A row per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = ship(vectors.sparkSession)
    rows = materialize(integers(vectors, scale, offset))
    found = [_whiten(rows.filter(F.size("x") == d), d, k, tolerance) for d in lengths(rows, "x") if d]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _SCHEMA)


def _whiten(rows: DataFrame, d: int, k: int, tolerance: float) -> DataFrame:
    spark = rows.sparkSession
    n, sums = _sums(rows, d)
    centre = Centre(n, sums)

    def product(b: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(b)

        def work(x):
            y = centre.rows(x)
            return y.T @ (y @ held.value)

        out = _summed(rows, work, b.shape) / n
        held.unpersist()
        return out

    e, u, _ = lobpcg(product, d, k, tolerance=tolerance)
    trace = float(_summed(rows, lambda x: (centre.rows(x) ** 2).sum(0, keepdims=True), (1, d)).sum()) / n
    some = int((e > 16 * d * _EPS * max(e[0], 0)).sum())
    e, u = e[:some], u[:, :some]
    if not some:
        return spark.createDataFrame([], _SCHEMA)
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(some)])
    to = spark.sparkContext.broadcast(u / np.sqrt(e))

    def moments(x):
        w = centre.rows(x) @ to.value
        return np.concatenate([w.T @ w, w.sum(0, keepdims=True)])

    seen = _summed(rows, moments, (some + 1, some)) / n
    error = float(np.abs(seen[:-1] - np.outer(seen[-1], seen[-1]) - np.eye(some)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _parts(batches):
            m = len(x)
            columns = [ids.take(pa.array(np.repeat(np.arange(m), some))), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), m)), pa.array(np.full(m * some, n))]
            columns += [pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), some))), pa.array((centre.rows(x) @ to.value).ravel())]
            columns += [pa.array(np.tile(e / trace, m)), pa.array(np.full(m * some, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, _SCHEMA)


def op12_whitening_lobpcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
