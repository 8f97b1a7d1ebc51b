"""Embedding near-duplicates inside labels, by PCA-ordered tiled comparison. Exact: no pair at the threshold is missed.

Unit vectors are rotated to their principal axes (fitted on a bounded sample; any rotation gives the same links).
Within a label they are range-partitioned along the first axis and cut into blocks of BLOCK rows, the unit that travels:
a block is sent once for each block that it meets, not for each of their tiles. Two blocks meet only if their ranges come
within sqrt(2 - 2t), the largest distance of two unit vectors with cosine t; so do the tiles of TILE rows inside a pair
of blocks. There the leading dimensions are multiplied first; what the rest can add is bounded by the product of the
suffix norms, and pairs that cannot reach t any more are dropped before the next dimensions. Survivors get their cosine
from the original vectors in double precision.

Exact copies are one vector with a multiplicity. A pair of blocks returns link counts and a spanning forest of its
links, never the pairs. Work is quadratic in a label's rows within reach along the first axis, as the question is; the
pairs of blocks of a hot label spread over all tasks, each with two blocks in memory.

Vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing.
Repeated rows are copies: they link. Vectors of different lengths never link. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import discard, materialize, read
from .components import components
from .vectors import matrix, sample, scaled, unit, usable

THRESHOLD, BLOCK, TILE, STEP = 0.93, 4096, 512, 16
#: Of a block's rows, so that longer vectors make shorter blocks.
BLOCK_BYTES = 1 << 20
_SLACK = 1e-9  # far above the rounding of a double product, far below any cosine that matters


def reach(t: float) -> float:
    """The largest distance of two unit vectors with cosine t."""
    return float(np.sqrt(max(0.0, 2 - 2 * t))) + 1e-6


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Columns are the principal axes of the rows' second moments, largest first."""
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1].copy()


def candidates(a: np.ndarray, b: np.ndarray, t: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rotated unit rows whose product may reach t."""
    d = a.shape[1]
    norms = lambda m, k: np.sqrt(np.maximum(np.einsum("ij,ij->i", m[:, k:], m[:, k:]), 0))
    k = min(step, d)
    i, j = np.nonzero(a[:, :k] @ b[:, :k].T + np.outer(norms(a, k), norms(b, k)) >= t - _SLACK)
    sums = None
    while k < d and len(i):
        if sums is None:
            sums = np.einsum("ij,ij->i", a[i, :k], b[j, :k])
        more = min(k + step, d)
        sums = sums + np.einsum("ij,ij->i", a[i, k:more], b[j, k:more])
        k = more
        keep = sums + norms(a, k)[i] * norms(b, k)[j] >= t - _SLACK
        i, j, sums = i[keep], j[keep], sums[keep]
    return i, j


class Rows:
    """Rows of a block, in the order of their first axis: scaled, with norms, and rotated as unit vectors."""

    def __init__(self, m: np.ndarray, axes: np.ndarray | None):
        self.m = scaled(m)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.m, self.m))
        u = self.m / self.norm[:, None]
        self.r = u if axes is None else u @ axes

    def tiles(self, size: int) -> list[tuple[int, int, float, float]]:
        """(from, to, least, most on the first axis)."""
        return [(i, min(i + size, len(self.r)), float(x.min()), float(x.max())) for i in range(0, len(self.r), size) for x in [self.r[i : i + size, 0]]]


def linked(a: Rows, b: Rows, t: float, tile: int = TILE, rows: int = 128) -> np.ndarray:
    """Boolean matrix of the links of a and b. Tiles too far apart on the first axis are never multiplied, rows in strips, so that memory stays small."""
    out = np.zeros((len(a.m), len(b.m)), bool)
    near, same = reach(t), a is b
    for lo, hi, least, most in a.tiles(tile):
        for lo_b, hi_b, least_b, most_b in b.tiles(tile):
            if least > most_b + near or least_b > most + near or (same and lo_b < lo):
                continue
            for at in range(lo, hi, rows):
                i, j = candidates(a.r[at : min(at + rows, hi)], b.r[lo_b:hi_b], t)
                i, j = i + at, j + lo_b
                ok = np.einsum("ij,ij->i", a.m[i], b.m[j]) / (a.norm[i] * b.norm[j]) >= t
                out[i[ok], j[ok]] = True
                if same:
                    out[j[ok], i[ok]] = True
    return out


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a boolean matrix of links between rows and columns: rows with links, the root row of each, the same for columns."""
    root_r, root_c = np.full(links.shape[0], -1), np.full(links.shape[1], -1)
    for r in np.flatnonzero(links.any(1)):
        if root_r[r] >= 0:
            continue
        front = np.array([r])
        root_r[r] = r
        while len(front):
            cols = np.flatnonzero(links[front].any(0) & (root_c < 0))
            root_c[cols] = r
            front = np.flatnonzero(links[:, cols].any(1) & (root_r < 0)) if len(cols) else cols
            root_r[front] = r
    rows, cols = np.flatnonzero(root_r >= 0), np.flatnonzero(root_c >= 0)
    return rows, root_r[rows], cols, root_c[cols]


def _blocks(distinct: DataFrame, axes: np.ndarray, block: int) -> DataFrame:
    """One row per block: block, label, dim, lo, hi, n, ids, copies, rows (bytes)."""
    from pyspark import TaskContext

    dtype = "<f8" if "double" in distinct.schema["embedding"].dataType.simpleString() else "<f4"
    label = distinct.schema["label"].dataType.simpleString()

    def first_axis(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.zeros(len(batch))
            sizes = np.array([len(v) for v in batch])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                u = unit(matrix(batch.take(pa.array(at))))
                out[at] = u @ (axes[:, 0] if d == len(axes) else np.eye(d)[0])
            yield pa.array(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[pa.Table] = []
        key = None

        def out():
            nonlocal held, k
            rows = pa.concat_tables(held)
            axis = rows["axis"].to_numpy()
            m = matrix(rows["embedding"].combine_chunks()).astype(dtype)
            made = {"block": [base + k], "label": [rows["label"][0].as_py()], "dim": [m.shape[1]], "lo": [float(axis.min())], "hi": [float(axis.max())], "n": [len(m)]}
            made |= {"ids": [rows["rep"].to_numpy().astype("<i8").tobytes()], "copies": [rows["copies"].to_numpy().astype("<i8").tobytes()], "rows": [m.tobytes()]}
            held, k = [], k + 1
            kinds = [pa.int64(), rows["label"].type, pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), kinds)], list(made))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = list(zip(t["label"].to_pylist(), t["dim"].to_pylist()))
            at = 0
            while at < len(keys):
                most = max(64, min(block, BLOCK_BYTES // (max(keys[at][1], 1) * int(dtype[-1]))))
                if held and (keys[at] != key or sum(map(len, held)) >= most):
                    yield out()
                key = keys[at]
                room, end = most - sum(map(len, held)), at
                while end < len(keys) and end - at < room and keys[end] == key:
                    end += 1
                held.append(t.slice(at, end - at))
                at = end
        if held:
            yield out()

    from pyspark.sql.functions import arrow_udf

    axis = arrow_udf(first_axis, returnType="double").asNondeterministic()
    placed = materialize(distinct.select("label", F.size("embedding").alias("dim"), axis("embedding").alias("axis"), "rep", "copies", "embedding"))
    ordered = placed.repartitionByRange("label", "dim", "axis", "rep").sortWithinPartitions("label", "dim", "axis", "rep")
    return ordered.mapInArrow(cut, f"block long, label {label}, dim int, lo double, hi double, n int, ids binary, copies binary, rows binary")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """vectors: vec_id, embedding, label. One row per row: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = usable("embedding") & F.col("label").isNotNull()
    parts = v.filter(good)
    distinct = materialize(parts.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    x = sample(distinct.select("embedding", F.col("rep").alias("vec_id")))
    axes = principal_axes(unit(x)) if len(x) else np.eye(1)
    blocks = materialize(_blocks(distinct, axes, block))
    # blocks that come near along the first axis, through equal cells of that width
    near = reach(threshold)
    cell = lambda c: F.floor(c / near).cast("int")
    meta = blocks.select("block", "label", "dim", "lo", "hi")
    a = meta.select("label", "dim", F.col("block").alias("ba"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.explode(F.sequence(cell(F.col("lo") - near), cell(F.col("hi") + near))).alias("cell"))
    b = meta.select("label", "dim", F.col("block").alias("bb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    pairs = a.join(b, ["label", "dim", "cell"]).filter((F.col("ba") <= F.col("bb")) & (F.col("la") <= F.col("hb") + near) & (F.col("lb") <= F.col("ha") + near))
    pairs = materialize(pairs.select("ba", "bb").distinct())
    load = lambda s: blocks.select(F.col("block").alias(f"b{s}"), F.col("dim").alias(f"dim_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "rows")))
    none = [F.lit(None).cast("binary").alias(f"{c}_b") for c in ("ids", "copies", "rows")]
    own = load("a").join(pairs.filter("ba = bb"), "ba", "left_semi").select("dim_a", "ids_a", "copies_a", "rows_a", *none)
    other = pairs.filter("ba < bb").join(load("a"), "ba").join(load("b"), "bb").select("dim_a", "ids_a", "copies_a", "rows_a", "ids_b", "copies_b", "rows_b")
    loaded = own.unionByName(other)
    dtype = "<f8" if "double" in v.schema["embedding"].dataType.simpleString() else "<f4"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(batch, k, first, dim):
            ids, copies, m = (np.frombuffer(batch.column(c)[k].as_py(), "<i8" if c < first + 2 else dtype) for c in range(first, first + 3))
            return ids, copies, Rows(m.reshape(-1, dim), axes if dim == len(axes) else None)

        for batch in batches:
            for k in range(batch.num_rows):
                dim, own = batch.column(0)[k].as_py(), not batch.column(4)[k].is_valid
                ia, ca, ra = side(batch, k, 1, dim)
                ib, cb, rb = (ia, ca, ra) if own else side(batch, k, 4, dim)
                m = linked(ra, rb, threshold, tile)
                if own:
                    np.fill_diagonal(m, False)
                r, rr, c, rc = forest(m)
                ids, roots, counts = [ia[r]], [ia[rr]], [(m[r] @ cb)]
                if own:
                    counts.append(np.zeros(len(c), np.int64))  # as rows they are counted already
                else:
                    counts.append(m[:, c].T @ ca)
                ids.append(ib[c])
                roots.append(ia[rc])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, roots, counts)], ["rep", "root", "links"])

    found = materialize(loaded.mapInArrow(compare, "rep long, root long, links long"))
    discard(blocks, pairs)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    least = materialize(joined.groupBy("component").agg(F.min("node").alias("component_id")))
    joined = materialize(joined.join(least, "component").select(F.col("node").alias("rep"), "component_id"))
    classes = distinct.join(counts, "rep", "left").join(joined, "rep", "left")
    classes = materialize(classes.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    out = parts.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = v.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(vec_id, near) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.near = l.a
), c AS (
  SELECT vec_id, min(near) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
"""
