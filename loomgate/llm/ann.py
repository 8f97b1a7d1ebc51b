"""Approximate nearest neighbours by inner product along shifted Hilbert curves.

Vectors are lifted so that the largest inner product is the smallest angle (candidates get the coordinate that
completes their norm to the largest one, queries zero), projected CURVES times on a few random directions, shifted,
and ordered along a Hilbert curve each time: a range partitioning by (curve, key) in Spark. A query's window on a curve
are the candidates within REACH of all rows on either side of its own place (K + 1 rows at least, as a smaller window
could not fill an answer), and no others. Rows travel in blocks of half a window's half, up to BLOCK rows; how rows are
cut into blocks changes no result. Every window is reranked on the original vectors in double precision, and the windows
of all curves merge.

REACH is a share of the rows, so recall does not fall as the table grows; on vectors without any structure (such as
random directions in 64 dimensions) neighbours are hardly nearer than others in a few projections, and 0.9 recall
needs wide windows. For clustered vectors a smaller reach is enough; measure with recall().

Exact copies beyond the K + 1 smallest vec_id of one vector can never be among a query's nearest and are left out
after an exact ranking. Vectors that are null, zero or hold null or non-finite components take no part; vectors of
different lengths have no product, so each length is searched by itself. Repeated rows (same vec_id and vector) are
one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import discard, materialize, read
from .vectors import lengths, matrix, sample, unit, usable

K, CURVES, DIMS, BITS, REACH = 20, 10, 8, 4, 0.07
#: Rows of a block at most: what a task holds two of.
BLOCK = 16384
QUERY_MOD = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (n, d), each below 2^bits; d * bits is 62 at most.

    Gray-code view of the curve: from the highest bit down, each axis whose bit is set reflects the first axis in the
    lower bits, and each whose bit is not set swaps them with it.
    """
    x = cells.astype(np.int64).T.copy()
    d, n = x.shape
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curves:
    """Random directions and shifts, scaled to the spread of a sample of lifted candidates."""

    def __init__(self, x: np.ndarray, largest: float, seed: int, curves: int, dims: int, bits: int):
        rng = np.random.default_rng(seed)
        self.largest, self.bits = largest, bits
        lifted = self.lift(x, False)
        d = lifted.shape[1]
        self.axes = [np.linalg.qr(rng.normal(size=(d, min(dims, d))))[0] for _ in range(curves)]
        p = [lifted @ a for a in self.axes]
        self.mean = [q.mean(0) for q in p]
        self.width = [6 * q.std(0) + 1e-12 for q in p]
        self.shift = [(rng.random(a.shape[1]) - 0.5) * 0.25 for a in self.axes]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.c_[unit(x), np.zeros(len(x))]
        x = x.astype(np.float64) / self.largest
        return np.c_[x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))]

    def keys(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        x, side = self.lift(x, query), 1 << self.bits
        cells = [((x @ a - m) / w + 0.5 + s) * side for a, m, w, s in zip(self.axes, self.mean, self.width, self.shift)]
        return [hilbert_keys(np.clip(c, 0, side - 1).astype(np.int64), self.bits) for c in cells]


def nearest(q: np.ndarray, q_ids: np.ndarray, q_at: np.ndarray, c: np.ndarray, c_ids: np.ndarray, half: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best candidates but itself, by exact score and then id: (scores, ids).

    q_at: a query's place along the curve, counted from the first candidate; those within half of it are its own.
    """
    q, c = q.astype(np.float64), c.astype(np.float64)
    places = np.arange(len(c))
    for at in range(0, len(q), 256):
        rough = q[at : at + 256] @ c.T
        outside = (places[None, :] < q_at[at : at + 256, None] - half) | (places[None, :] >= q_at[at : at + 256, None] + half)
        rough[outside | (q_ids[at : at + 256, None] == c_ids[None, :])] = -np.inf
        n = min(k, len(c))
        least = np.partition(rough, len(c) - n, axis=1)[:, len(c) - n] - 1e-9 * np.abs(rough[np.isfinite(rough)]).max(initial=1.0)
        for i, row in enumerate(rough):
            j = np.flatnonzero((row >= least[i]) & np.isfinite(row))
            s = (c[j] * q[at + i]).sum(1)  # row by row, so equal for a pair wherever it is met
            top = np.lexsort((c_ids[j], -s))[:k]
            yield s[top], c_ids[j][top]


def search(vectors: DataFrame, is_query, k: int = K, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, reach: float = REACH, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """vectors: vec_id, embedding. query_id, rank, vec_id, score of the k nearest of each row that is_query (a condition on vec_id) holds for."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable("embedding") & F.col("vec_id").isNotNull()).distinct()
    spark = ship(vectors.sparkSession)
    answers = [_search(good.filter(F.size("embedding") == d), is_query, d, k, curves, dims, bits, reach, block, seed) for d in lengths(good)]
    return reduce(DataFrame.unionByName, answers) if answers else spark.createDataFrame([], ANSWER)


ANSWER = "query_id long, rank int, vec_id long, score double"


def _search(good: DataFrame, is_query, d: int, k: int, curves: int, dims: int, bits: int, reach: float, block: int, seed: int) -> DataFrame:
    """search() of vectors of one length d."""
    from pyspark import TaskContext

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    # a query stays whatever its place among its copies; as a candidate it needs to be one of the first k + 1
    ranked = good.withColumn("n", F.row_number().over(copies)).filter(F.col("n") <= k + 1).drop("n")
    both = ranked.select("vec_id", "embedding", F.lit(False).alias("query")).unionByName(good.filter(is_query).select("vec_id", "embedding", F.lit(True).alias("query")))
    both = materialize(both)
    x = sample(both.filter("not query"))
    most = F.array_max(F.transform("embedding", lambda e: F.abs(e.cast("double"))))
    scaled = lambda m: m * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, e: s + (e.cast("double") / m) * (e.cast("double") / m)))
    norm = F.get(F.transform(F.array(most), scaled), F.lit(0))  # the largest component is worked out once a row
    sizes = both.filter("not query").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).first()
    plan = Curves(x, sizes["m"], seed, curves, dims, bits)
    half = max(k + 1, int(np.ceil(reach * sizes["n"])))
    block = min(block, max(half // 2, 64))
    dtype = "<f8" if "double" in good.schema["embedding"].dataType.simpleString() else "<f4"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.array(batch.column(2).to_pylist(), bool)
            for query in (False, True):
                at = np.flatnonzero(flags == query)
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                m = matrix(part.column(1)).astype(dtype)
                raw = pa.array([r.tobytes() for r in m], pa.binary())
                for c, key in enumerate(plan.keys(m, query)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(key), part.column(0), part.column(2), raw], ["curve", "key", "vec_id", "query", "row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        names = ["block", "curve", "n", "ids", "rows", "q_ids", "q_at", "q_rows"]
        ids, rows, q_ids, q_at, q_rows = [], [], [], [], []
        now = None

        def out():
            nonlocal made, ids, rows, q_ids, q_at, q_rows
            pack = lambda v: np.array(v, "<i8").tobytes()
            values = [base + made, now, len(ids), pack(ids), b"".join(rows), pack(q_ids), pack(q_at), b"".join(q_rows)]
            kinds = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 5
            ids, rows, q_ids, q_at, q_rows, made = [], [], [], [], [], made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

        for batch in batches:
            for curve, _, vec_id, query, row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now != curve or len(ids) >= block or len(q_ids) >= block:
                    if now is not None:
                        yield out()
                    now = curve
                if query:
                    q_ids.append(vec_id)
                    q_at.append(len(ids))
                    q_rows.append(row)
                else:
                    ids.append(vec_id)
                    rows.append(row)
        if now is not None:
            yield out()

    ordered = both.mapInArrow(place, "curve int, key long, vec_id long, query boolean, row binary").repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id", "query")
    blocks = materialize(ordered.mapInArrow(cut, "block long, curve int, n long, ids binary, rows binary, q_ids binary, q_at binary, q_rows binary"))
    # block numbers rise along each curve: where a block starts, in candidates
    before = Window.partitionBy("curve").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    meta = blocks.select("block", "curve", "n", (F.length("q_ids") > 0).alias("asks"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lo")).withColumn("hi", F.col("lo") + F.col("n"))
    meta = materialize(meta)
    cell = lambda c: F.floor(c / half).cast("long")
    a = meta.filter("asks").select("curve", F.col("block").alias("asking"), F.col("lo").alias("at"), (F.col("lo") - half).alias("from"), (F.col("hi") + half).alias("to")).withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))))
    b = meta.filter("n > 0").select("curve", F.col("block"), "lo", "hi").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    pairs = a.join(b, ["curve", "cell"]).filter("lo <= to and hi >= from").select("asking", "block", (F.col("at") - F.col("lo")).alias("shift")).distinct()
    queries = blocks.filter(F.length("q_ids") > 0).select(F.col("block").alias("asking"), "q_ids", "q_at", "q_rows")
    # the few query rows travel to the blocks, not the blocks to the queries
    asked = materialize(pairs.join(queries, "asking").select("block", "shift", "q_ids", "q_at", "q_rows"))
    loaded = asked.join(blocks.filter("n > 0").select("block", "ids", "rows"), "block").select("q_ids", "q_rows", "ids", "rows", "q_at", "shift")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, ids, c = (np.frombuffer(batch.column(j)[i].as_py(), "<i8" if j % 2 == 0 else dtype) for j in range(4))
                at = np.frombuffer(batch.column(4)[i].as_py(), "<i8") + batch.column(5)[i].as_py()
                found = list(nearest(q.reshape(-1, d), q_ids, at, c.reshape(-1, d), ids, half, k))
                n = [len(s) for s, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], ["query_id", "vec_id", "score"])

    hits = loaded.mapInArrow(rerank, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = materialize(hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(both, blocks, meta, asked)
    return out


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of exact's (query_id, vec_id) rows that are found."""
    n = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0


def op7_ann_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_MOD == 0)
