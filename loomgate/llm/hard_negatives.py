"""Hard negatives by a vector-approximation file: exact, with few exact scores.

Vectors are integers (floor(SCALE * x)) and a score is an integer inner product. Rows lie in blocks of one length,
sorted by label. A block keeps, beside its vectors, an approximation: each dimension is cut into CELLS cells of equal
width between the block's extremes and every component is one byte, its cell. For an anchor a table gives, by dimension
and cell, the least that the cell can add to the score; the sum of 64 lookups is a lower bound, and as cells are of one
width the upper bound is a constant above it. Only rows whose bounds say that they may enter the answer are scored by
their vectors.

1. Positives: blocks with an anchor's label; rows whose upper bound reaches the least of the best lower bounds or of the
   exact scores found so far.
2. Negatives: the other blocks, and the other labels of the same ones. Each positive gives a window of scores; a row is
   scored if its bounds meet a window and reach that window's best so far.

Anchors are a stated set of rows; their blocks are joined with all blocks of rows, each pair once in all. A task keeps its
best per anchor before anything is shuffled. Blocks are sorted along labels, so a hot label is many blocks, in many tasks.

Rows with a null label, vec_id or vector, or with a null or non-finite component, take no part; nor do those whose
integers are so large (squares that add up to 2^62) that a score could leave 64 bits. A zero or an empty vector is a row
like any other. Vectors of different lengths have no score. Rows that repeat whole are one; of rows that share a vec_id
only, each takes part, and none is a positive or negative of its own id. Ties go by smaller vec_id. No positive or no
row in a window: no rows for it. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import discard, materialize, read
from .vectors import finite, matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is between LOW and HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
CELLS = 64
#: Rows and bytes of vectors of a block at most, and anchors of one.
BLOCK, BLOCK_BYTES, ANCHORS = 8192, 4 << 20, 512
#: Rows and anchors of one table lookup: what it fills stays in a core's cache.
_ROWS, _TOGETHER = 2048, 64
#: Anchor blocks whose best a task keeps at most before it hands them on.
_HELD = 64
_WORST = np.iinfo(np.int64).min


class Cells:
    """The approximation of a block: a byte a component, and the extremes they lie between."""

    def __init__(self, rows: np.ndarray, cells: int = CELLS):
        self.n, self.d = rows.shape
        self.rows = rows
        self.least = rows.min(0) if self.n else np.zeros(self.d, np.int64)
        self.most = rows.max(0) if self.n else self.least
        self.width = (self.most - self.least) // cells + 1
        self.codes = ((rows - self.least) // self.width).astype(np.uint8).T.copy()
        self.edges = self.least[:, None] + self.width[:, None] * np.arange(cells)  # the least value of each cell

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """q: anchors as rows. (lower bounds by anchor and row, how far the upper ones are above them); both allow for the rounding of the sums."""
        q = q.astype(np.float64)
        gap = np.abs(q) @ (self.width - 1).astype(np.float64)
        largest = np.abs(q) @ np.maximum(np.abs(self.least), np.abs(self.most)).astype(np.float64)
        slack = (self.d + 2) * 1.3e-7 * (largest + gap) + 1e-6
        # a negative factor is least at the upper edge of a cell
        tables = (self.edges[:, :, None] + np.where(q.T > 0, 0, (self.width - 1)[:, None])[:, None, :]) * q.T[:, None, :]
        tables = tables.astype(np.float32)
        out = np.empty((len(q), self.n), np.float32)
        for at in range(0, self.n, _ROWS):
            part = self.codes[:, at : at + _ROWS]
            total = np.zeros((part.shape[1], len(q)), np.float32)
            one = np.empty_like(total)
            for d in range(self.d):
                np.take(tables[d], part[d], axis=0, out=one, mode="clip")
                total += one
            out[:, at : at + _ROWS] = total.T
        return out - slack[:, None].astype(np.float32), gap + 2 * slack

    def exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.rows[at].astype(np.int64) @ q


class Best:
    """The k best (score, id) of some slots: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.scores, self.ids = np.full((slots, k), _WORST), np.full((slots, k), np.iinfo(np.int64).max)

    def least(self, slot: int) -> int:
        """The score that a row must reach."""
        return int(self.scores[slot, -1])

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[slot], scores]), np.concatenate([self.ids[slot], ids])
        top = np.lexsort((i, ~s))[: self.scores.shape[1]]  # ~s falls as s rises, at the extreme too
        self.scores[slot], self.ids[slot] = s[top], i[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of all that is filled."""
        slot, place = np.nonzero(self.scores > _WORST)
        return slot, self.scores[slot, place], self.ids[slot, place]


def kth(lower: np.ndarray, k: int) -> float:
    return float(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else -np.inf


def window_of(score: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer score with low * score <= 100 * x <= high * score, in 64 bits."""
    whole, rest = score // 100, score % 100
    return low * whole - (-low * rest // 100), high * whole + high * rest // 100


def find_positives(block: Cells, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, best: Best) -> None:
    k = best.scores.shape[1]
    for at in range(0, len(anchors), _TOGETHER):
        mine = [a for a in range(at, min(at + _TOGETHER, len(anchors))) if (labels == a_labels[a]).any()]
        if not mine:
            continue
        lower, gap = block.bounds(anchors[mine])
        for i, a in enumerate(mine):
            rows = np.flatnonzero((labels == a_labels[a]) & (ids != a_ids[a]))
            low = lower[i, rows]
            near = rows[low + gap[i] >= max(best.least(a), kth(low, k))]
            if len(near):
                best.add(a, block.exact(near, anchors[a]), ids[near])


def find_negatives(block: Cells, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, scores: np.ndarray, best: Best, low: int = LOW, high: int = HIGH) -> None:
    """scores: of each anchor's positives (the lowest integer: none); best: a slot for each anchor and positive."""
    k, n = best.scores.shape[1], scores.shape[1]
    least, most = window_of(scores, low, high)
    some = (scores > _WORST) & (least <= most)
    for at in range(0, len(anchors), _TOGETHER):
        mine = [a for a in range(at, min(at + _TOGETHER, len(anchors))) if some[a].any() and (labels != a_labels[a]).any()]
        if not mine:
            continue
        lower, gap = block.bounds(anchors[mine])
        for i, a in enumerate(mine):
            slots = np.flatnonzero(some[a])
            near = np.flatnonzero((lower[i] <= most[a, slots].max()) & (lower[i] + gap[i] >= least[a, slots].min()) & (labels != a_labels[a]) & (ids != a_ids[a]))
            if not len(near):
                continue
            lo = lower[i, near].astype(np.float64)
            hi, wanted = lo + gap[i], np.zeros(len(near), bool)
            for p in slots:
                sure = lo[(lo >= least[a, p]) & (hi <= most[a, p])]
                wanted |= (lo <= most[a, p]) & (hi >= max(least[a, p], best.least(a * n + p), kth(sure, k)))
            near = near[wanted]
            exact = block.exact(near, anchors[a])
            for p in slots:
                ok = (exact >= least[a, p]) & (exact <= most[a, p])
                if ok.any():
                    best.add(a * n + p, exact[ok], ids[near[ok]])


def _pack(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """rows: vec_id, label, x (longs). Sorted along length and label and cut: block, dim, n, low, high (labels), ids, labels, rows, wide (bytes an integer)."""
    from pyspark import TaskContext

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        names = ["block", "dim", "n", "low", "high", "ids", "labels", "rows", "wide"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]

        def out(dim):
            nonlocal held, made
            t = pa.Table.from_batches(held)
            ids, labels = t["vec_id"].to_numpy(), t["label"].to_numpy()
            x = matrix(t["x"].combine_chunks()) if dim else np.zeros((len(ids), 0), np.int64)
            small = not x.size or np.abs(x).max() < 1 << 31
            values = [base + made, dim, len(ids), int(labels.min()), int(labels.max()), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), x.astype("<i4" if small else "<i8").tobytes(), 4 if small else 8]
            held, made = [], made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

        now = None
        for batch in batches:
            dims = batch.column(3).to_numpy()
            at = 0
            while at < len(dims):
                if held and (dims[at] != now or sum(map(len, held)) >= most):
                    yield out(now)
                now = int(dims[at])
                most = max(64, min(most_rows, most_bytes // max(4 * now, 1)))
                same = at + int(np.argmax(dims[at:] != now)) if (dims[at:] != now).any() else len(dims)
                end = min(same, at + most - sum(map(len, held)))
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield out(now)

    ordered = rows.select("vec_id", "label", "x", F.size("x").alias("dim")).repartitionByRange("dim", "label", "vec_id").sortWithinPartitions("dim", "label", "vec_id")
    ordered = ordered.coalesce(max(1, -(-rows.count() // most_rows)))  # no more partitions than blocks
    return ordered.mapInArrow(cut, "block long, dim int, n int, low long, high long, ids binary, labels binary, rows binary, wide int")


def _side(batch: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a packed block."""
    get = lambda c: batch.column(batch.schema.get_field_index(f"{side}_{c}"))[i].as_py()
    dim = batch.column(batch.schema.get_field_index("dim"))[i].as_py()
    ids, labels = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("labels"), "<i8")
    return ids, labels, np.frombuffer(get("rows"), "<i4" if get("wide") == 4 else "<i8").reshape(len(ids), dim).astype(np.int64)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x: the rows that take part, with their integers."""
    e = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, c: s + F.pow(F.abs(c.cast("double")) * scale + 1, F.lit(2)))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding")).filter(squares < float(1 << 62))
    return v.select("vec_id", "label", e.alias("x")).distinct()


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, low: int = LOW, high: int = HIGH, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """vectors: vec_id, label, embedding. anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that is_anchor (a condition on vec_id) holds for."""
    ship(vectors.sparkSession)
    rows = materialize(integers(vectors, scale))
    blocks = materialize(_pack(rows, block, BLOCK_BYTES))
    anchors = materialize(_pack(rows.filter(is_anchor), ANCHORS, BLOCK_BYTES))
    named = lambda df, s: df.select(F.col("block").alias(s), "dim", *(F.col(c).alias(f"{s}_{c}") for c in ("low", "high", "ids", "labels", "rows", "wide")))
    meta = lambda df, s: df.select(F.col("block").alias(s), "dim", F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high"))
    pairs = meta(anchors, "a").join(meta(blocks, "b"), "dim")
    meet = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    other = ~((F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low")))

    def loaded(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
        few = pairs.select("a", "b")
        return few.join(anchors, "a").join(named(blocks, "b").drop("dim"), "b")

    def over(work, slots_of) -> callable:
        """Runs work over pairs of blocks, with the best of each anchor block kept while there is room."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            cells_of: list = [None, None]
            for batch in batches:
                for i in range(batch.num_rows):
                    a, b = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("a", "b"))
                    if a not in held:
                        if len(held) >= _HELD:
                            yield from slots_of(held)
                            held.clear()
                        held[a] = work.start(batch, i)
                    if cells_of[0] != b:
                        ids, labels, x = _side(batch, i, "b")
                        cells_of = [b, (Cells(x, cells), ids, labels)]
                    work.step(cells_of[1], held[a])
            yield from slots_of(held)

        return run

    class Positive:
        @staticmethod
        def start(batch, i):
            ids, labels, x = _side(batch, i, "a")
            return ids, labels, x, Best(len(ids), positives)

        @staticmethod
        def step(b, held):
            find_positives(*b, held[2], held[0], held[1], held[3])

    def positives_of(held):
        for a, (_, _, _, best) in held.items():
            slot, score, vec_id = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), a)), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(vec_id)], ["a", "at", "score", "vec_id"])

    found = loaded(pairs.filter(meet), named(anchors, "a")).mapInArrow(over(Positive, positives_of), "a long, at int, score long, vec_id long")
    first = Window.partitionBy("a", "at").orderBy(F.desc("score"), "vec_id")
    found = materialize(found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives))
    # a block of anchors has ANCHORS * positives of them at most
    packed = found.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("at", "rank", "score", "vec_id"))).alias("p"))
    asking = materialize(named(anchors, "a").join(packed, "a").select("*", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("at", "rank", "score", "vec_id"))).drop("p"))

    class Negative:
        @staticmethod
        def start(batch, i):
            ids, labels, x = _side(batch, i, "a")
            at, rank, score, vec_id = (np.array(batch.column(batch.schema.get_field_index(f"p_{c}"))[i].as_py(), np.int64) for c in ("at", "rank", "score", "vec_id"))
            scores, names = np.full((len(ids), positives), _WORST), np.zeros((len(ids), positives), np.int64)
            scores[at, rank - 1], names[at, rank - 1] = score, vec_id
            return ids, labels, x, scores, names, Best(len(ids) * positives, negatives)

        @staticmethod
        def step(b, held):
            find_negatives(*b, held[2], held[0], held[1], held[3], held[5], low, high)

    def negatives_of(held):
        for a, (ids, _, _, scores, names, best) in held.items():
            slot, score, vec_id = best.rows()
            columns = [np.full(len(slot), a), slot, ids[slot // positives], names.ravel()[slot], scores.ravel()[slot], vec_id, score]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "slot", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    hits = loaded(pairs.filter(other), asking).mapInArrow(over(Negative, negatives_of), "a long, slot long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("a", "slot").orderBy(F.desc("negative_score"), "negative_id")
    out = materialize(hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(rows, blocks, anchors, found, asking)
    return out


def op11_hard_negatives_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(v.withColumn("label", label), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 3
"""
