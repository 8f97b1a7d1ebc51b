"""Incremental work: reading new posts into a table, and the health of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..operators.filters import stalled
from ..operators.merge import last_per_key, merge


def upsert_stream(source: DataFrame, root: str, keys: list[str], order: str, checkpoint: str, update_when: Column | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, parts: int | None = None):
    """A stream merged into a table of parts: a batch rewrites the parts that its keys fall in, so readers never see half of one.

    The version of batch n is n; a batch that runs again after a crash writes the same version again.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = last_per_key(transform(batch) if transform else batch, keys, order).persist()
        try:
            touched = store.update(spark, root, rows, keys, lambda old: merge(old, rows, keys, update_when), parts=parts, version=n)
            if not touched and store.manifest(spark, root) is None:
                store.write(spark, root, rows, keys, parts, version=n)
        finally:
            rows.unpersist()

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latest(spark, root: str) -> DataFrame:
    return store.read(spark, root)


def consecutive_failures(runs: DataFrame, key: str = "board_id", order: str = "at", failed: str = "failed") -> DataFrame:
    """Failures since the last success per key, and health: degraded if there are any."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    successes = runs.withColumn("__ok", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w))
    n = successes.groupBy(key).agg(F.count_if(F.col("__ok") == 0).alias("consecutive_failures"))
    return n.withColumn("health", F.when(F.col("consecutive_failures") > 0, "degraded").otherwise("healthy"))


def failure_stream(runs: DataFrame, key: str = "board_id", order: str = "at") -> DataFrame:
    """The same as state of a stream: one row per key and batch. runs: key (bigint), at, failed."""
    from .health import health_stream

    return health_stream(runs, key, order)


def stalled_sources(state: DataFrame, boards: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return state.filter(stalled(now, hours)).join(boards.select("board_id", "name"), "board_id").orderBy("board_id")


def windowed_counts(events: DataFrame, ts: str, *keys: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key; works on tables and, with lateness, on streams."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
