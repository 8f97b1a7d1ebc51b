"""Health of sources as the state of a stream: failures since the last success, and silence by a timer.

What is kept of a source can be merged in any order: the place of its latest success, and the places of the failures
after it. So neither the order of rows within a batch, nor the cut of a source into Arrow batches, nor rows of one
source in several micro-batches, changes a count; a late success takes back the failures before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType, TimestampType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SourceHealth(StatefulProcessor):
    """State of a source; with silence (milliseconds) a timer that every new row sets anew."""

    def __init__(self, key: str, silence: int | None):
        self.key, self.silence = key, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "at long, n int")  # the latest success, and how many failures came after it
        self.failures = handle.getListState("failures", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Each call of the state is a round trip, so there is one to read and one to write, and the list is touched only if it changes."""
        held = self.known.get()
        before, n = held if held is not None else (None, 0)
        last, late = before, np.zeros(0, np.int64)
        for part in rows:
            at, failed = part["at"].to_numpy(np.int64), part["failed"].to_numpy(bool)
            if (~failed).any():
                good = int(at[~failed].max())
                last = good if last is None else max(last, good)
            late = np.concatenate([late, at[failed]])
            late = late if last is None else late[late > last]
        if last != before and n:
            kept = [a for a in self.failures.get() if a[0] > last] + [(int(a),) for a in late]
            self.failures.put(kept) if kept else self.failures.clear()
            n = len(kept)
        elif len(late):
            self.failures.appendList([(int(a),) for a in late])
            n += len(late)
        if held is None or (before, held[1]) != (last, n):
            self.known.update((last, n))
        if self.silence is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield self.row(key, n, "degraded" if n else "healthy")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.known.get()
        yield self.row(key, held[1] if held is not None else 0, "stalled")

    def row(self, key, n: int, health: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [int(key[0])], "consecutive_failures": pd.Series([n], dtype="int32"), "health": [health]})

    def close(self) -> None:
        pass


def health_stream(runs: DataFrame, key: str = "board_id", order: str = "at", failed: str = "failed", silent_after: timedelta | None = None) -> DataFrame:
    """A row for each source with news: key, consecutive_failures, health (healthy, degraded, or stalled).

    runs: a stream of key (an integer), order (an integer or a time; rows of a key that share one have no order), failed.
    Rows without a key or an order are left out. With silent_after, a source without any row for so long (by the clock
    of the stream, which a trigger has to keep running) is emitted as stalled, once, until it is heard again.
    """
    spark = runs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # lists and timers live there only
    place = F.unix_micros(F.col(order).cast("timestamp")) if isinstance(runs.schema[order].dataType, (TimestampType, TimestampNTZType)) else F.col(order).cast("long")
    rows = runs.select(F.col(key).cast("long").alias(key), place.alias("at"), F.coalesce(F.col(failed), F.lit(False)).alias("failed")).filter(F.col(key).isNotNull() & F.col("at").isNotNull())
    silence = None if silent_after is None else int(silent_after.total_seconds() * 1000)
    return rows.groupBy(key).transformWithStateInPandas(SourceHealth(key, silence), f"{key} bigint, consecutive_failures int, health string", "update", "none" if silence is None else "processingTime")
