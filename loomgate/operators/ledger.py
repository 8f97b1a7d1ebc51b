"""Records that failed, kept by themselves: each is tried again when its time has come, and holds nothing else up.

A source's mark moves on past failures; what failed is in the ledger, with the number of attempts and the time of the
next one, which doubles with each: a record that fails for ever costs one read a back-off. What succeeds leaves it.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["board_id", "art_no"]
SCHEMA = "board_id int, art_no long, attempts int, first_failed_at timestamp, last_failed_at timestamp, next_at timestamp, error string"
#: The first back-off, and the longest.
FIRST, LONGEST = timedelta(hours=1), timedelta(days=7)


def to_read(refs: DataFrame, marks: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """refs (of KEYS) above their board's mark (board_id, last_art_no; none: all), and failed ones whose time has come."""
    m = marks.select("board_id", F.col("last_art_no").alias("__mark"))
    waiting = ledger.select(*KEYS, (F.col("next_at") <= now).alias("__due"))
    out = refs.join(m, "board_id", "left").join(waiting, KEYS, "left")
    # a failed entry waits for its time, wherever the mark is
    return out.filter(F.coalesce(F.col("__due"), F.col("__mark").isNull() | (F.col("art_no") > F.col("__mark")))).select(refs.columns)


def advance(ledger: DataFrame, outcomes: DataFrame, now: Column, first: timedelta = FIRST, longest: timedelta = LONGEST) -> DataFrame:
    """The ledger after a run. outcomes: KEYS, error (null: it went well), one row each."""
    o = outcomes.select(*KEYS, F.col("error").alias("__error"), F.lit(True).alias("__ran"))
    both = ledger.join(o, KEYS, "full")
    again = F.col("__ran").isNotNull() & F.col("__error").isNotNull()
    attempts = F.when(again, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts"))
    both = both.filter(F.col("__ran").isNull() | F.col("__error").isNotNull()).withColumn("attempts", attempts.cast("int"))
    wait = F.least(F.lit(longest.total_seconds()), F.lit(first.total_seconds()) * F.pow(F.lit(2.0), F.least(F.col("attempts") - 1, F.lit(40))))
    next_at = F.timestamp_micros((F.unix_micros(now) + wait * 1_000_000).cast("long"))
    return both.select(
        *KEYS,
        "attempts",
        F.coalesce("first_failed_at", F.when(again, now)).alias("first_failed_at"),
        F.when(again, now).otherwise(F.col("last_failed_at")).alias("last_failed_at"),
        F.when(again, next_at).otherwise(F.col("next_at")).alias("next_at"),
        F.when(again, F.substring("__error", 1, 500)).otherwise(F.col("error")).alias("error"),
    )
