"""Versions over time: from when to when each holds, and which one held at a moment.

A chain is the versions of one key in the order of their starts; each holds from its start (null: always before) until
the next one's, which it does not include. An as-of join gives every moment its key's version. A key's moments and
versions are cut into stretches of time, and the version that a stretch begins with is carried into it, so a key
with very many of either is many tasks: what is handled by key alone is one row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a stretch.
STRETCH = 64


def intervals(versions: DataFrame, keys: list[str], start: str, *order: str) -> DataFrame:
    """versions with valid_to: the start of the next one of its key, null for the last. Of those that start together, by order, the last holds and the others never do."""
    chain = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first(), *order)
    return versions.withColumn("valid_to", F.lead(start).over(chain)).withColumn("__last", F.lead(F.lit(1)).over(chain).isNull()).withColumn("valid_to", F.when(~F.col("__last"), F.coalesce("valid_to", F.col(start)))).drop("__last")


def holds(at: Column, start: str = "effective_date", end: str = "valid_to") -> Column:
    """Whether a version with its interval holds at a moment. A version that ends where it starts never does."""
    began = F.col(start).isNull() | (F.col(start) <= at)
    return began & (F.col(end).isNull() | (at < F.col(end)))


def as_of_join(moments: DataFrame, versions: DataFrame, key: str, at: str, start: str, columns: list[str], *order: str, days: int = STRETCH) -> DataFrame:
    """moments with the columns of their key's version at that time: the last one that starts then or before (by order among equals); nulls where there is none.

    Versions without a start hold before all others; moments without a time or a key have no version.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    stretch = lambda c: F.floor(c / (days * 86_400_000_000)).cast("long")
    first = F.lit(-(1 << 62)).cast("long")
    v = versions.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.coalesce(micros(start), first).alias("__t"), F.struct(*(F.col(c) for c in columns)).alias("__v"), F.struct(*(F.col(c) for c in order)).alias("__o") if order else F.lit(0).alias("__o"))
    v = v.withColumn("__s", stretch(F.col("__t")))
    m = moments.withColumn("__t", F.when(F.col(key).isNotNull(), micros(at))).withColumn("__s", stretch(F.col("__t")))
    # what each stretch ends with, and what it begins with
    ends = v.groupBy("__key", "__s").agg(F.max_by("__v", F.struct("__t", "__o")).alias("__end"))
    asked = m.filter("__t is not null").select(F.col(key).alias("__key"), "__s").distinct()
    both = asked.join(ends, ["__key", "__s"], "full")
    along = Window.partitionBy("__key").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    begins = both.withColumn("__begin", F.last("__end", ignorenulls=True).over(along)).select("__key", "__s", "__begin")
    mine = m.withColumn("__key", F.col(key)).withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in moments.columns)))
    asking = mine.filter("__t is not null").join(begins, ["__key", "__s"], "left").select("__key", "__s", "__t", F.lit(1).alias("__kind"), "__row", "__begin", F.lit(None).cast(v.schema["__v"].dataType).alias("__v"), F.lit(None).cast(v.schema["__o"].dataType).alias("__o"))
    telling = v.join(asked, ["__key", "__s"], "left_semi").select("__key", "__s", "__t", F.lit(0).alias("__kind"), F.lit(None).cast(asking.schema["__row"].dataType).alias("__row"), F.lit(None).cast(v.schema["__v"].dataType).alias("__begin"), "__v", "__o")
    line = Window.partitionBy("__key", "__s").orderBy("__t", "__kind", "__o").rowsBetween(Window.unboundedPreceding, 0)
    told = asking.unionByName(telling).withColumn("__v", F.coalesce(F.last("__v", ignorenulls=True).over(line), "__begin")).filter("__kind = 1")
    found = told.select("__row.*", *(F.col(f"__v.{c}").alias(c) for c in columns))
    kinds = {c: versions.schema[c].dataType for c in columns}
    rest = m.filter("__t is null").select(*(F.col(f"`{c}`") for c in moments.columns), *(F.lit(None).cast(kinds[c]).alias(c) for c in columns))
    return found.unionByName(rest)


def clauses_at(clauses: DataFrame, at: Column) -> DataFrame:
    """The clauses that held on a day: of the versions of each canonical id in a regulation the one that holds, unless it has gone without a successor."""
    chain = intervals(clauses, ["regulation_id", "canonical_clause_id"], "effective_date", "clause_id")
    return chain.filter(holds(at) & (F.col("is_current") | F.col("valid_to").isNotNull())).drop("valid_to")
