"""Keyed merges, versions and state over plain tables: functions from old and new rows to the next table.

Parquet has no MERGE, so a merge is a full outer join on the key whose result replaces the table (or a partition of
it). Keys meet in one shuffle per side; a target bucketed by its key needs none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the largest order."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merge(target: DataFrame, source: DataFrame, keys: list[str], update_when: Column | None = None, keep: list[str] = (), id_column: str | None = None, top: int | None = None) -> DataFrame:
    """The target after source is merged in.

    source has one row per key. Rows whose key is in both take source's values, except keep, where update_when holds
    (over columns t_<name> and s_<name>; always if None). New keys are inserted, with ids above the largest one (top, or
    target's own where target is the whole table) if id_column is given. Keys compare null-safe.
    """
    cols = target.columns
    t = target.select([F.col(c).alias(f"t_{c}") for c in cols]).withColumn("t__in", F.lit(True))
    s = source.select([F.col(c).alias(f"s_{c}") for c in cols if c in source.columns]).withColumn("s__in", F.lit(True))
    on = [F.col(f"t_{k}").eqNullSafe(F.col(f"s_{k}")) for k in keys]
    both = t.join(s, on, "full")
    both_in = F.col("t__in").isNotNull() & F.col("s__in").isNotNull()
    update = both_in if update_when is None else both_in & F.coalesce(update_when, F.lit(False))
    out = []
    for c in cols:
        old = F.col(f"t_{c}")
        new = F.col(f"s_{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        fixed = c == id_column or c in keep or c not in source.columns
        out.append(F.when(F.col("t__in").isNull(), new).when(update & F.lit(not fixed), new).otherwise(old).cast(target.schema[c].dataType).alias(c))
    merged = both.select(*out, F.col("t__in").isNull().alias("__new"))
    return assign_ids(merged, target, id_column, keys, top) if id_column else merged.drop("__new")


#: New rows that one task numbers at most, about.
NUMBERED = 1_000_000


def assign_ids(merged: DataFrame, target: DataFrame, id_column: str, keys: list[str], top: int | None = None) -> DataFrame:
    """New rows get ids above the largest, by a hash of their key and then the key: equal rows get equal ids however often they are computed.

    Keys are dealt by their hash, each task numbers its own, and the counts of the tasks before it are added.
    """
    old, new = merged.filter(~F.col("__new")).drop("__new"), merged.filter("__new").drop("__new")
    if top is None:
        top = target.agg(F.max(id_column)).first()[0] or 0
    deals = max(1, -(-new.count() // NUMBERED))
    dealt = new.withColumn("__deal", F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(deals)).cast("int"))
    sizes = dealt.groupBy("__deal").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__deal").orderBy(*keys))
    # a row a deal
    numbered = dealt.withColumn("__at", place).join(F.broadcast(sizes.select("__deal", before.alias("__before"))), "__deal")
    numbered = numbered.withColumn(id_column, (F.lit(top) + F.col("__before") + F.col("__at")).cast(target.schema[id_column].dataType))
    return old.unionByName(numbered.select(old.columns))


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows of source whose key it has not."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(target.columns))


def absent_attachments(new: DataFrame, old: DataFrame) -> DataFrame:
    """Attachments that are new by (post_id, file sequence) and by (post_id, sha256); nulls match nothing."""
    by_seq = old.filter("bizbox_file_seq is not null").select("post_id", "bizbox_file_seq").distinct()
    by_sha = old.filter("sha256 is not null").select("post_id", "sha256").distinct()
    return new.join(by_seq, ["post_id", "bizbox_file_seq"], "left_anti").join(by_sha, ["post_id", "sha256"], "left_anti").select(new.columns)


def supersede(target: DataFrame, new: DataFrame, key: str, id_column: str, link: str | None, expire: dict[str, Column]) -> DataFrame:
    """Slowly changing rows: current rows whose key new has expire (not current, with expire's values), new ones are added and linked to them."""
    cols = target.columns
    hit = new.select(F.col(key).alias("__key")).distinct()
    old = target.join(hit, target[key] == F.col("__key"), "left")
    ends = F.col("__key").isNotNull() & F.col("is_current")
    old = old.select([F.when(ends, F.lit(False) if c == "is_current" else expire[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c == "is_current" or c in expire else F.col(c) for c in cols])
    fresh = new.withColumn("is_current", F.lit(True))
    if link:
        before = target.filter("is_current").select(F.col(key), F.col(id_column).alias("__old"))
        fresh = fresh.join(before, key, "left").withColumn(link, F.col("__old"))
    return old.unionByName(fresh.select([F.col(c) if c in fresh.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in cols]))


def retire_missing(target: DataFrame, seen: DataFrame, scope: str, key: str, scopes: DataFrame | None = None) -> DataFrame:
    """Current rows of the scopes that were read again (those in seen, or given) whose key did not come back are no longer current."""
    scopes = (seen if scopes is None else scopes).select(scope).distinct().withColumn("__scope", F.lit(True))
    keys = seen.select(scope, key).distinct().withColumn("__seen", F.lit(True))
    out = target.join(scopes, scope, "left").join(keys, [scope, key], "left")
    gone = F.col("__scope").isNotNull() & F.col("__seen").isNull()
    return out.withColumn("is_current", F.col("is_current") & ~gone).select(target.columns)


def advance_state(state: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """state after runs (board_id, last_art_no, last_posted_at, posts, attachments, failures): marks only rise, totals add up, success needs no failure."""
    r = runs.select("board_id", *(F.col(c).alias(f"r_{c}") for c in ("last_art_no", "last_posted_at", "posts", "attachments", "failures")))
    out = state.join(r, "board_id", "left")
    ran = F.col("r_posts").isNotNull()
    add = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    return out.withColumns(
        {
            "last_art_no": F.greatest("last_art_no", "r_last_art_no"),
            "last_posted_at": F.greatest("last_posted_at", "r_last_posted_at"),
            "total_posts": add("total_posts", "r_posts"),
            "total_attachments": add("total_attachments", "r_attachments"),
            "last_run_at": F.when(ran, now).otherwise(F.col("last_run_at")),
            "last_success_at": F.when(ran & (F.col("r_failures") == 0), now).otherwise(F.col("last_success_at")),
        }
    ).select(state.columns)
