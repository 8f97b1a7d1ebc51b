"""Approval lines, counts, version diffs and retrieval metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, LongType

from ..functions.text import collapse
from .filters import in_band

LINE = ("authority_id", "business_item", "action_type", "approver_role", "consulter_roles", "amount_min", "amount_max", "condition_note", "canonical_authority_id", "order_seq")


def _scoped(authority: DataFrame, regulations: DataFrame | None, board_ids) -> DataFrame:
    out = authority.filter("is_current")
    if board_ids is None or regulations is None:
        return out
    if not board_ids:
        return out.limit(0)
    mine = regulations.filter(F.col("board_id").isin(list(board_ids))).select("regulation_id")
    return out.join(mine, "regulation_id", "left_semi")


def approval_line(authority: DataFrame, amount: int, regulations: DataFrame | None = None, board_ids=None) -> DataFrame:
    """Current rows whose band holds the amount, in order_seq (nulls last), then id."""
    return _scoped(authority, regulations, board_ids).filter(in_band(amount)).select(*LINE).orderBy(F.col("order_seq").asc_nulls_last(), "authority_id")


def approvers(authority: DataFrame, text: str, regulations: DataFrame | None = None, board_ids=None, stop=()) -> DataFrame:
    """Current rows whose business item matches all words of a question; stop words are left out of it."""
    from .search import match, normal, parse_query

    groups = [g for g in parse_query(text) if not set(g) & {s.lower() for s in stop}]
    rows = _scoped(authority, regulations, board_ids)
    ok, _ = match(groups, normal(F.col("business_item")))
    return (rows.filter(ok) if groups else rows.limit(0)).select(*LINE).orderBy(F.col("order_seq").asc_nulls_last(), "authority_id")


def dispatch(question: str, authority: DataFrame, regulations: DataFrame, board_ids=None) -> tuple[str, DataFrame]:
    """(kind, rows) of a question about approvals or numbers: an amount in it asks for the approval line, a word of counting for
    the regulations of each board, anything else for the approvers of a business item. No rows is an answer.

    All kinds have the columns of LINE and label, value: the business item and its approver, or the board and its count.
    """
    from ..functions.money import question_amount
    from ..functions.text import AGGREGATE_WORDS, AUTHORITY_WORDS, normalize_query

    text = normalize_query(question)
    amount = question_amount(text)
    lined = lambda df: df.withColumn("label", F.col("business_item")).withColumn("value", F.col("approver_role"))
    if amount is not None:
        return "approval_line", lined(approval_line(authority, amount, regulations, board_ids))
    if not any(w in text for w in AUTHORITY_WORDS) and any(w in text for w in AGGREGATE_WORDS):
        counts = board_counts(regulations, None, board_ids)
        none = [F.lit(None).cast(authority.schema[c].dataType).alias(c) for c in LINE]
        return "board_count", counts.select(*none, F.col("board_id").cast("string").alias("label"), F.col("value").cast("string").alias("value"))
    return "approver", lined(approvers(authority, text, regulations, board_ids, stop=AUTHORITY_WORDS))


def dispatch_many(queries: DataFrame, authority: DataFrame, regulations: DataFrame | None = None, board_ids=None) -> DataFrame:
    """queries: query_id, text. What dispatch gives for each, in one plan: query_id, kind, position (from 1) and the columns of LINE.

    Questions that count have no line, so no row; kinds_of tells them. Its rows are the questions times their lines;
    dispatch_alike has them without that product.
    """
    alike, lines = dispatch_alike(queries, authority, regulations, board_ids)
    return alike.select("query_id", "lead").join(lines, "lead").drop("lead")


def dispatch_alike(queries: DataFrame, authority: DataFrame, regulations: DataFrame | None = None, board_ids=None) -> tuple[DataFrame, DataFrame]:
    """queries: query_id, text. (questions, lines): query_id, kind and lead of each, and the lines of leads only: lead, kind, position, LINE.

    Questions that must have the same lines are alike and have one lead, the smallest query_id: those of one text, and
    those whose amounts no end of a band parts. Amounts meet bands by a band join, words the business items through
    postings of those.
    """
    from ..functions.text import AUTHORITY_WORDS
    from ..runtime import Workspace
    from .batch import divide, term_hits, terms_of, text_postings

    work = Workspace(authority.sparkSession)
    lines = work.write(_scoped(authority, regulations, board_ids).select(*LINE))
    q = kinds_of(queries).filter("kind in ('approval_line', 'approver')")
    q = q.withColumn("__alike", F.when(F.col("kind") == "approver", F.col("normalized")).otherwise(between_ends(lines)(F.col("amount")).cast("string")))
    q = work.write(q)
    alike = q.groupBy("kind", "__alike").agg(F.min_by(F.struct("query_id", "normalized", "amount"), "query_id").alias("l")).select("kind", "__alike", "l.*")
    alike = work.write(alike)
    questions = work.write(q.select("query_id", "kind", "__alike").join(alike.select("kind", "__alike", F.col("query_id").alias("lead")), ["kind", "__alike"]).select("query_id", "kind", "lead"))
    by_amount = band_join(alike.filter("kind = 'approval_line'").select("query_id", "amount"), "amount", lines).drop("amount").withColumn("kind", F.lit("approval_line"))
    terms = terms_of(alike.filter("kind = 'approver'").select("query_id", F.col("normalized").alias("text")))
    stops = terms.filter(F.col("term").isin([w.lower() for w in AUTHORITY_WORDS])).select("query_id", "g").distinct()
    terms = work.write(terms.join(stops, ["query_id", "g"], "left_anti").select("query_id", "g", "term"))
    items = lines.filter("authority_id is not null").select(F.col("authority_id").alias("chunk_id"), F.col("business_item").alias("body"))
    found = work.write(term_hits(terms, items, text_postings(items), work=work))
    whole = divide(terms, found, work).select("query_id", F.col("chunk_id").alias("authority_id"))
    by_item = lines.join(whole, "authority_id").withColumn("kind", F.lit("approver"))
    order = Window.partitionBy("query_id").orderBy(F.col("order_seq").asc_nulls_last(), "authority_id")
    both = by_amount.select("query_id", "kind", *LINE).unionByName(by_item.select("query_id", "kind", *LINE))
    out = work.write(both.withColumn("position", F.row_number().over(order)).withColumnRenamed("query_id", "lead"))
    work.remove(keep=(questions, out))
    return questions, out


def between_ends(bands: DataFrame, most: int = 10_000):
    """What makes of a column of amounts a number that is the same for amounts that no end of a band parts.

    Ends are counted first; of more than so many the amount itself is that number.
    """
    ends = bands.select(F.explode(F.array("amount_min", F.col("amount_max") + 1)).alias("e")).filter("e is not null").distinct().limit(most + 1).collect()
    if len(ends) > most:
        return lambda c: c
    points = np.array(sorted(r.e for r in ends), np.int64)

    @arrow_udf(LongType())
    def place(v: pa.Array) -> pa.Array:
        at = np.searchsorted(points, v.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(at.astype(np.int64), mask=~v.is_valid().to_numpy(zero_copy_only=False))

    return place


def kinds_of(queries: DataFrame) -> DataFrame:
    """query_id, normalized, intent, amount and kind: search, or what dispatch would make of the question."""
    from ..functions.money import question_amount_udf
    from ..functions.text import intent, normalize_query_udf

    q = queries.select("query_id", normalize_query_udf(F.coalesce("text", F.lit(""))).alias("normalized"))
    q = q.withColumn("intent", intent(F.col("normalized"))).withColumn("amount", F.when(F.col("intent") != "search", question_amount_udf("normalized")))
    kind = F.when(F.col("intent") == "search", "search").when(F.col("amount").isNotNull(), "approval_line").when(F.col("intent") == "aggregate", "board_count").otherwise("approver")
    return q.withColumn("kind", kind)


#: Cells of equal depth that values are dealt to in a band join of many bands.
CELLS = 256


def equal_depth(values: DataFrame, value: str, cells: int = CELLS) -> tuple[list, list[int]]:
    """(ends, shares): the largest values of cells with about as many rows each, and how many cells' rows each has.

    Approximate quantiles, computed in parts and merged. A value that fills several cells is one, with their number.
    """
    marks = values.agg(F.percentile_approx(value, [i / cells for i in range(1, cells + 1)], 100 * cells).alias("q")).first().q
    ends = sorted(set(marks or []))
    return ends, [sum(q == e for q in marks) for e in ends]


def band_join(values: DataFrame, value: str, bands: DataFrame, cells: int = CELLS, broadcast_rows: int = 10_000) -> DataFrame:
    """Each value with the bands that hold it.

    Few bands (counted first, broadcast_rows at most) are broadcast. More are met through cells of equal depth: a band
    is listed in the cells it covers, an open one to the first or the last. A cell that one value fills many times over is dealt to
    as many parts by a hash of its rows, and its bands are listed in each, so a value that half of all rows have spreads.
    """
    n = bands.count()
    if n <= broadcast_rows:
        return values.join(F.broadcast(bands), in_band(F.col(value)))
    ends, shares = equal_depth(values, value, cells)
    if not ends:
        return values.join(bands, F.lit(False))
    last = len(ends) - 1

    @arrow_udf(IntegerType())
    def cell(v: pa.Array) -> pa.Array:
        """The first cell that does not end below; beyond all ends the last one."""
        at = np.minimum(np.searchsorted(np.array(ends), v.fill_null(0).to_numpy(zero_copy_only=False)), last)
        return pa.array(at.astype(np.int32), mask=~v.is_valid().to_numpy(zero_copy_only=False))

    parts = F.element_at(F.array(*map(F.lit, shares)), F.col("__cell") + 1)
    low, high = F.coalesce(cell(F.col("amount_min")), F.lit(0)), F.coalesce(cell(F.col("amount_max")), F.lit(last))
    b = bands.filter("amount_min is null or amount_max is null or amount_min <= amount_max").withColumn("__cell", F.explode(F.sequence(low, high)))
    b = b.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    v = values.filter(F.col(value).isNotNull()).withColumn("__cell", cell(F.col(value)))
    v = v.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int"))
    return v.join(b, ["__cell", "__part"]).filter(in_band(F.col(value))).drop("__cell", "__part")


def board_counts(regulations: DataFrame, boards: DataFrame | None = None, board_ids=None) -> DataFrame:
    """Current regulations per board, in order of board; with boards, their names."""
    from .filters import board_filter

    out = regulations.filter(F.col("is_current") & board_filter("board_id", board_ids)).groupBy("board_id").agg(F.count(F.lit(1)).alias("value"))
    if boards is not None:
        out = out.join(boards.select("board_id", F.col("name").alias("label")), "board_id", "left").select("board_id", "label", "value")
    return out.orderBy("board_id")


def clause_diff(old: DataFrame, new: DataFrame, key: str = "relative") -> DataFrame:
    """change (added, removed, changed), key, label, before, after.

    Keys are the part of the canonical id after '#' (relative), or the whole (canonical), under which clauses of two
    regulations never meet. Of equal keys the last row (by order_seq) counts; white space does not.
    """
    from .merge import last_per_key

    ident = F.col("canonical_clause_id") if key == "canonical" else F.coalesce(F.nullif(F.regexp_extract("canonical_clause_id", "#(.*)$", 1), F.lit("")), F.col("canonical_clause_id"))

    def side(df, name):
        order = "order_seq" if "order_seq" in df.columns else "clause_id" if "clause_id" in df.columns else "canonical_clause_id"
        rows = last_per_key(df.withColumn("key", ident).withColumn("__o", F.col(order)), ["key"], "__o")
        return rows.select("key", F.col("clause_label").alias(f"label_{name}"), F.col("text").alias(name), F.lit(True).alias(f"in_{name}"))

    both = side(old, "before").join(side(new, "after"), "key", "full")
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(~collapse(F.coalesce("before", F.lit(""))).eqNullSafe(collapse(F.coalesce("after", F.lit("")))), "changed")
    return both.withColumn("change", change).filter("change is not null").select("change", "key", F.coalesce("label_after", "label_before").alias("clause_label"), "before", "after")


def evaluate(queries: DataFrame, gold: DataFrame, found: DataFrame, cited: DataFrame, abstained: DataFrame, k: int = 10, work=None) -> DataFrame:
    """One row: total, recall (share of queries with gold that have one in their top k), citation_accuracy (the same of what
    is cited, without those that should abstain), abstain_recall, over_abstain, and per answer type totals and hits of recall.

    queries: eval_query_id, answer_type, should_abstain. gold: eval_query_id, relevance, expected_canonical_id.
    found: eval_query_id, canonical_id, rank. cited: eval_query_id, canonical_id. abstained: eval_query_id, abstained.
    Shares of nothing are null. Gold may be far larger than what is found: no more of it is kept than a row a query.
    work: a Workspace where what is found and cited is written, so that Spark knows how small it is, and what of it is gold.
    """
    g = gold.filter("relevance >= 1 and expected_canonical_id is not null").select("eval_query_id", F.col("expected_canonical_id").alias("canonical_id"))
    top = found.filter(F.col("rank") <= k).select("eval_query_id", "canonical_id", F.lit(True).alias("hit"), F.lit(False).alias("right"))
    picks = top.unionByName(cited.select("eval_query_id", "canonical_id", F.lit(False).alias("hit"), F.lit(True).alias("right")))
    picks = picks.groupBy("eval_query_id", "canonical_id").agg(F.max("hit").alias("hit"), F.max("right").alias("right"))
    picks = picks if work is None else work.write(picks)
    met = g.join(picks, ["eval_query_id", "canonical_id"], "left").groupBy("eval_query_id").agg(F.max("hit").alias("hit"), F.max("right").alias("right"))
    met = met if work is None else work.write(met)
    q = queries.join(met.withColumn("has_gold", F.lit(True)), "eval_query_id", "left")
    q = q.join(picks.filter("right").select("eval_query_id").distinct().withColumn("any_cited", F.lit(True)), "eval_query_id", "left")
    q = q.join(abstained.select("eval_query_id", "abstained"), "eval_query_id", "left")
    q = q.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_gold", "hit", "right", "any_cited", "abstained", "should_abstain")})
    share = lambda part, whole: F.try_divide(F.count_if(part).cast("double"), F.count_if(whole).cast("double"))
    per = F.map_from_entries(F.array_sort(F.collect_list(F.struct("answer_type", "n"))))
    found_per = F.map_from_entries(F.array_sort(F.collect_list(F.struct("answer_type", "found"))))
    types = q.groupBy("answer_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_gold") & F.col("hit")).alias("found")).agg(per.alias("per_type"), found_per.alias("recall_per_type"))
    main = q.agg(
        F.count(F.lit(1)).alias("total"),
        share(F.col("has_gold") & F.col("hit"), F.col("has_gold")).alias("recall"),
        share(F.col("has_gold") & F.col("right") & ~F.col("should_abstain"), F.col("has_gold") & ~F.col("should_abstain")).alias("citation_accuracy"),
        share(F.col("should_abstain") & F.col("abstained"), F.col("should_abstain")).alias("abstain_recall"),
        F.count_if(~F.col("should_abstain") & F.col("abstained")).alias("over_abstain"),
    )
    return main.crossJoin(types)  # both have one row: aggregates without keys


def run_counts(posts: DataFrame) -> DataFrame:
    """Per board: posts, attachments, clauses, authorities, failures, the highest failed number, and the marks of what succeeded. posts: board_id, art_no, posted_at, error, counts."""
    ok = F.col("error").isNull()
    return posts.groupBy("board_id").agg(
        F.count_if(ok).alias("posts"),
        F.coalesce(F.sum(F.when(ok, F.col("n_attachments"))), F.lit(0)).alias("attachments"),
        F.coalesce(F.sum(F.when(ok, F.col("n_clauses"))), F.lit(0)).alias("clauses"),
        F.coalesce(F.sum(F.when(ok, F.col("n_authorities"))), F.lit(0)).alias("authorities"),
        F.count_if(~ok).alias("failures"),
        F.max(F.when(ok, F.col("art_no"))).alias("last_art_no"),
        F.max(F.when(ok, F.col("posted_at"))).alias("last_posted_at"),
        F.max(F.when(~ok, F.col("art_no"))).alias("highest_failure"),
    )
