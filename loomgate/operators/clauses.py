"""Numbered regulations and approval matrices to rows: lines and windows, no parser state outside the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import band_udf
from ..functions.text import after_title, clause_date, strip, title_of

#: The circled numbers 1 to 50, from their three ranges.
CIRCLED = "".join(map(chr, [*range(0x2460, 0x2474), *range(0x3251, 0x3260), *range(0x32B1, 0x32C0)]))
# Line markers, in the order they are tried.
MARKERS = {
    "article": r"^제\s*(\d+)\s*조(?:\s*의\s*(\d+))?",
    "supplement": r"^부\s*칙()",
    "appendix": r"^별\s*[표지]\s*(\d+)?",
    "paragraph": f"^([{CIRCLED}])",
    "item": r"^(\d+)\s*\.",
    "subitem": r"^([가나다라마바사아자차카타파하])\s*\.",
}


def parse_clauses(regulations: DataFrame, legacy_ids: bool = False) -> DataFrame:
    """regulations: regulation_id, text. One row per marked line, with the lines that follow folded into its text.

    Numbers, parents and ids come from running counts and last values over a regulation's lines. Articles after a
    supplement are ids of their own below it; legacy_ids lets them repeat the ids of the main body. Lines before the
    first marker are dropped. Null and empty texts give no rows.
    """
    lines = regulations.select("regulation_id", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")).alias("line", "raw"))
    lines = lines.withColumn("raw", strip(F.col("raw"))).filter("raw <> ''")
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(MARKERS.items()):
        kind = F.when(F.col("raw").rlike(pattern), name).otherwise(kind)
    marker = lambda k, g: F.nullif(F.regexp_extract("raw", MARKERS[k], g), F.lit(""))
    rows = lines.withColumn("kind", kind)
    run = Window.partitionBy("regulation_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *k: F.col("kind").isin(*k)
    count = lambda c, w=run: F.sum(F.when(c, 1).otherwise(0)).over(w)
    head = is_("article", "supplement", "appendix")
    rows = rows.withColumns({"seq": count(F.col("kind").isNotNull()) - 1, "heads": count(head), "groups": count(head | is_("paragraph")), "supps": count(is_("supplement")), "appxs": count(is_("appendix")), "sections": count(is_("supplement", "appendix"))})
    key = F.concat(F.lit("R"), F.col("regulation_id").cast("string"), F.lit("#"))
    in_supplement = F.last(F.when(is_("supplement"), True).when(is_("appendix"), False), ignorenulls=True).over(run)
    supplement = F.concat(key, F.lit("supp"), F.col("supps").cast("string"))
    branch = lambda pre: F.coalesce(F.concat(F.lit(pre), marker("article", 2).try_cast("int").cast("string")), F.lit(""))
    number = F.concat(marker("article", 1).try_cast("int").cast("string"), branch("의"))
    below = F.lit(False) if legacy_ids else F.coalesce(in_supplement, F.lit(False))
    head_id = (
        F.when(is_("article") & below, F.concat(supplement, F.lit("-a"), number))
        .when(is_("article"), F.concat(key, F.lit("a"), number))
        .when(is_("supplement"), supplement)
        .when(is_("appendix"), F.concat(key, F.lit("appx"), F.col("appxs").cast("string")))
    )
    rows = rows.withColumn("head_id", head_id).withColumn("above", F.when(is_("article") & below, supplement))
    rows = rows.withColumn("head", F.coalesce(F.last("head_id", ignorenulls=True).over(run), F.concat(key, F.lit("a0"))))
    within = lambda g: Window.partitionBy("regulation_id", g).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    paragraph_no = F.when(is_("paragraph"), F.instr(F.lit(CIRCLED), marker("paragraph", 1)))
    rows = rows.withColumn("paragraph_no", paragraph_no).withColumn("para", F.last(F.concat("head", F.lit("-p"), F.col("paragraph_no").cast("string")), ignorenulls=True).over(within("heads")))
    item_no = F.when(is_("item"), marker("item", 1).try_cast("int"))
    rows = rows.withColumn("item_no", item_no).withColumn("item", F.last(F.concat(F.coalesce("para", "head"), F.lit("-i"), F.col("item_no").cast("string")), ignorenulls=True).over(within("groups")))
    owner = F.coalesce("item", "para", "head")
    sub = F.when(is_("subitem"), marker("subitem", 1))
    rows = rows.withColumn("sub_item_label", sub)
    rest = F.col("raw")
    for name in MARKERS:
        rest = F.when(is_(name), strip(F.regexp_replace("raw", MARKERS[name], ""))).otherwise(rest)
    rows = rows.withColumn("rest", rest).withColumn("clause_title", F.when(is_("article"), title_of(F.col("rest"))))
    body = F.when(is_("article"), after_title(F.col("rest"))).otherwise(F.col("rest"))
    marked = rows.filter("kind is not null").select(
        "regulation_id",
        "seq",
        F.when(is_("paragraph"), F.col("para")).when(is_("item"), F.col("item")).when(is_("subitem"), F.concat(owner, F.lit("-s"), sub)).otherwise(F.col("head_id")).alias("canonical_clause_id"),
        F.when(is_("article"), F.concat(F.lit("제"), marker("article", 1).try_cast("int").cast("string"), F.lit("조"), branch("의")))
        .when(is_("supplement"), "부칙")
        .when(is_("appendix"), F.concat(F.lit("별표"), F.coalesce(marker("appendix", 1), F.lit(""))))
        .when(is_("paragraph"), marker("paragraph", 1))
        .otherwise(F.concat(F.coalesce(F.col("item_no").cast("string"), sub), F.lit(".")))
        .alias("clause_label"),
        F.when(head, "article").otherwise(F.col("kind")).alias("depth"),
        F.when(is_("article"), marker("article", 1).try_cast("int")).alias("article_no"),
        F.when(is_("article"), marker("article", 2).try_cast("smallint")).alias("article_branch"),
        F.col("paragraph_no").cast("smallint").alias("paragraph_no"),
        F.col("item_no").try_cast("smallint").alias("item_no"),
        "sub_item_label",
        "clause_title",
        F.when(is_("supplement"), clause_date(F.col("raw"))).alias("effective_date"),
        F.when(is_("paragraph"), F.col("head")).when(is_("item"), F.coalesce("para", "head")).when(is_("subitem"), owner).otherwise(F.col("above")).alias("parent_canonical_id"),
    )
    texts = rows.filter("seq >= 0").groupBy("regulation_id", "seq").agg(F.array_sort(F.collect_list(F.struct("line", F.when(F.col("kind").isNull(), F.col("raw")).otherwise(body).alias("t")))).alias("parts"))
    texts = texts.select("regulation_id", "seq", strip(F.array_join(F.filter(F.transform("parts", lambda p: p["t"]), lambda t: t != ""), " ")).alias("text"))
    return marked.join(texts, ["regulation_id", "seq"]).withColumn("order_seq", F.col("seq").cast("int")).drop("seq")


# Action types of approval matrices.
ACTIONS = ("전결", "합의", "보고", "협조")


def parse_matrix(cells: DataFrame, actions=ACTIONS) -> tuple[DataFrame, DataFrame]:
    """cells: regulation_id, order_seq, business_item, action_type, amount_expr, ... to (rows, quarantine with error).

    Where a cell has amount_min or amount_max instead of an expression, those are its band.
    """
    if "amount_min" not in cells.columns:
        cells = cells.withColumns({"amount_min": F.lit(None).cast("long"), "amount_max": F.lit(None).cast("long")})
    cells = cells.withColumn("action_type", strip(F.col("action_type")))
    given = F.struct(F.when(F.col("amount_min") <= F.coalesce("amount_max", "amount_min"), F.col("amount_min")).alias("amount_min"), F.col("amount_max").alias("amount_max"), F.when(F.col("amount_min") > F.col("amount_max"), "least above most").alias("error"))
    band = F.when(F.col("amount_expr").isNull(), given).otherwise(band_udf("amount_expr"))
    parsed = cells.withColumn("band", band).withColumn("error", F.when(~F.coalesce(F.col("action_type").isin(*actions), F.lit(False)), F.concat(F.lit("action type "), F.coalesce("action_type", F.lit("null")))).otherwise(F.col("band.error")))
    parsed = parsed.withColumn("canonical_authority_id", F.concat(F.lit("R"), F.col("regulation_id").cast("string"), F.lit("#auth"), F.col("order_seq").cast("string")))
    good = parsed.filter("error is null").withColumns({"amount_min": F.col("band.amount_min"), "amount_max": F.col("band.amount_max")}).drop("band", "error")
    return good, parsed.filter("error is not null").drop("band")


def parents(clauses: DataFrame) -> DataFrame:
    """clauses with parent_clause_id looked up by parent_canonical_id among the current ones."""
    p = clauses.filter("is_current").select(F.col("canonical_clause_id").alias("parent_canonical_id"), F.col("clause_id").alias("__parent"))
    return clauses.join(p, "parent_canonical_id", "left").withColumn("parent_clause_id", F.col("__parent")).drop("__parent")


def orphan_clauses(clauses: DataFrame) -> Column:
    return F.col("parent_canonical_id").isNotNull() & F.col("parent_clause_id").isNull()
