"""Mixing sources to target weights, by DataFrame functions only.

Words are counted per source, a source's target divided by its size is its repetition rate, and a document is emitted
floor(rate) times plus once more if a hash of its id and the seed falls below the fraction.

Targets share the total by weight, but stop at MOST times their source's size; what is over is shared again by weight
until none is above. That is a water level: it is raised from the total shared by all, each time taking the sources
that it passes out of the sharing, until it passes none; a round is one sum over the sources, few are needed. Weights go
by a source's place in the order of names, which comes from a range partitioning and the sizes of its partitions. So
neither documents nor sources, however many, meet in one task: sums are taken on the map side, and the rates come back
by a join whose hot source AQE can split (or by a broadcast where Spark measures the sources to be small).

Null sources are one source, last in order; null texts have size 0; sources of size 0 get target 0 and rate 0.
Repeated rows get equal draws. An empty table gives no rows. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, read

#: By source in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 2024
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def sizes(col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, col: str = "doc_id"):
    """Uniform in [0, 1): 52 bits of a hash of the id and the seed."""
    text = F.concat(F.coalesce(F.col(col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def placed(per_source: DataFrame) -> DataFrame:
    """per_source with place, from 0, of each source in the order of names, null last."""
    order = F.col("source").asc_nulls_last()
    sorted_ = materialize(per_source.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    # one row a partition
    parts = sorted_.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    out = sorted_.withColumn("__part", part).join(F.broadcast(parts), "__part")
    return out.withColumn("place", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__before")


def targets(per_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """per_source: source, source_size. Adds target (double) and rate (double, most at most)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    t = materialize(placed(per_source).withColumn("w", weight).select("source", "source_size", "w"))
    sums = F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")
    all_ = t.agg(*sums).first()
    exact = lambda c, digits: (c if isinstance(c, Column) else F.lit(c)).cast(f"decimal({digits},0)")
    left, share = all_.size, max(all_.w, 1)
    while True:
        # the level is left / share; sources whose limit it passes share no more
        full = exact(left, 20) * exact(F.col("w"), 10) > exact(F.col("source_size") * most, 20) * exact(share, 18)
        passed = t.filter(full).agg(*sums).first()
        if (left, share) == (after := (all_.size - most * passed.size, max(all_.w - passed.w, 1))):
            break
        left, share = after
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.lit(left).cast("double") * F.col("w") / F.lit(share))
    t = t.select("source", "source_size", target.alias("target"))
    return t.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))


def rates(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, rate, copies (int) and taken (size * copies).

    Words are counted twice, for the sums and for the rows: that is less than a second copy of the texts. Where docs has
    no other long columns, count them into a written table first, as op1 does (see counted).
    """
    return _rated(docs.select([f"`{c}`" for c in docs.columns if c.lower() not in ADDED]).withColumn("size", sizes()), weights, most, seed)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of docs as a written table."""
    return materialize(docs.select("doc_id", "source", sizes().alias("size")))


def _rated(sized: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = materialize(targets(per_source, weights, most)).withColumnRenamed("source", "__source")
    out = sized.join(rate, sized["source"].eqNullSafe(F.col("__source"))).drop("__source")
    whole = F.floor("rate").cast("int")
    copies = whole + (draw(seed) < F.col("rate") - whole).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them, with the columns of docs as they are, whatever their names."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "text", "source")
    r = rates(whole, weights, most, seed).filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return r.select("__row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return _rated(counted(docs)).select("doc_id", "size", "source_size", "target", "copies", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM s
), t AS (
  SELECT *,
    CAST((SELECT sum(source_size) FROM w) - 3 * coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS "left",
    CAST((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0) AS BIGINT) AS share,
    row_number() OVER (ORDER BY source_size / w, encode(source) NULLS LAST) AS k
  FROM w WINDOW b AS (ORDER BY source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, "left" * w > 3 * source_size * share AS is_full FROM t
), p AS (
  SELECT "left" AS pool_left, share AS pool_share FROM f WHERE NOT is_full ORDER BY k LIMIT 1
), g AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(pool_left AS DOUBLE) * w / pool_share END AS target
  FROM f LEFT JOIN p ON true
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':2024'), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken FROM c
"""
