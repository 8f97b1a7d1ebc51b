"""The search corpus: one table of clause, post, attachment and authority texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import conform
from .filters import non_blank

FAITHFUL = ("clause", "notice_section")


def build_chunks(posts: DataFrame, regulations: DataFrame, clauses: DataFrame, authority: DataFrame | None = None, attachments: DataFrame | None = None, classes=FAITHFUL, now=None) -> DataFrame:
    """Chunks of all posts, computed anew: current clauses of current regulations, and posts with a body, title first.

    classes may add authority_cell and attachment_text. chunk_id is a hash of class and source, so it is stable.
    """
    p = posts.select(F.col("post_id").alias("source_post_id"), "posted_at", F.col("board_id").alias("post_board"))
    parts = []
    if "clause" in classes:
        r = regulations.select("regulation_id", "source_post_id", "board_id")
        c = clauses.filter("is_current").join(r, "regulation_id").join(p, "source_post_id")
        parts.append(c.select(F.lit("clause").alias("chunk_class"), "board_id", "source_post_id", "clause_id", F.col("order_seq").alias("seq_in_source"), F.col("text").alias("body"), "canonical_clause_id", "clause_label", "posted_at", F.col("clause_id").alias("__id")))
    if "notice_section" in classes:
        n = posts.filter(non_blank("body_text"))
        body = F.concat(F.coalesce(F.concat("title", F.lit("\n")), F.lit("")), F.col("body_text"))
        parts.append(n.select(F.lit("notice_section").alias("chunk_class"), "board_id", F.col("post_id").alias("source_post_id"), F.lit(0).alias("seq_in_source"), body.alias("body"), "posted_at", F.col("post_id").alias("__id")))
    if "authority_cell" in classes and authority is not None:
        a = authority.filter("is_current").join(regulations.select("regulation_id", F.col("source_post_id").alias("reg_post"), "board_id"), "regulation_id").withColumn("source_post_id", F.coalesce("source_post_id", "reg_post")).join(p, "source_post_id", "left")
        body = F.concat_ws(" ", "business_category", "business_item", "action_type", "approver_role", "condition_note")
        parts.append(a.select(F.lit("authority_cell").alias("chunk_class"), "board_id", "source_post_id", "authority_id", F.col("order_seq").alias("seq_in_source"), body.alias("body"), "posted_at", F.col("authority_id").alias("__id")))
    if "attachment_text" in classes and attachments is not None:
        t = attachments.filter(non_blank("extracted_text")).join(p, attachments["post_id"] == p["source_post_id"])
        parts.append(t.select(F.lit("attachment_text").alias("chunk_class"), F.col("post_board").alias("board_id"), "source_post_id", F.col("attachment_id").alias("source_attachment_id"), F.lit(0).alias("seq_in_source"), F.col("extracted_text").alias("body"), "posted_at", F.col("attachment_id").alias("__id")))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole = whole.withColumn("chunk_id", F.xxhash64("chunk_class", "__id")).withColumns({"is_current": F.lit(True), "char_len": F.length("body"), "content_hash": F.sha2(F.col("body").cast("binary"), 256), "created_at": now if now is not None else F.lit(None).cast("timestamp")})
    return conform(whole, "chunk")


def replace_posts(chunks: DataFrame, rebuilt: DataFrame, posts: DataFrame) -> DataFrame:
    """chunks with those of the given posts (post_id) replaced by rebuilt ones."""
    kept = chunks.join(posts.select(F.col("post_id").alias("source_post_id")), "source_post_id", "left_anti")
    return kept.select(chunks.columns).unionByName(rebuilt.join(posts.select(F.col("post_id").alias("source_post_id")), "source_post_id", "left_semi").select(chunks.columns))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Partitioned by what every search filters on; only the partitions that come are overwritten."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("is_current", "board_id").parquet(path)
