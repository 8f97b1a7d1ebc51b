"""From crawled pages to tables, for many posts at once: a failure stays in its row.

Every upsert takes what a table held (the whole, or the parts that change) and returns what it holds next. top is the
largest id of the whole table, where only parts are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.redaction import content_hash
from .functions.text import html_to_text_udf, reg_type
from .operators.analytics import run_counts
from .operators.clauses import parents
from .operators.merge import absent_attachments, insert_absent, last_per_key, merge, retire_missing
from .schemas import conform, empty

NATURAL = ["board_id", "bizbox_art_no"]
# The boards that are read (number, name, slug, class, how chunks are cut).
BOARDS = (
    (73, "CEO칼럼", "ceo-column", "notice", "heading_window"),
    (74, "공지사항", "notice", "notice", "heading_window"),
    (900000409, "제안게시판", "suggestion", "etc", "heading_window"),
    (900000286, "사내규정", "regulation", "regulation", "article"),
    (900000327, "사내양식함", "form-archive", "form", "whole"),
    (900000325, "뉴스클리핑", "news-clipping", "etc", "whole"),
    (900000306, "월례회의자료", "monthly-meeting", "meeting", "heading_window"),
    (900000070, "독서게시판", "reading", "etc", "whole"),
    (900000326, "회사소개서", "company-intro", "etc", "whole"),
    (900000439, "외국어 신청", "language-apply", "form", "whole"),
    (900000575, "ERP 설치 매뉴얼", "erp-install-manual", "manual", "heading_window"),
    (900000577, "ERP 사용 매뉴얼", "erp-usage-manual", "manual", "heading_window"),
    (900000578, "ERP 인사평가 매뉴얼", "erp-hr-eval-manual", "manual", "heading_window"),
    (900000606, "ERP 사용자 교육", "erp-user-training", "manual", "heading_window"),
    (900000605, "그룹웨어 매뉴얼/OJT", "groupware-manual-ojt", "manual", "heading_window"),
    (900000668, "화상회의 매뉴얼", "video-conf-manual", "manual", "heading_window"),
    (900000669, "자격증 축하금 LIST", "cert-reward-list", "etc", "table"),
    (900000679, "버크만진단 참고자료", "birkman-reference", "etc", "whole"),
    (900000704, "임직원 교육·설문결과", "staff-training-survey", "etc", "whole"),
)
#: The board whose texts are indexed by words too.
SPLIT_WORDS = (900000286,)


def board_rows(spark, boards=BOARDS) -> DataFrame:
    df = spark.createDataFrame(list(boards), "bizbox_board_no int, name string, slug string, board_class string, default_chunk_strategy string")
    return df.withColumns({"included": F.lit(True), "use_mecab_parallel": F.col("bizbox_board_no").isin(*SPLIT_WORDS)})


def seed_boards(spark, rows: DataFrame | list[tuple] | None = None, boards: DataFrame | None = None) -> DataFrame:
    """Boards merged by number: attributes are overwritten, ids stay. rows: columns of the table, or (number, name, slug, class, included); the fixed ones if None."""
    if rows is None:
        rows = board_rows(spark)
    elif isinstance(rows, list):
        rows = spark.createDataFrame(rows, "bizbox_board_no int, name string, slug string, board_class string, included boolean")
    return merge(boards if boards is not None else empty(spark, "board"), conform(rows, "board"), ["bizbox_board_no"], keep=["board_id", "created_at"], id_column="board_id")


def seed_states(states: DataFrame, boards: DataFrame) -> DataFrame:
    """A state for each board that has none."""
    new = boards.select("board_id", F.lit("idle").alias("status"), F.lit("healthy").alias("health"), F.lit(0).alias("consecutive_failures"))
    return insert_absent(states, conform(new, "ingest_state"), ["board_id"])


def posts_of(bodies: DataFrame, boards: DataFrame, attachment_hashes: DataFrame | None = None) -> DataFrame:
    """bodies: board_no, art_no, title, author, view_count, posted_at, body_html. Post rows with text and content hash.

    attachment_hashes: board_no, art_no, sha256 of every attachment (null where there is no content): a post whose
    attachment changed has changed.
    """
    b = bodies.join(boards.select("board_id", F.col("bizbox_board_no").alias("board_no"), "board_class"), "board_no")
    if attachment_hashes is not None:
        b = b.join(attachment_hashes.groupBy("board_no", "art_no").agg(F.collect_list(F.coalesce("sha256", F.lit(""))).alias("hashes")), ["board_no", "art_no"], "left")
    else:
        b = b.withColumn("hashes", F.lit(None).cast("array<string>"))
    b = b.withColumn("body_text", html_to_text_udf("body_html"))
    none = F.array().cast("array<string>")
    url = F.concat(F.lit("/edms/board/viewPost.do?boardNo="), F.col("board_no").cast("string"), F.lit("&artNo="), F.col("art_no").cast("string"))
    return b.withColumns({"bizbox_art_no": F.col("art_no"), "author_name": F.col("author"), "content_hash": content_hash(F.col("body_text"), F.coalesce("hashes", none)), "doc_type": F.col("board_class"), "is_current": F.lit(True), "language": F.lit("ko"), "source_url": url})


def upsert_posts(posts: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """Posts merged by (board, number): unchanged content changes nothing, ids stay."""
    return merge(posts, conform(new, "post"), NATURAL, update_when=~F.col("t_content_hash").eqNullSafe(F.col("s_content_hash")), keep=["post_id"], id_column="post_id", top=top)


def attachments_of(files: DataFrame, at) -> DataFrame:
    """files: post_id, file_name, kind, url, stored, content, sha256, extract. Attachment rows."""
    x = F.col("extract")
    return files.select(
        "post_id", "file_name", "kind", F.col("url").alias("download_url"), F.concat_ws("/", F.col("post_id").cast("string"), "stored").alias("storage_path"), "sha256",
        F.length("content").cast("long").alias("byte_size"), x["page_count"].alias("page_count"), x["is_table"].alias("is_table"), x["method"].alias("extract_method"),
        x["status"].alias("ocr_status"), x["text"].alias("extracted_text"), x["error"].alias("error_msg"), F.when(F.col("content").isNotNull(), at).alias("extracted_at"), at.alias("created_at"),
    )


def upsert_attachments(attachments: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """Attachments merged by (post, stored name): a file that could not be fetched this time changes nothing, other content takes the old one's place.

    Of new names those whose content the post has already, under another name, are no new attachments.
    """
    new = conform(new, "attachment")
    named = new.join(attachments.select("post_id", "storage_path"), ["post_id", "storage_path"], "left_semi").select(new.columns)
    fresh = new.join(attachments.select("post_id", "storage_path"), ["post_id", "storage_path"], "left_anti").select(new.columns)
    fresh = last_per_key(absent_attachments(fresh, attachments), ["post_id", "storage_path"], "storage_path")
    differs = F.col("s_sha256").isNotNull() & ~F.col("t_sha256").eqNullSafe(F.col("s_sha256"))
    return merge(attachments, named.unionByName(fresh), ["post_id", "storage_path"], update_when=differs, keep=["attachment_id", "created_at"], id_column="attachment_id", top=top)


def upsert_pages(pages: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """new: attachment_id, page_no, ocr_text. Pages merged by (attachment, number)."""
    return merge(pages, conform(new, "attachment_page"), ["attachment_id", "page_no"], keep=["page_id"], id_column="page_id", top=top)


def regulations_of(posts: DataFrame) -> DataFrame:
    return conform(posts.filter("doc_type = 'regulation'").select(F.col("post_id").alias("source_post_id"), "board_id", "title", reg_type(F.col("title")).alias("reg_type"), F.lit(True).alias("is_current"), F.lit(False).alias("curated")), "regulation")


def upsert_regulations(regulations: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """Merged by source post among current ones, the lowest id of several; what a curator set stays."""
    current, old = regulations.filter("is_current"), regulations.filter("not is_current")
    first = current.groupBy("source_post_id").agg(F.min("regulation_id").alias("__first"))
    chosen = current.join(first, "source_post_id").filter("regulation_id = __first").select(regulations.columns)
    others = current.join(first, "source_post_id").filter("regulation_id <> __first").select(regulations.columns)
    top = top if top is not None else regulations.agg(F.max("regulation_id")).first()[0] or 0
    return merge(chosen, new, ["source_post_id"], keep=["regulation_id", "curated", "curated_by", "curated_at"], id_column="regulation_id", top=top).unionByName(others).unionByName(old)


def upsert_clauses(clauses: DataFrame, parsed: DataFrame, top: int | None = None, read: DataFrame | None = None) -> DataFrame:
    """Merged by canonical id among current ones, last of equal ids first; ids stay, clauses that are gone retire, parents are looked up.

    read: regulation_id of all that were parsed, also those without any clause.
    """
    rows = last_per_key(parsed, ["canonical_clause_id"], "order_seq").withColumn("is_current", F.lit(True))
    current, old = clauses.filter("is_current"), clauses.filter("not is_current")
    top = top if top is not None else clauses.agg(F.max("clause_id")).first()[0] or 0
    merged = merge(current, conform(rows, "clause"), ["canonical_clause_id"], keep=["clause_id"], id_column="clause_id", top=top)
    merged = retire_missing(merged, rows, "regulation_id", "canonical_clause_id", read)
    up = rows.select("canonical_clause_id", "parent_canonical_id", F.lit(True).alias("__read"))
    linked = parents(merged.join(up, "canonical_clause_id", "left").withColumn("__kept", F.col("parent_clause_id")))
    # a regulation that was not read again keeps its links
    linked = linked.withColumn("parent_clause_id", F.when(F.col("__read"), F.col("parent_clause_id")).otherwise(F.col("__kept")))
    return conform(linked, "clause").unionByName(old)


def upsert_authority(authority: DataFrame, rows: DataFrame, top: int | None = None) -> DataFrame:
    """Merged by canonical id among current ones; empty role lists become null."""
    roles = F.when(F.size("consulter_roles") > 0, F.col("consulter_roles"))
    new = conform(rows.withColumn("consulter_roles", roles).withColumn("is_current", F.lit(True)).withColumn("currency", F.lit("KRW")), "authority_matrix")
    current, old = authority.filter("is_current"), authority.filter("not is_current")
    top = top if top is not None else authority.agg(F.max("authority_id")).first()[0] or 0
    return merge(current, new, ["canonical_authority_id"], keep=["authority_id"], id_column="authority_id", top=top).unionByName(old)


def summarize(processed: DataFrame) -> DataFrame:
    """Counters of a run per board; the mark is that of all that was read, as failures are kept by themselves (operators.ledger)."""
    return run_counts(processed).withColumn("last_art_no", F.greatest("last_art_no", "highest_failure"))
