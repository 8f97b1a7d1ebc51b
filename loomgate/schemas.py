"""Table schemas, value rules and constraint checks.

A constraint is a boolean expression that holds for valid rows. validate() splits a table into valid rows and a
quarantine with the names of the rules each row breaks; key and reference checks are queries whose result is empty
when all is well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

# The columns of the tables, in Spark DDL.
DDL = {
    "board": "board_id int, bizbox_board_no int, name string, slug string, board_class string, included boolean, use_mecab_parallel boolean, default_chunk_strategy string, required_role string, created_at timestamp, updated_at timestamp",
    "post": "post_id bigint, board_id int, bizbox_art_no bigint, title string, body_html string, body_text string, doc_type string, author_name string, author_dept string, posted_at timestamp, view_count int, source_url string, content_hash string, is_current boolean, superseded_by_post_id bigint, language string, crawled_at timestamp, source_updated_at timestamp",
    "regulation": "regulation_id bigint, source_post_id bigint, board_id int, reg_code string, title string, category string, reg_type string, effective_date date, revision_no smallint, is_current boolean, supersedes_regulation_id bigint, enacted_date date, abolished_date date, curated boolean, curated_by string, curated_at timestamp",
    "clause": "clause_id bigint, regulation_id bigint, canonical_clause_id string, article_no int, article_branch smallint, paragraph_no smallint, item_no smallint, sub_item_label string, clause_label string, clause_title string, text string, parent_clause_id bigint, depth string, effective_date date, is_current boolean, supersedes_clause_id bigint, order_seq int, amended_at timestamp",
    "attachment": "attachment_id bigint, post_id bigint, file_name string, mime_type string, kind string, storage_path string, download_url string, bizbox_file_seq bigint, byte_size bigint, sha256 string, page_count int, is_table boolean, extract_method string, ocr_status string, extracted_text string, error_msg string, extracted_at timestamp, created_at timestamp",
    "attachment_page": "page_id bigint, attachment_id bigint, page_no int, image_path string, ocr_text string, ocr_confidence float, width_px int, height_px int",
    "authority_matrix": "authority_id bigint, regulation_id bigint, source_post_id bigint, clause_id bigint, source_attachment_id bigint, canonical_authority_id string, business_category string, business_item string, action_type string, approver_role string, consulter_roles array<string>, amount_min bigint, amount_max bigint, currency string, condition_note string, footnote_refs array<string>, matrix_row_label string, matrix_col_label string, effective_date date, is_current boolean, order_seq int",
    "chunk": "chunk_id bigint, chunk_class string, board_id int, source_post_id bigint, clause_id bigint, source_attachment_id bigint, authority_id bigint, heading_path string, seq_in_source int, body string, tokenized string, canonical_clause_id string, clause_label string, page_no int, bbox string, posted_at timestamp, is_current boolean, char_len int, token_count int, content_hash string, dedup_group_id bigint, meta string, created_at timestamp",
    "glossary_synonym": "synonym_id bigint, headword string, synonyms array<string>, official_form string, colloquial_form string, register string, boost float, domain_category string, is_active boolean, notes string, updated_at timestamp",
    "ingest_state": "board_id int, last_art_no bigint, last_posted_at timestamp, cursor string, total_posts bigint, total_attachments bigint, status string, health string, heartbeat_at timestamp, last_run_at timestamp, last_success_at timestamp, consecutive_failures int, error_msg string",
    "eval_query": "eval_query_id bigint, query_text string, query_role string, answer_type string, should_abstain boolean, eval_set string, notes string, created_by string, created_at timestamp",
    "eval_gold": "eval_gold_id bigint, eval_query_id bigint, target_kind string, clause_id bigint, authority_id bigint, post_id bigint, expected_canonical_id string, relevance smallint, notes string",
    "query_log": "query_log_id bigint, query_text string, normalized_query string, user_role string, user_email_hash string, asked_at timestamp, result_count int, zero_result boolean, abstained boolean, validator_passed boolean, retrieval_strategy string, reranked boolean, returned_canonical_ids array<string>, answer_citation_ids array<string>, top_score float, latency_ms int, feedback string, feedback_note string, session_id string",
    "acl_audit": "acl_audit_id bigint, occurred_at timestamp, tool_name string, user_role string, user_email_hash string, identity_present boolean, decision string, requested_board_ids array<int>, allowed_board_ids array<int>, denied_board_ids array<int>, reason string, session_id string",
}
_TYPES = {"int": IntegerType(), "bigint": LongType(), "smallint": ShortType(), "string": StringType(), "boolean": BooleanType(), "timestamp": TimestampType(), "date": DateType(), "float": FloatType(), "array<string>": ArrayType(StringType()), "array<int>": ArrayType(IntegerType())}
#: Parsed here, as Spark's own parser needs a running session.
SCHEMAS = {name: StructType([StructField(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in ddl.split(", ")]) for name, ddl in DDL.items()}


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types; missing ones are null."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])


def one_of(column: str, *values: str) -> Column:
    return F.col(column).isNull() | F.col(column).isin(*values)


def exactly_one(*columns: str) -> Column:
    """One of the columns is set, and no other."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) == 1


def one_source(kind_column: str, of: dict[str, str]) -> Column:
    """The column that belongs to the row's kind is set, and the other kinds' columns are not."""
    rule = F.lit(False)
    for kind, column in of.items():
        others = [c for c in dict.fromkeys(of.values()) if c != column]
        clean = F.col(column).isNotNull()
        for c in others:
            clean &= F.col(c).isNull()
        rule |= (F.col(kind_column) == kind) & clean
    return rule


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break some, with their names in broken). A rule that is null is kept, as in SQL."""
    broken = F.filter(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def strict(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df; reading a row that breaks a rule raises."""
    for name, rule in rules.items():
        df = df.filter(F.when(rule | rule.isNull(), True).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean")))
    return df


def duplicates(df: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """Keys that occur more than once; keys with a null are never equal."""
    rows = df if where is None else df.filter(where)
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*keys).count().filter("count > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of child whose key is set and is not in parent."""
    p = parent.select(F.col(parent_key or key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(p, key, "left_anti")
