"""Access, citations, audit, source metadata: what stands between hits and their reader."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import email_hash, redact
from ..functions.text import absolute_url, strip
from ..schemas import SCHEMAS, conform


@dataclass(frozen=True)
class Identity:
    role: str | None = None
    email: str | None = None
    session: str | None = None

    @classmethod
    def from_headers(cls, headers: dict[str, str], role_key: str = "x-user-role", email_key: str = "x-user-email", session_key: str = "x-session-id") -> Identity:
        low = {k.lower(): (v or "").strip() for k, v in headers.items()}
        return cls(low.get(role_key) or None, low.get(email_key) or None, low.get(session_key) or None)

    @property
    def present(self) -> bool:
        return bool(self.role or self.email)


def identity_of(headers: Column, role_key: str = "x-user-role", email_key: str = "x-user-email", session_key: str = "x-session-id") -> Column:
    """Identity.from_headers of a map column: struct of role, email, session and present."""
    low = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.nullif(strip(e["value"]), F.lit("")).alias("value")))
    last = lambda k: F.get(F.reverse(F.filter(low, lambda e: e["key"] == k)), F.lit(0))["value"]
    role, email = last(role_key), last(email_key)
    return F.struct(role.alias("role"), email.alias("email"), last(session_key).alias("session"), (role.isNotNull() | email.isNotNull()).alias("present"))


def allowed_boards(boards: DataFrame) -> DataFrame:
    return boards.filter("included").select("board_id")


def split_request(requested: Column, allowed: Column) -> tuple[Column, Column]:
    """(effective, denied) of a list of boards, distinct, in order of the request; no list asks for all allowed."""
    wanted = F.array_distinct(requested)
    return F.when(requested.isNull(), allowed).otherwise(F.array_intersect(wanted, allowed)), F.when(requested.isNull(), F.array().cast("array<int>")).otherwise(F.array_except(wanted, allowed))


def gate(boards: DataFrame, identity: Identity, requested: list[int] | None) -> dict:
    """allowed (a DataFrame of board_id; empty without an identity), denied boards and the decision. Access is a join, before ranking and counting."""
    if not identity.present:
        return {"allowed": allowed_boards(boards).limit(0), "denied": list(dict.fromkeys(requested or [])), "decision": "identity_absent", "reason": "no_identity"}
    allowed = allowed_boards(boards)
    if requested is None:
        return {"allowed": allowed, "denied": [], "decision": "allow", "reason": None}
    wanted = list(dict.fromkeys(requested))
    mine = {r.board_id for r in allowed.filter(F.col("board_id").isin(wanted)).collect()} if wanted else set()
    denied = [b for b in wanted if b not in mine]
    return {"allowed": allowed.filter(F.col("board_id").isin(sorted(mine))) if mine else allowed.limit(0), "denied": denied, "decision": "filtered" if denied else "allow", "reason": "unknown_or_sensitive_board" if denied else None}


def only_allowed(df: DataFrame, allowed: DataFrame, column: str = "board_id") -> DataFrame:
    return df.join(allowed.select(F.col("board_id").alias(column)), column, "left_semi")


def canonical_id() -> Column:
    """The id of a hit: its clause's, its authority row's, or its post's."""
    return F.coalesce("canonical_clause_id", "canonical_authority_id", F.concat(F.lit("post#"), F.col("source_post_id").cast("string")))


def cite(hits: DataFrame) -> DataFrame:
    """One citation per hit: the clause, the authority, or the post; hits without an id have none."""
    kind = F.when((F.col("chunk_class") == "clause") & F.col("canonical_clause_id").isNotNull(), "clause").when((F.col("chunk_class") == "authority_cell") & F.col("canonical_authority_id").isNotNull(), "authority").when(F.col("source_post_id").isNotNull(), "post")
    cid = F.when(kind == "clause", F.col("canonical_clause_id")).when(kind == "authority", F.col("canonical_authority_id")).when(kind == "post", F.concat(F.lit("post#"), F.col("source_post_id").cast("string")))
    return hits.withColumn("citation_kind", kind).withColumn("citation_id", cid).filter("citation_id is not null").select("chunk_id", "citation_kind", "citation_id", "clause_label", "source_post_id")


def validate_citations(citations: DataFrame, clauses: DataFrame, authority: DataFrame, posts: DataFrame) -> DataFrame:
    """citations with validated: the clause or authority exists and is current, or the post exists."""
    # each table gives what is cited of it and no more; only that is made distinct
    cited = lambda kind: citations.filter(F.col("citation_kind") == kind).select(F.lit(kind).alias("citation_kind"), "citation_id").distinct()
    there = lambda df, column: df.select(F.col(column).alias("citation_id")).join(cited("clause" if column == "canonical_clause_id" else "authority"), "citation_id", "left_semi").distinct()
    numbers = cited("post").withColumn("post_id", F.split_part("citation_id", F.lit("#"), F.lit(2)).try_cast("long"))
    there_posts = posts.select("post_id").join(numbers.select("post_id"), "post_id", "left_semi").distinct().select(F.concat(F.lit("post#"), F.col("post_id").cast("string")).alias("citation_id"))
    known = (
        there(clauses.filter("is_current"), "canonical_clause_id").withColumn("citation_kind", F.lit("clause"))
        .unionByName(there(authority.filter("is_current"), "canonical_authority_id").withColumn("citation_kind", F.lit("authority")))
        .unionByName(there_posts.withColumn("citation_kind", F.lit("post")))
        .withColumn("validated", F.lit(True))
    )
    return citations.join(known, ["citation_kind", "citation_id"], "left").withColumn("validated", F.coalesce("validated", F.lit(False)))


def verify_citations(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations whose chunk is a hit that has the very id; others are dropped."""
    h = hits.select("chunk_id", F.col("canonical_clause_id").alias("__c"), F.col("canonical_authority_id").alias("__a"), F.col("source_post_id").alias("__p"))
    post = F.split_part("citation_id", F.lit("#"), F.lit(2)).try_cast("long")
    same = F.when(F.col("citation_kind") == "clause", F.col("citation_id") == F.col("__c")).when(F.col("citation_kind") == "authority", F.col("citation_id") == F.col("__a")).otherwise(post == F.col("__p"))
    return citations.join(h, "chunk_id").filter(same).drop("__c", "__a", "__p")


def abstain(hits: DataFrame, queries: DataFrame | None = None, below: float = 1e-6, key: str = "query_id") -> DataFrame:
    """Per query: n_hits, top_score, abstained, reason. With queries, those without any hit too."""
    t = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("top_score"))
    if queries is not None:
        t = queries.select(key).join(t, key, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    reason = F.when(F.col("n_hits") == 0, "empty_hits").when(F.col("top_score") < below, "below_abs_threshold")
    return t.withColumn("reason", reason).withColumn("abstained", reason.isNotNull())


def parse_order(reply: Column) -> Column:
    """array<int> of a reranker's reply: the whole as JSON, else the first bracketed list of numbers; null if neither."""
    whole = F.from_json(reply, "array<int>", {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(reply, r"\[[\s\d,]*\]", 0), "array<int>")
    return F.when(F.coalesce(F.size(F.filter(whole, lambda x: x.isNull())) == 0, F.lit(False)), whole).otherwise(F.when(F.coalesce(F.size(F.filter(inner, lambda x: x.isNull())) == 0, F.lit(False)), inner))


def candidate_text(posted: Column, body: Column) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("["), F.date_format(posted, "yyyy-MM"), F.lit("] ")), F.lit("")), body)


def permute(hits: DataFrame, order: DataFrame, key: str = "query_id", top_k: int = 8) -> DataFrame:
    """hits (key, position from 0) in the order (key, position, place) gives; repeats of a position count once, missing ones follow in their old order."""
    from pyspark.sql import Window

    first = order.groupBy(key, "position").agg(F.min("place").alias("place"))
    out = hits.join(first, [key, "position"], "left")
    w = Window.partitionBy(key).orderBy(F.col("place").asc_nulls_last(), "position")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).drop("place")


def rerank(hits: DataFrame, client=None, key: str = "query_id", query: str = "query_text", top_k: int = 8, candidates: int = 100) -> DataFrame:
    """Top hits per query in the order of client.rank(query, candidates) -> list of positions, with reranked and rerank_reason.

    A client sees so many candidates of a query at most, the first in position; they are one group in one task.

    Bodies are redacted before they reach the client. Without a client, or when it fails or answers with positions
    that are not there, the order stays and the reason says so. hits: key, query, position, posted_at, body.
    """
    shown = hits.filter(F.col("position") < max(candidates, top_k)).withColumn("__text", candidate_text(F.col("posted_at"), redact(F.col("body"))))

    def one(table: pa.Table) -> pa.Table:
        t = table.sort_by("position")
        n, reason, order = t.num_rows, "no_client", None
        if client is not None:
            try:
                got = [int(i) for i in client.rank(t[query][0].as_py(), t["__text"].to_pylist())]
                order, reason = (list(dict.fromkeys(got)), None) if all(0 <= i < n for i in got) else (None, "bad_index")
            except Exception as e:  # whatever the service does, the search goes on
                reason = type(e).__name__
        full = (order or []) + [i for i in range(n) if i not in set(order or [])]
        t = t.take(pa.array(full)).slice(0, top_k)
        m = t.num_rows
        return t.append_column("rank", pa.array(range(1, m + 1), pa.int32())).append_column("reranked", pa.array([order is not None] * m)).append_column("rerank_reason", pa.array([reason] * m, pa.string()))

    from pyspark.sql.types import StructType

    schema = StructType(list(shown.schema.fields)).add("rank", "integer").add("reranked", "boolean").add("rerank_reason", "string")
    return shown.groupBy(key).applyInArrow(one, schema).drop("__text")


def source_meta(hits: DataFrame, posts: DataFrame, boards: DataFrame, regulations: DataFrame, attachments: DataFrame, base_url: str, proxy_url: str | None = None) -> DataFrame:
    """hits with source: one tree of left joins instead of lookups per hit, over the rows of the hits' posts only. A regulation's title wins over its post's; attachments in order of id."""
    mine = hits.select(F.col("source_post_id").alias("post_id")).filter("post_id is not null").distinct()
    attachments, posts = (t.join(mine, "post_id", "left_semi") for t in (attachments, posts))
    regulations = regulations.join(mine.withColumnRenamed("post_id", "source_post_id"), "source_post_id", "left_semi")
    files = attachments.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("attachment_id", "file_name", "kind", absolute_url(F.col("download_url"), proxy_url or base_url).alias("download_url")))).alias("attachments"))
    regs = regulations.filter("is_current").groupBy(F.col("source_post_id").alias("post_id")).agg(F.min_by(F.struct("title", "reg_code", "effective_date"), "regulation_id").alias("reg"))
    p = posts.select("post_id", F.col("title").alias("__title"), "source_url").join(regs, "post_id", "left").join(files, "post_id", "left")
    h = hits.join(p, hits["source_post_id"] == p["post_id"], "left").join(boards.select("board_id", F.col("name").alias("__board")), "board_id", "left")
    none = F.array().cast("array<struct<attachment_id:bigint,file_name:string,kind:string,download_url:string>>")
    source = F.struct("board_id", F.col("__board").alias("board_name"), F.col("source_post_id").alias("post_id"), F.coalesce("reg.title", "__title").alias("title"), F.col("reg.reg_code").alias("reg_code"), F.col("reg.effective_date").alias("effective_date"), absolute_url(F.col("source_url"), base_url).alias("source_url"), F.coalesce("attachments", none).alias("attachments"))
    return h.withColumn("source", source).select(*hits.columns, "source")


def audit_row(spark, identity: Identity, tool: str, decision: str, now, requested=None, allowed=None, denied=None, reason=None) -> DataFrame:
    """One row of acl_audit; the address only as its hash."""
    row = [(now, tool, identity.role, identity.email, identity.present, decision, requested, allowed, denied, reason, identity.session)]
    df = spark.createDataFrame(row, "occurred_at timestamp, tool_name string, user_role string, email string, identity_present boolean, decision string, requested_board_ids array<int>, allowed_board_ids array<int>, denied_board_ids array<int>, reason string, session_id string")
    return conform(df.withColumn("user_email_hash", email_hash(F.col("email"))), "acl_audit")


def query_row(spark, identity: Identity, now, **values) -> DataFrame:
    """One row of query_log from the columns' values."""
    row = {f.name: values.get(f.name) for f in SCHEMAS["query_log"]} | {"user_role": identity.role, "user_email_hash": identity.email, "asked_at": now, "session_id": identity.session}
    return spark.createDataFrame([row], SCHEMAS["query_log"]).withColumn("user_email_hash", email_hash(F.col("user_email_hash")))
