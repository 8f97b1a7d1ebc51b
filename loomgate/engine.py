"""The eight operations over a set of tables, with access, redaction, citations, audit and a log of queries applied to each."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as stored
from .functions.redaction import inline_image, redact
from .functions.text import AGGREGATE_WORDS, AUTHORITY_WORDS, absolute_url, normalize_query
from .operators import analytics, govern
from .operators.filters import clamp, contains_escaped, is_image, is_text
from .operators.search import Searcher
from .operators.versions import clauses_at
from .runtime import ship


def question_intent(text: str) -> str:
    """authority, aggregate or search; the column form is functions.text.intent."""
    text = normalize_query(text)
    return "authority" if any(w in text for w in AUTHORITY_WORDS) else "aggregate" if any(w in text for w in AGGREGATE_WORDS) else "search"


@dataclass
class Engine:
    """root: the store that audit and query log are appended to; without it they stay in the lists."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    base_url: str = "https://wiki.example.com"
    proxy_url: str | None = None
    now: datetime | None = None
    index: DataFrame | None = None
    tokens: DataFrame | None = None
    words: DataFrame | None = None
    root: str | None = None
    audit: list = field(default_factory=list)
    queries: list = field(default_factory=list)
    audit_allow: bool = False

    @classmethod
    def load(cls, spark: SparkSession, root: str, **more) -> Engine:
        """Over a store: its tables as they are now, its postings, and its logs."""
        ship(spark)
        return cls(spark, stored.load(spark, root), index=stored.postings(spark, root), tokens=stored.tokens(spark, root), words=stored.words(spark, root), root=root, **more)

    def _now(self):
        return F.lit(self.now).cast("timestamp") if self.now else F.current_timestamp()

    def _record(self, tool: str, identity: govern.Identity, decision: str, requested=None, allowed=None, denied=None, reason=None) -> None:
        self.audit.append({"tool_name": tool, "decision": decision, "requested": requested, "denied": denied, "reason": reason})
        if self.root:
            stored.append(self.spark, self.root, "acl_audit", govern.audit_row(self.spark, identity, tool, decision, self.now or datetime.now(), requested, allowed, denied, reason))

    def _log(self, identity: govern.Identity, started: float, **values) -> None:
        values |= {"zero_result": not values["result_count"], "latency_ms": int((time.monotonic() - started) * 1000)}
        self.queries.append(values)
        if self.root:
            stored.append(self.spark, self.root, "query_log", govern.query_row(self.spark, identity, self.now or datetime.now(), **values))

    def _gate(self, tool: str, identity: govern.Identity, requested=None) -> dict:
        g = govern.gate(self.tables["board"], identity, requested)
        if g["decision"] != "allow" or self.audit_allow:
            allowed = None if g["decision"] == "identity_absent" else [r.board_id for r in govern.allowed_boards(self.tables["board"]).collect()]
            self._record(tool, identity, g["decision"], requested, allowed, g["denied"] or None, g["reason"])
        return g

    def _mine(self, tool: str, identity: govern.Identity, rows: DataFrame, allowed: DataFrame) -> DataFrame:
        """Rows of allowed boards; an object that exists elsewhere is refused, and that is audited."""
        mine = govern.only_allowed(rows, allowed)
        if identity.present and mine.isEmpty() and (r := rows.select("board_id").first()) is not None:
            self._record(tool, identity, "deny", None, None, [r.board_id], "board_not_allowed")
        return mine

    def _source(self, rows: DataFrame) -> DataFrame:
        """rows (source_post_id, board_id) with their source."""
        t = self.tables
        return govern.source_meta(rows, t["post"], t["board"], t["regulation"], t["attachment"], self.base_url, self.proxy_url)

    def search(self, identity, query: str, board_ids=None, as_of: date | None = None, only_current=True, limit=8, client=None, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits, one row of status)."""
        started = time.monotonic()
        g = self._gate("search_regulations", identity, board_ids)
        hits, report = self._ranked(query, g["allowed"] if g["decision"] != "identity_absent" else None, as_of, only_current, limit, client, top_k, absent=g["decision"] == "identity_absent")
        status = "abstained boolean, reason string, reranked boolean, top_score double, strategy string"
        if g["decision"] == "identity_absent":
            return self._shaped(hits.limit(0), report), self.spark.createDataFrame([(True, g["reason"], False, None, report["strategy"])], status)
        rows = self._shaped(hits, report)
        if report["reason"]:
            rows = rows.limit(0)
        log = rows.select("citation.canonical_id", "citation.validated").collect()
        cited = [r.canonical_id for r in log if r.canonical_id]
        self._log(identity, started, query_text=query, normalized_query=report["normalized"], result_count=len(log), abstained=bool(report["reason"]), validator_passed=all(r.validated for r in log if r.canonical_id) if cited else None, retrieval_strategy=report["strategy"], reranked=report["reranked"], returned_canonical_ids=[c for c in cited if not c.startswith("post#")], answer_citation_ids=cited, top_score=report["top_score"])
        return rows, self.spark.createDataFrame([(bool(report["reason"]), report["reason"], report["reranked"], report["top_score"], report["strategy"])], status)

    def _ranked(self, query, allowed, as_of=None, only_current=True, limit=30, client=None, top_k=None, board_ids=None, do_rerank=True, absent=False) -> tuple[DataFrame, dict]:
        """(hits in their final order, report with reason and reranked)."""
        chunks = self.tables["chunk"] if allowed is None else govern.only_allowed(self.tables["chunk"], allowed)
        chunks = chunks.limit(0) if absent else chunks
        s = Searcher(chunks, self.tables["authority_matrix"], self.tables["glossary_synonym"], self.index, self.tokens, self.words)
        hits, report = s.search(query, now=self._now(), board_ids=board_ids, only_current=only_current, as_of=as_of, limit=limit)
        report = {"normalized": normalize_query(query), "n": 0, "top_score": None, "reranked": False} | report
        if report["strategy"] == "empty":
            hits = hits.withColumns({"raw_score": F.lit(None).cast("double"), "match_kind": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
        from pyspark.sql import Window

        # the few hits of one search; their order is their position
        by = Window.partitionBy("query_id").orderBy((F.col("match_kind") == "exact").desc(), F.desc("score"), "chunk_id")
        placed = hits.withColumn("query_id", F.lit(0)).withColumn("query_text", F.lit(query)).withColumn("position", F.row_number().over(by) - 1)
        report["reason"] = "empty_hits" if not report["n"] else "below_abs_threshold" if report["top_score"] < 1e-6 else None
        if not do_rerank:
            return placed.withColumn("rank", F.col("position") + 1).withColumn("reranked", F.lit(False)), report
        ranked = govern.rerank(placed, client, top_k=top_k or max(limit, 8))
        if client is not None and report["n"]:
            rows = ranked.collect()  # limit of them at most: the client is asked once
            ranked = self.spark.createDataFrame(rows, ranked.schema)
            report["reranked"] = any(r.reranked for r in rows)
        return ranked, report

    def _cited(self, hits: DataFrame) -> DataFrame:
        return govern.verify_citations(govern.validate_citations(govern.cite(hits), self.tables["clause"], self.tables["authority_matrix"], self.tables["post"]), hits)

    def _shaped(self, hits: DataFrame, report: dict) -> DataFrame:
        cites = self._cited(hits).select("chunk_id", F.struct(F.col("citation_kind").alias("kind"), F.col("citation_id").alias("canonical_id"), F.col("clause_label").alias("label"), "validated").alias("citation"))
        out = self._source(hits.join(cites, "chunk_id", "left"))
        return out.select("rank", "chunk_id", "chunk_class", redact(F.col("body")).alias("snippet"), "score", "raw_score", "match_kind", F.lit(report["strategy"]).alias("strategy"), "citation", "source").orderBy("rank")

    def route(self, query: str, board_ids: list[int] | None = None, client=None, do_rerank: bool = True) -> dict:
        """A question to what answers it: intent, then rows of an aggregate, or hits, citations and whether to abstain.

        No access check of its own: board_ids is the caller's. kind is that of analytics.dispatch, or search.
        """
        intent = question_intent(query)
        if intent != "search":
            kind, rows = analytics.dispatch(query, self.tables["authority_matrix"], self.tables["regulation"], board_ids)
            return {"intent": intent, "kind": kind, "rows": rows, "citations": None, "abstained": None, "reason": None, "strategy": None}
        hits, report = self._ranked(query, None, client=client, top_k=8, board_ids=board_ids, do_rerank=do_rerank)
        answer = {"intent": intent, "kind": "search", "rows": hits.orderBy("rank"), "abstained": bool(report["reason"]), "reason": report["reason"], "strategy": report["strategy"], "reranked": report["reranked"]}
        return answer | {"citations": None if report["reason"] else govern.validate_citations(govern.cite(hits), self.tables["clause"], self.tables["authority_matrix"], self.tables["post"])}

    def get_regulation(self, identity, regulation_id: int, as_of: date | None = None) -> DataFrame:
        """With as_of the clauses as they were on that day, past versions too."""
        g = self._gate("get_regulation", identity)
        t = self.tables
        reg = self._mine("get_regulation", identity, t["regulation"].filter(F.col("regulation_id") == regulation_id), g["allowed"])
        c = t["clause"].filter(F.col("regulation_id") == regulation_id)
        c = c.filter("is_current") if as_of is None else clauses_at(c, F.lit(as_of))
        clauses = c.groupBy("regulation_id").agg(F.array_sort(F.collect_list(F.struct("order_seq", "canonical_clause_id", "clause_label", "clause_title", redact(F.col("text")).alias("text")))).alias("c"))
        shaped = F.transform(F.coalesce("c", F.array().cast("array<struct<order_seq:int,canonical_clause_id:string,clause_label:string,clause_title:string,text:string>>")), lambda x: x.dropFields("order_seq"))
        shown = self._source(reg.join(clauses, "regulation_id", "left"))
        return shown.select("regulation_id", "title", "reg_type", "effective_date", "revision_no", "source", shaped.alias("clauses"))

    def get_attachment(self, identity, attachment_id: int, page_no: int | None = None, contents: DataFrame | None = None) -> DataFrame:
        """mode text, image (only of a curated regulation, with its bytes in contents, small enough) or link."""
        g = self._gate("get_attachment", identity)
        t = self.tables
        a = t["attachment"].filter(F.col("attachment_id") == attachment_id).join(t["post"].select("post_id", "board_id"), "post_id")
        a = self._mine("get_attachment", identity, a, g["allowed"])
        curated = t["regulation"].filter("curated").select(F.col("source_post_id").alias("post_id")).distinct().withColumn("curated", F.lit(True))
        pages = t["attachment_page"].filter(F.lit(page_no is None) | (F.col("page_no") == page_no))
        text = pages.groupBy("attachment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "ocr_text"))), lambda x: x["ocr_text"]), "\n\n").alias("ocr"))
        a = a.join(curated, "post_id", "left").join(text, "attachment_id", "left")
        a = a.join(contents.select("attachment_id", "content"), "attachment_id", "left") if contents is not None else a.withColumn("content", F.lit(None).cast("binary"))
        image = F.when(is_image() & F.coalesce("curated", F.lit(False)), inline_image(F.col("content")))
        body = F.when(is_text(), F.when(F.lit(page_no is not None), F.col("ocr")).otherwise(F.coalesce("extracted_text", "ocr")))
        a = self._source(a.withColumn("source_post_id", F.col("post_id")).drop("post_id"))
        mode = F.when(image.isNotNull(), "image").when(body.isNotNull(), "text").otherwise("link")
        return a.select(mode.alias("mode"), "file_name", "mime_type", absolute_url(F.col("download_url"), self.proxy_url or self.base_url).alias("download_url"), redact(body).alias("text"), F.lit(page_no).cast("int").alias("page_no"), image.alias("image_base64"), (is_image() & image.isNull()).alias("unverified_image"), F.when(is_image(), redact(F.col("ocr"))).alias("ocr_text"), "source")

    def list_boards(self, identity, board_class: str | None = None) -> DataFrame:
        g = self._gate("list_boards", identity)
        b = govern.only_allowed(self.tables["board"], g["allowed"])
        b = b if board_class is None else b.filter(F.col("board_class") == board_class)
        return b.select("board_id", "name", "slug", "board_class").orderBy("board_id")

    def recent_posts(self, identity, board: str | None = None, limit: int = 10) -> DataFrame:
        g = self._gate("list_recent_posts", identity)
        b = govern.only_allowed(self.tables["board"], g["allowed"]).select("board_id", F.col("name").alias("board_name"))
        b = b if not board else b.filter(contains_escaped("board_name", board))
        p = self.tables["post"].filter("is_current").join(b, "board_id")
        p = p.orderBy(F.col("posted_at").desc_nulls_last(), F.desc("post_id")).limit(clamp(limit))
        return p.select("post_id", redact(F.col("title")).alias("title"), "board_name", F.to_date("posted_at").alias("posted_at"), absolute_url(F.col("source_url"), self.base_url).alias("source_url"))

    def approval_authority(self, identity, query: str, amount: int | None = None, board_ids=None) -> DataFrame:
        """What analytics.dispatch gives for the question, with the amount, if given, appended to it."""
        started = time.monotonic()
        g = self._gate("get_approval_authority", identity, board_ids)
        question = query if amount is None else f"{query} {amount}원"
        regs = govern.only_allowed(self.tables["regulation"], g["allowed"])
        mine = self.tables["authority_matrix"].join(regs.select("regulation_id"), "regulation_id", "left_semi")
        kind, rows = analytics.dispatch(question, mine, regs)
        approver = F.when(F.lit(kind != "board_count"), F.col("value"))
        out = rows.select(F.col("label").alias("business_item"), approver.alias("approver_role"), "action_type", "consulter_roles", "amount_min", "amount_max", redact(F.col("condition_note")).alias("condition_note"), F.col("canonical_authority_id").alias("citation"), F.lit(kind).alias("kind"))
        if identity.present:
            ids = [r.citation for r in out.select("citation").collect()]
            cited = [c for c in ids if c]
            self._log(identity, started, query_text=query, normalized_query=question, result_count=len(ids), abstained=False, validator_passed=None, retrieval_strategy=kind, reranked=False, returned_canonical_ids=cited, answer_citation_ids=cited, top_score=None)
        return out

    def compare_boards(self, identity, query: str = AGGREGATE_WORDS[4], board_ids=None) -> DataFrame:
        """Regulations of each board. A question that asks for no count gets the word for it; one with an amount is one for approvals, of which only numbered items are boards."""
        g = self._gate("aggregate_compare", identity, board_ids)
        regs = govern.only_allowed(self.tables["regulation"], g["allowed"])
        mine = self.tables["authority_matrix"].join(regs.select("regulation_id"), "regulation_id", "left_semi")
        kind, rows = analytics.dispatch(query if question_intent(query) == "aggregate" else f"{query} {AGGREGATE_WORDS[4]}", mine, regs)
        rows = rows.filter(F.col("label").rlike("^[0-9]+$")).select(F.col("label").try_cast("int").alias("board_id"), "label", "value")
        named = rows.join(self.tables["board"].select("board_id", "name"), "board_id", "left")
        count = F.when(F.lit(kind == "board_count"), F.col("value").try_cast("bigint"))
        return named.select("board_id", F.coalesce("name", "label").alias("label"), count.alias("value")).orderBy("board_id")

    def regulation_diff(self, identity, regulation_id: int | None = None, from_id: int | None = None, to_id: int | None = None, key: str = "relative") -> DataFrame:
        """Between two regulations, or a regulation and the one it supersedes; without a predecessor everything is added and is_initial."""
        g = self._gate("get_regulation_diff", identity)
        regs = self.tables["regulation"]
        to_id = to_id if to_id is not None else regulation_id
        if from_id is None:
            r = regs.filter(F.col("regulation_id") == to_id).select("supersedes_regulation_id").first()
            from_id = r.supersedes_regulation_id if r else None
        both = regs.filter(F.col("regulation_id").isin([i for i in (from_id, to_id) if i is not None])).select("regulation_id", "board_id")
        closed = [r.board_id for r in both.join(g["allowed"], "board_id", "left_anti").select("board_id").distinct().collect()]
        if closed and identity.present:
            self._record("get_regulation_diff", identity, "deny", None, None, sorted(closed), "board_not_allowed")
        # both have to be open to the reader, and the new one has to exist
        ok = identity.present and not closed and not both.filter(F.col("regulation_id") == to_id).isEmpty()
        side = lambda i: self.tables["clause"].filter((F.col("regulation_id") == i) & F.lit(ok))
        d = analytics.clause_diff(side(from_id) if from_id is not None else self.tables["clause"].limit(0), side(to_id), key)
        return d.select("change", F.col("key").alias("canonical_clause_id"), "clause_label", redact(F.col("before")).alias("before"), redact(F.col("after")).alias("after"), F.lit(from_id is None).alias("is_initial"))
