"""The engine's operations, the router and the evaluation over documents as posts, regulations and chunks, parts as approvals."""

from __future__ import annotations

from datetime import datetime


from pyspark.sql import functions as F

from .. import jobs
from ..engine import Engine
from ..operators import govern, search
from ..operators.search import Searcher
from ..runtime import ship
from ..schemas import conform, empty
from .bindings import _RECENT, _W, VIEWS, _now, corpus, posts, query, read

WHO = govern.Identity(role="reader")
#: Objects that are there at every size.
ONE, OTHER, HIDDEN = 5, 7, 0


def engine(spark, d) -> Engine:
    """Boards are sources (the first one is closed), every document is a post, a regulation of one clause a line, and a chunk; parts are approvals, pages attachments."""
    ship(spark)
    p = posts(spark, d)
    n = F.col("post_id").cast("string")
    board = p.select("board_id", F.col("source").alias("name"), (F.col("board_id") != 0).alias("included"), F.when(F.col("board_id") % 2 == 0, "regulation").otherwise("notice").alias("board_class")).distinct()
    post = p.withColumn("title", F.concat(F.lit("T"), n)).withColumn("source_url", F.concat(F.lit("/v/"), n))
    regulation = p.select(F.col("post_id").alias("regulation_id"), F.col("post_id").alias("source_post_id"), "board_id", F.concat(F.lit("R"), n).alias("title"), F.lit("규정").alias("reg_type"), F.lit(True).alias("is_current"), (F.col("post_id") % 2 == 1).alias("curated"), F.when(F.col("post_id") == ONE, OTHER).cast("long").alias("supersedes_regulation_id"))
    lines = p.select("post_id", F.posexplode(F.split("body_text", "\n")).alias("order_seq", "text"))
    at = F.col("order_seq").cast("string")
    clause = lines.select((F.col("post_id") * 100_000 + F.col("order_seq")).alias("clause_id"), F.col("post_id").alias("regulation_id"), F.concat(F.lit("R"), n, F.lit("#a"), at).alias("canonical_clause_id"), F.concat(F.lit("제"), at, F.lit("조")).alias("clause_label"), "text", "order_seq", F.lit(True).alias("is_current"))
    part = read(spark, d, "part")
    key = F.col("p_partkey")
    small = key % 3 == 0
    authority = part.select(key.alias("authority_id"), F.lit(ONE).alias("regulation_id"), F.lower("p_name").alias("business_item"), F.lit("전결").alias("action_type"), F.col("p_brand").alias("approver_role"), F.when(small, 0).otherwise(10**6).cast("long").alias("amount_min"), F.concat(F.lit("A"), key.cast("string")).alias("canonical_authority_id"), F.concat(F.lit("문의 x"), key.cast("string"), F.lit("@y.kr")).alias("condition_note"), F.col("p_size").alias("order_seq"), F.lit(True).alias("is_current"))
    page = F.col("page_id")
    attachment = read(spark, d, "pages").select(page.alias("attachment_id"), (page % 20).alias("post_id"), F.concat(F.lit("f"), page.cast("string")).alias("file_name"), F.when(page % 3 == 0, "image").otherwise("pdf").alias("kind"), F.lit(False).alias("is_table"), F.concat(F.lit("/f/"), page.cast("string")).alias("download_url"), F.concat(F.lit("a@b.kr "), "url").alias("extracted_text"))
    t = {"board": board, "post": post, "regulation": regulation, "clause": clause, "authority_matrix": authority, "attachment": attachment, "chunk": corpus(spark, d).withColumn("canonical_clause_id", F.lit(None).cast("string"))}
    whole = {name: conform(t[name], name) if name in t else empty(spark, name) for name in ("board", "post", "regulation", "clause", "authority_matrix", "attachment", "attachment_page", "chunk", "glossary_synonym", "ingest_state", "eval_query", "eval_gold")}
    return Engine(spark, whole, now=datetime(2025, 1, 1))


_SCORED = f"""{VIEWS}, c AS (SELECT *, lower(trim(regexp_replace(body_text, '\\s+', ' ', 'g'), ' ')) AS b FROM post WHERE is_current),
s AS (SELECT post_id, board_id, (((length(b) - length(replace(b, 'thnd', ''))) // 4 + (length(b) - length(replace(b, 'the', ''))) // 3)::DOUBLE) * {_RECENT} AS score FROM c WHERE contains(b, 'thnd') AND contains(b, 'the') AND {{more}}),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, post_id) AS INTEGER) AS rank FROM s)"""


@query(_SCORED.format(more="board_id <> 0") + " SELECT rank, post_id, 'R' || post_id AS title, 'src' || board_id AS board_name, 'post#' || post_id AS canonical_id, true AS validated, round(score, 9) AS score, 'ngram' AS strategy, 'https://wiki.example.com/v/' || post_id AS url FROM r WHERE rank <= 8")
def api_search(spark, d):
    hits, _ = engine(spark, d).search(WHO, "thnd the")
    return hits.select("rank", F.col("source.post_id").alias("post_id"), F.col("source.title").alias("title"), F.col("source.board_name").alias("board_name"), "citation.canonical_id", "citation.validated", F.round("score", 9).alias("score"), "strategy", F.col("source.source_url").alias("url"))


@query("SELECT * FROM (VALUES ('zzqx', true, 'empty_hits', 'ngram'), ('closed', true, 'empty_hits', 'ngram'), ('absent', true, 'no_identity', 'ngram'), ('blank', true, 'empty_hits', 'empty')) v(asked, abstained, reason, strategy)")
def api_abstains(spark, d):
    e = engine(spark, d)
    asked = {"zzqx": (WHO, "zzqx", None), "closed": (WHO, "thnd", [HIDDEN]), "absent": (govern.Identity(), "thnd", None), "blank": (WHO, "  ", None)}
    out = [e.search(who, q, board_ids=b)[1].select(F.lit(k).alias("asked"), "abstained", "reason", "strategy") for k, (who, q, b) in asked.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _masked(c: str) -> str:
    mail = rf"regexp_replace({c}, '[{_W}.+-]+@[{_W}-]+\.[{_W}.-]+', '[이메일]', 'g')"
    card = rf"regexp_replace({mail}, '\b\d{{4}}[- ]?\d{{4}}[- ]?\d{{4}}[- ]?\d{{4}}\b', '[카드]', 'g')"
    return rf"regexp_replace({card}, '\b0\d{{1,2}}-?\d{{3,4}}-?\d{{4}}\b', '[전화]', 'g')"


@query(f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE doc_id = {ONE})
SELECT 'R' || doc_id AS title, source AS board_name, 'R' || doc_id || '#a' || k AS id, '제' || k || '조' AS label, {_masked('line')} AS body FROM l""")
def api_regulation(spark, d):
    e = engine(spark, d)
    both = e.get_regulation(WHO, ONE).unionByName(e.get_regulation(WHO, HIDDEN)).unionByName(e.get_regulation(WHO, -1))
    return both.select("title", F.col("source.board_name").alias("board_name"), F.explode("clauses").alias("c")).select("title", "board_name", F.col("c.canonical_clause_id").alias("id"), F.col("c.clause_label").alias("label"), F.col("c.text").alias("body"))


@query("""SELECT 'f' || page_id AS file_name, CASE WHEN page_id = 9 THEN 'image' WHEN page_id = 6 THEN 'link' ELSE 'text' END AS mode, 'https://wiki.example.com/f/' || page_id AS url, CASE WHEN page_id % 3 <> 0 THEN '[이메일] ' || url END AS body, CASE WHEN page_id = 9 THEN base64(encode('png')) END AS image, page_id = 6 AS unverified, page_id % 20 AS post_id
FROM pages WHERE page_id IN (6, 7, 9)""")
def api_attachment(spark, d):
    """A text, an image of a curated regulation, an image of another; and one of a closed board, which nobody gets."""
    e = engine(spark, d)
    contents = spark.createDataFrame([(6, b"png"), (9, b"png")], "attachment_id long, content binary")
    out = [e.get_attachment(WHO, i, contents=contents) for i in (6, 7, 9, 20)]
    whole = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return whole.select("file_name", "mode", F.col("download_url").alias("url"), F.col("text").alias("body"), F.col("image_base64").alias("image"), F.col("unverified_image").alias("unverified"), F.col("source.post_id").alias("post_id"))


@query(f"{VIEWS} SELECT board_id, name, CASE WHEN board_id % 2 = 0 THEN 'regulation' ELSE 'notice' END AS board_class FROM board WHERE included AND board_id % 2 = 0")
def api_boards(spark, d):
    return engine(spark, d).list_boards(WHO, "regulation").select("board_id", "name", "board_class")


@query(f"{VIEWS} SELECT post_id, 'T' || post_id AS title, source AS board_name, CAST(posted_at AS DATE) AS posted_at, 'https://wiki.example.com/v/' || post_id AS source_url FROM post WHERE is_current AND board_id <> 0 AND contains(source, 'src1') ORDER BY post.posted_at DESC, post_id DESC LIMIT 30")
def api_recent(spark, d):
    return engine(spark, d).recent_posts(WHO, "SRC1", 99)


_APPROVALS = """SELECT '{kind}' AS kind, lower(p_name) AS business_item, p_brand AS approver_role, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1000000 END::BIGINT AS amount_min, '문의 [이메일]' AS condition_note, 'A' || p_partkey AS citation FROM part WHERE {where}"""


@query(" UNION ALL ".join([_APPROVALS.format(kind="approver", where="contains(lower(p_name), 'red')"), _APPROVALS.format(kind="approval_line", where="p_partkey % 3 = 0"), "SELECT 'board_count', CAST(CAST(substr(source, 4) AS INTEGER) AS VARCHAR), NULL, NULL, NULL, NULL FROM documents WHERE source <> 'src0' GROUP BY source"]))
def api_approval(spark, d):
    """By item, by an amount given apart, and a question that counts."""
    e = engine(spark, d)
    out = e.approval_authority(WHO, "red 전결권자").unionByName(e.approval_authority(WHO, "red", amount=30_000)).unionByName(e.approval_authority(WHO, "규정 개수"))
    return out.select("kind", "business_item", "approver_role", "amount_min", "condition_note", "citation")


@query("SELECT CAST(substr(source, 4) AS INTEGER) AS board_id, source AS label, count(*)::BIGINT AS value FROM documents WHERE source IN ('src2', 'src3') GROUP BY source")
def api_compare(spark, d):
    e = engine(spark, d)
    return e.compare_boards(WHO, "규정", [3, 2, HIDDEN, 99]).unionByName(e.compare_boards(WHO, "30000원"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE doc_id IN ({ONE}, {OTHER})),
a AS (SELECT * FROM l WHERE doc_id = {OTHER}), b AS (SELECT * FROM l WHERE doc_id = {ONE})
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, 'a' || coalesce(a.k, b.k) AS id, {_masked('a.line')} AS before, {_masked('b.line')} AS after, false AS is_initial
FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL OR trim(regexp_replace(a.line, '\\s+', ' ', 'g'), ' ') <> trim(regexp_replace(b.line, '\\s+', ' ', 'g'), ' ')""")
def api_diff(spark, d):
    """A regulation and the one that it superseded; with a closed one there is no answer."""
    e = engine(spark, d)
    out = e.regulation_diff(WHO, ONE).unionByName(e.regulation_diff(WHO, from_id=HIDDEN, to_id=ONE))
    return out.select("change", F.col("canonical_clause_id").alias("id"), "before", "after", "is_initial")


@query(_SCORED.format(more="board_id IN (0, 1, 2)") + " SELECT 'search' AS intent, rank, post_id, 'post#' || post_id AS canonical_id, true AS validated FROM r WHERE rank <= 8")
def route_search(spark, d):
    """Reranked by nobody, the first eight; cited and validated."""
    a = engine(spark, d).route("thnd the", board_ids=[0, 1, 2])
    cites = a["citations"].select("chunk_id", F.col("citation_id").alias("canonical_id"), "validated")
    return a["rows"].join(cites, "chunk_id").select(F.lit(a["intent"]).alias("intent"), "rank", F.col("source_post_id").alias("post_id"), "canonical_id", "validated")


@query("SELECT 'authority' AS intent, 'approval_line' AS kind, lower(p_name) AS label, p_brand AS value FROM part UNION ALL SELECT 'authority', 'approver', lower(p_name), p_brand FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget')")
def route_authority(spark, d):
    e = engine(spark, d)
    shown = lambda a: a["rows"].select(F.lit(a["intent"]).alias("intent"), F.lit(a["kind"]).alias("kind"), "label", "value")
    return shown(e.route("1억5천만원 전결")).unionByName(shown(e.route("Red 결재라인 widget", board_ids=[ONE % 20, 5])))


@query("SELECT 'aggregate' AS intent, 'board_count' AS kind, CAST(CAST(substr(source, 4) AS INTEGER) AS VARCHAR) AS label, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY source")
def route_aggregate(spark, d):
    a = engine(spark, d).route("게시판별 규정 목록")
    return a["rows"].select(F.lit(a["intent"]).alias("intent"), F.lit(a["kind"]).alias("kind"), "label", "value")


@query("SELECT * FROM (VALUES ('doc7조', 'exact_clause', 1::BIGINT), ('thnd zzqx', 'or_fallback', 5), ('kur', 'synonym_expanded', 5), ('thnd', 'ngram', 5), (' ', 'empty', 0)) v(asked, strategy, n)")
def search_strategies(spark, d):
    s = Searcher(corpus(spark, d), glossary=spark.createDataFrame([("Kur", ["keit", "heit"])], "headword string, synonyms array<string>"))
    rows = []
    for q in ("doc7조", "thnd zzqx", "kur", "thnd", " "):
        hits, report = s.search(q, now=_now(), limit=5)
        rows.append((q, report["strategy"], hits.count()))
    return spark.createDataFrame(rows, "asked string, strategy string, n long")


@query(f"{VIEWS} SELECT post_id AS chunk_id, post_id % 3 = 0 AS by_words, CASE WHEN post_id % 2 = 0 THEN 'A' || post_id END AS authority FROM post WHERE is_current AND (post_id % 3 = 0 OR contains(lower(body_text), 'keit'))")
def search_words_and_authority(spark, d):
    """Hits by a column of split words where bodies have no such substring, and the approval that a chunk stands for; through postings as without."""
    c = corpus(spark, d).withColumn("tokenized", F.when(F.col("chunk_id") % 3 == 0, "zz KEIT yy")).withColumn("authority_id", F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id")))
    a = c.select(F.col("chunk_id").alias("authority_id"), F.concat(F.lit("A"), F.col("chunk_id").cast("string")).alias("canonical_authority_id"))
    s = Searcher(c, a)
    found = s.full_text([["keit"]], s._base(None, True, None, False))
    with_index = Searcher(c, a, index=search.postings(c))
    same = with_index.full_text([["keit"]], with_index._base(None, True, None, False)).select("chunk_id")
    return found.join(same, "chunk_id", "left_semi").select("chunk_id", (F.col("tokenized").isNotNull()).alias("by_words"), F.col("canonical_authority_id").alias("authority"))


class _Backwards:
    def rank(self, question, candidates):
        if question == "3":
            raise TimeoutError
        return [99] if question == "4" else [len(candidates) - 1, len(candidates) - 1]


@query("""WITH p AS (SELECT o_custkey AS q, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
r AS (SELECT *, q % 5 NOT IN (3, 4) AS reranked, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN q % 5 NOT IN (3, 4) AND position = n - 1 THEN 0 ELSE 1 END, position) AS rank FROM p)
SELECT q, o_orderkey, CAST(rank AS INTEGER) AS rank, reranked, CASE q % 5 WHEN 3 THEN 'TimeoutError' WHEN 4 THEN 'bad_index' END AS reason FROM r WHERE rank <= 4""")
def rerank_by_client(spark, d):
    """A client that puts the last one first, fails for some questions and answers nonsense to others."""
    from pyspark.sql import Window

    w = Window.partitionBy("q").orderBy("o_orderkey")
    h = read(spark, d, "orders").withColumn("q", F.col("o_custkey")).withColumn("position", F.row_number().over(w) - 1)
    h = h.select("q", (F.col("q") % 5).cast("string").alias("query_text"), "position", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("posted_at"), F.col("o_orderpriority").alias("body"))
    return govern.rerank(h, _Backwards(), key="q", top_k=4).select("q", "o_orderkey", "rank", "reranked", F.col("rerank_reason").alias("reason"))
