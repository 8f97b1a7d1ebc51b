"""Text, date, file and money functions over tables whose texts are made of numbers that SQL can work out again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import redaction, text
from ..operators import govern
from ..sources.files import OcrClient, extract
from .bindings import posts, query, read

_KOREAN = ("공지사항", "인사규정", "휴가", "출장 여비", "제1조")


def _pick(values, column):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


@query("SELECT doc_id, CAST(doc_id % 20 + 1 AS VARCHAR) || '-' || doc_id AS body FROM documents")
def compatibility_forms(spark, d):
    """Circled and full-width digits."""
    wide = F.translate(F.col("doc_id").cast("string"), "0123456789", "".join(map(chr, range(0xFF10, 0xFF1A))))
    return read(spark, d, "documents").select("doc_id", text.nfkc_udf(F.concat(_pick([chr(0x2460 + i) for i in range(20)], "doc_id"), F.lit("－"), wide)).alias("body"))


@query(f"SELECT doc_id, {list(_KOREAN)}[doc_id % 5 + 1] || ' ' || doc_id AS body, CAST([4, 4, 2, 4, 2][doc_id % 5 + 1] AS INTEGER) AS hangul FROM documents")
def wrong_encodings(spark, d):
    """Korean texts whose bytes were read as Latin-1."""
    wrong = [w.encode("euc-kr" if i % 2 else "utf-8").decode("latin-1") for i, w in enumerate(_KOREAN)]
    out = read(spark, d, "documents").select("doc_id", text.repair_encoding_udf(F.concat(_pick(wrong, "doc_id"), F.lit(" "), F.col("doc_id").cast("string"))).alias("body"))
    return out.withColumn("hangul", text.hangul_count_col(F.col("body")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '제목 ' || doc_id WHEN doc_id % 3 = 1 THEN '가(' || doc_id END AS title, CASE doc_id % 3 WHEN 0 THEN '본문 (1)' WHEN 1 THEN ') 본문' ELSE '본문 (' || doc_id || ')' END AS rest FROM documents")
def titles(spark, d):
    n = F.col("doc_id").cast("string")
    c = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("( 제목 "), n, F.lit(" )  본문 (1)"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("(가("), n, F.lit(")) 본문"))).otherwise(F.concat(F.lit("본문 ("), n, F.lit(")")))
    return read(spark, d, "documents").select("doc_id", text.title_of(c).alias("title"), text.after_title(c).alias("rest"))


@query("SELECT s_suppkey, list_filter([s_name, CAST(s_nationkey AS VARCHAR), 'x'], lambda r: r <> 'x')[1] || '|' || s_nationkey AS roles FROM supplier")
def roles(spark, d):
    c = F.concat(F.col("s_name"), F.lit(" / ,"), F.col("s_nationkey").cast("string"), F.lit(";· "))
    return read(spark, d, "supplier").select("s_suppkey", F.array_join(text.split_roles(c), "|").alias("roles"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '세칙' WHEN 1 THEN '지침' WHEN 2 THEN '전결규정' ELSE '규정' END AS kind FROM documents")
def regulation_types(spark, d):
    names = ["위임전결 지침 세칙", "전결 지침", "위임전결", "인사"]
    return read(spark, d, "documents").select("doc_id", text.reg_type(_pick(names, "doc_id")).alias("kind"))


@query("SELECT page_id, url AS absolute, 'https://wiki.example.com/v/' || page_id AS rooted, 'https://dl.example.com/files/' || page_id AS proxied, '' AS empty FROM pages")
def addresses(spark, d):
    n = F.col("page_id").cast("string")
    to = lambda c, base="https://wiki.example.com/": text.absolute_url(c, base)
    return read(spark, d, "pages").select("page_id", to(F.col("url")).alias("absolute"), to(F.concat(F.lit("/v/"), n)).alias("rooted"), to(F.concat(F.lit("files/"), n), "https://dl.example.com").alias("proxied"), to(F.lit("")).alias("empty"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS clause_day, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE date_trunc('day', o_orderdate) END AS list_day FROM orders")
def dates_in_texts(spark, d):
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 5
    clause = F.when(k == 4, "부칙 2023년 2월 30일").when(k % 2 == 0, F.concat(F.lit("부칙 "), f("yyyy"), F.lit("년 "), f("M"), F.lit("월 "), f("d"), F.lit("일부터 2030. 1. 1"))).otherwise(F.concat(f("yyyy"), F.lit(". "), f("M"), F.lit(". "), f("d"), F.lit(".")))
    listed = F.when(k == 4, "2023-13-01").otherwise(F.concat(f("yyyy"), F.when(k == 0, ".").when(k == 1, "/").otherwise("-"), f("M"), F.when(k == 0, ".").when(k == 1, "/").otherwise("-"), f("d")))
    return read(spark, d, "orders").select("o_orderkey", text.clause_date(clause).alias("clause_day"), text.list_date(listed).cast("timestamp_ntz").alias("list_day"))


@query("SELECT doc_id AS post_id, '[' || strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m') || '] ' || source AS shown, source AS undated FROM documents")
def rerank_candidates(spark, d):
    p = posts(spark, d)
    return p.select("post_id", govern.candidate_text(F.col("posted_at"), F.col("source")).alias("shown"), govern.candidate_text(F.lit(None).cast("timestamp"), F.col("source")).alias("undated"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 0 THEN sha256(text) END AS sha256, CASE WHEN strlen(text) <= 2000 THEN base64(encode(text)) END AS inline FROM documents")
def file_hashes(spark, d):
    """Bytes of a file: their hash, and, up to a size, their text form."""
    f = read(spark, d, "documents").select("doc_id", F.lit("f.bin").alias("file_name"), F.col("text").cast("binary").alias("content"))
    return extract(f).select("doc_id", "sha256", F.replace(redaction.inline_image(F.col("content"), 2000), F.lit("\r\n"), F.lit("")).alias("inline"))


def _lines_as_pages(path, body):
    import base64

    raw = base64.b64decode(body["document"]["document_url"].split(",")[1]).decode()
    return {"pages": [{"markdown": line} for line in raw.split("\n")]}


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10) || chr(10)) AS body, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_pages, 'ocr-shim' AS method FROM conversations WHERE text <> ''")
def recognised_pages(spark, d):
    """Texts as scans whose lines are the pages that recognition gives back."""
    c = read(spark, d, "conversations").filter("text <> ''").select("conv_id", "turn", F.lit("scan.png").alias("file_name"), F.col("text").cast("binary").alias("content"))
    e = F.col("extract")
    return extract(c, ocr=OcrClient(post=_lines_as_pages)).select("conv_id", "turn", e["text"].alias("body"), F.size(e["pages"]).alias("n_pages"), e["method"].alias("method"))


def _fails_on_long(content, name):
    if len(content) > 400:
        raise ValueError("too long")
    return content.decode(), "native"


@query("""WITH f AS (SELECT page_id, ['hwp', 'pdf', 'word', 'image', 'etc'][page_id % 5 + 1] AS kind, strlen(url) AS n, strlen(url) < 40 AS short, page_id % 7 = 0 AS blank FROM pages)
SELECT page_id, CASE WHEN blank THEN 'pending' WHEN kind = 'hwp' THEN CASE WHEN short THEN 'done' ELSE 'failed' END WHEN kind = 'pdf' THEN CASE WHEN short THEN 'done' ELSE 'pending' END ELSE 'pending' END AS status,
 CASE WHEN NOT blank AND kind IN ('hwp', 'pdf') AND short THEN CAST(n AS INTEGER) END AS length FROM f""")
def extraction_by_kind(spark, d):
    """Engines for two kinds that refuse long files: a sheet format that failed, a scan that waits, kinds that nothing reads."""
    p = read(spark, d, "pages")
    name = F.concat(F.lit("f."), _pick(["hwp", "pdf", "docx", "png", "zip"], "page_id"))
    long_ = F.concat(F.col("url"), F.repeat(F.lit("x"), F.lit(400)))
    content = F.when(F.col("page_id") % 7 == 0, "").when(F.octet_length("url") < 40, F.col("url")).otherwise(long_).cast("binary")
    e = F.col("extract")
    return extract(p.select("page_id", name.alias("file_name"), content.alias("content")), {"hwp": _fails_on_long, "pdf": _fails_on_long}).select("page_id", e["status"].alias("status"), F.length(e["text"]).alias("length"))


@query("SELECT user_id, event_id, CAST([event_id % 3, 2, 0] AS INTEGER[])::VARCHAR AS places FROM events WHERE event_id % 4 < 2 UNION ALL SELECT user_id, event_id, NULL FROM events WHERE event_id % 4 >= 2")
def reranker_replies(spark, d):
    """Orders in what a reranker answers: the whole, or the first list in it."""
    k, n = F.col("event_id") % 4, (F.col("event_id") % 3).cast("string")
    reply = F.when(k == 0, F.concat(F.lit("["), n, F.lit(",2, 0]"))).when(k == 1, F.concat(F.lit("order: ["), n, F.lit(", 2,0] then [9]"))).when(k == 2, "[1, x]").otherwise("none")
    return read(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("__k"), govern.parse_order(reply).alias("o")).select("user_id", "event_id", F.when(F.col("o").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("o", lambda x: x.cast("string")), ", "), F.lit("]"))).alias("places"))
