"""Boards, pages, links, seeds and sheets, made of documents and customers."""

from __future__ import annotations

import io
import zipfile
from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ingest
from ..operators.clauses import parse_matrix
from ..operators.filters import is_image, is_text
from ..runtime import scratch, ship
from ..sources import files, pages
from ..streaming.incremental import upsert_stream
from .bindings import query, read


def list_pages(spark, d, numbers: int | None = None) -> DataFrame:
    """board_no, page, html: a list page per source, or per source and so many doc_ids; entries by falling number, with what such pages get wrong."""
    n = F.col("doc_id").cast("string")
    entry = F.to_json(F.struct(
        F.when(F.col("doc_id") % 50 == 49, "x").otherwise(n).alias("art_seq_no"), F.concat(F.lit(" 제목 "), n, F.lit(" ")).alias("art_title"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("mbr_nick"),
        F.when(F.col("doc_id") % 3 == 0, "1,2").otherwise(F.col("n_chars").cast("string")).alias("read_cnt"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy.MM.dd").alias("write_date"),
        F.when(F.col("doc_id") % 2 == 0, "Y").otherwise("y").alias("add_file_yn"), F.lit("N").alias("notice_yn"),
    ))
    rows = read(spark, d, "documents").withColumn("board_no", F.substring("source", 4, 9).cast("int"))
    rows = rows.withColumn("page", F.floor(F.col("doc_id") / numbers) + 1 if numbers else F.lit(1).cast("long"))
    listed = rows.groupBy("board_no", "page").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e"))))), lambda x: x["e"]), ", ").alias("rows"))
    return listed.select("board_no", "page", F.concat(F.lit("<html><script>\nvar exData = ["), F.replace("rows", F.lit("제목 7 "), F.lit("제목\\' 7 ")), F.lit(",];\n</script></html>")).alias("html"))


@query("""SELECT CAST(substr(source, 4) AS INTEGER) AS board_no, doc_id AS art_no, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS INTEGER) AS position, CASE WHEN doc_id % 10 = 7 AND doc_id < 10 THEN '제목'' 7' ELSE '제목 ' || doc_id END AS title,
 CASE WHEN doc_id % 4 <> 0 THEN lang END AS author, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(n_chars AS INTEGER) END AS view_count, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS TIMESTAMP) AS posted_at, doc_id % 2 = 0 AS has_file FROM documents QUALIFY doc_id % 50 <> 49""")
def list_rows(spark, d):
    return pages.list_rows(list_pages(spark, d)).select("board_no", "art_no", "position", "title", "author", "view_count", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "has_file")


@query("SELECT CAST(substr(source, 4) AS INTEGER) AS board_no, doc_id AS art_no, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 IN (1, 2) THEN 'inner ' || doc_id WHEN doc_id % 5 = 3 THEN '<IFRAME width=1 src = \"in\"></IFRAME>' || doc_id ELSE '<p>own' || doc_id || '</p>' END AS body FROM documents")
def two_hops(spark, d):
    """A view shows its own text, or the inner page of its frame, or itself where that is missing; some views are missing."""
    b = read(spark, d, "documents").select(F.substring("source", 4, 9).cast("int").alias("board_no"), F.col("doc_id").alias("art_no"))
    k, n = F.col("art_no") % 5, F.col("art_no").cast("string")
    views = b.filter(k < 4).withColumn("html", F.when(k == 0, F.concat(F.lit("<p>own"), n, F.lit("</p>"))).otherwise(F.concat(F.lit('<IFRAME width=1 src = "in"></IFRAME>'), n)))
    inner = b.filter(k.isin(0, 1, 2)).withColumn("html", F.concat(F.lit("inner "), n))
    return pages.post_bodies(b, views, inner).select("board_no", "art_no", F.col("body_html").alias("body"))


@query("""SELECT o_custkey AS art_no, 's' || o_orderkey || '.' || CASE o_orderkey % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'HWP' ELSE 'zip' END AS stored, CASE WHEN o_orderkey % 2 = 0 THEN '규정 ' || o_orderkey || '.pdf' ELSE 's' || o_orderkey || '.' || CASE o_orderkey % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'HWP' ELSE 'zip' END END AS file_name,
 CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' WHEN o_orderkey % 3 = 0 THEN 'excel' WHEN o_orderkey % 3 = 1 THEN 'hwp' ELSE 'etc' END AS kind FROM orders""")
def download_links(spark, d):
    """Each link twice, with entities and encoded names; the second, of another name, gives way to the first."""
    n = F.col("o_orderkey").cast("string")
    stored = F.concat(F.lit("s"), n, F.lit("."), F.element_at(F.array(F.lit("xlsx"), F.lit("HWP"), F.lit("zip")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("%EA%B7%9C%EC%A0%95%20"), n, F.lit(".pdf"))).otherwise("")
    link = lambda name: F.concat(F.lit('<a href="/downloadFile.do?boardNo=1&amp;fileNm='), stored, F.lit("&amp;fileRnm="), name, F.lit('">x</a>'))
    views = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("art_no")).agg(F.concat(F.array_join(F.collect_list(link(shown)), " "), F.array_join(F.collect_list(link(F.lit("other.png"))), "")).alias("view_html"))
    return pages.attachment_links(views.withColumn("board_no", F.lit(1))).select("art_no", "stored", "file_name", "kind")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' ELSE 'etc' END IN ('image') OR page_id % 4 = 0 AS image, page_id % 3 = 1 AND page_id % 4 <> 0 AS text FROM pages")
def attachment_classes(spark, d):
    p = read(spark, d, "pages").select("page_id", F.element_at(F.array(F.lit("image"), F.lit("pdf"), F.lit("etc")), (F.col("page_id") % 3 + 1).cast("int")).alias("kind"), (F.col("page_id") % 4 == 0).alias("is_table"))
    return p.select("page_id", is_image().alias("image"), is_text().alias("text"))


@query("SELECT * FROM (VALUES ('etc', 7::BIGINT, 0::BIGINT), ('form', 2, 0), ('manual', 6, 0), ('meeting', 1, 0), ('notice', 2, 0), ('regulation', 1, 1)) v(board_class, n, by_words)")
def board_seed(spark, d):
    """The fixed boards, seeded twice: numbers keep their ids."""
    once = ingest.seed_boards(ship(spark))
    twice = ingest.seed_boards(spark, boards=once).join(once.select("bizbox_board_no", "board_id"), ["bizbox_board_no", "board_id"])
    return twice.groupBy("board_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("use_mecab_parallel").alias("by_words"))


def workbook(rows: list[list[str]]) -> bytes:
    """A sheet of strings as xlsx."""
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def _workbooks(spark, d) -> DataFrame:
    """A matrix per region: a row per nation, some without an item, some with an action that there is not; and a file that is no sheet."""
    head = ["대분류", "업무항목", "결재구분", "금액기준", "전결권자", "합의", "비고"]
    grids: dict[int, list] = {}
    for r in read(spark, d, "nation").orderBy("n_nationkey").collect():
        k = r.n_nationkey
        row = [str(r.n_regionkey), "" if k % 7 == 6 else f" {r.n_name} ", "전결" if k % 5 else "승인", f"{k}만원 이하", f"R{k}", f"a{k} / b , " if k % 2 else "", ""]
        grids.setdefault(r.n_regionkey, [head, [""] * 7]).append(row)
    made = [(k, workbook(g)) for k, g in sorted(grids.items())] + [(99, b"no sheet")]
    return ship(spark).createDataFrame(made, "regulation_id long, content binary")


_CELLS = """c AS (SELECT n_regionkey::BIGINT AS regulation_id, n_nationkey AS k, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS order_seq FROM nation WHERE n_nationkey % 7 <> 6)"""


@query(f"WITH {_CELLS} SELECT regulation_id, order_seq, n_name AS business_item, CASE WHEN k % 2 = 1 THEN 'a' || k || '|b' ELSE '' END AS roles, CAST(NULL AS VARCHAR) AS error FROM c UNION ALL SELECT 99, NULL, NULL, NULL, 'BadZipFile'")
def sheet_cells(spark, d):
    return files.matrix_cells(_workbooks(spark, d)).select("regulation_id", "order_seq", "business_item", F.array_join("consulter_roles", "|").alias("roles"), "error")


@query(f"WITH {_CELLS} SELECT regulation_id, 'R' || regulation_id || '#auth' || order_seq AS id, CASE WHEN k % 5 <> 0 THEN k * 10000 END::BIGINT AS amount_max, 'R' || k AS approver_role, k % 5 = 0 AS refused FROM c")
def matrix_rows(spark, d):
    good, bad = parse_matrix(files.matrix_cells(_workbooks(spark, d)).filter("error is null").drop("error"))
    shown = lambda df, refused: df.select("regulation_id", F.col("canonical_authority_id").alias("id"), F.col("amount_max") if not refused else F.lit(None).cast("long").alias("amount_max"), "approver_role", F.lit(refused).alias("refused"))
    return shown(good, False).unionByName(shown(bad, True))


@query("""WITH c AS (SELECT n_regionkey::BIGINT AS regulation_id, n_nationkey AS k, n_regionkey || chr(9) || CASE WHEN n_nationkey % 7 = 6 THEN '' ELSE n_name END || chr(9) || CASE WHEN n_nationkey % 5 <> 0 THEN '전결' ELSE '승인' END || chr(9) || n_nationkey || '만원 이하' || chr(9) || 'R' || n_nationkey || CASE WHEN n_nationkey % 2 = 1 THEN chr(9) || 'a' || n_nationkey || ' / b ,' ELSE '' END AS line FROM nation)
SELECT regulation_id, '대분류' || chr(9) || '업무항목' || chr(9) || '결재구분' || chr(9) || '금액기준' || chr(9) || '전결권자' || chr(9) || '합의' || chr(9) || '비고' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS body FROM c GROUP BY regulation_id""")
def sheet_texts(spark, d):
    f = _workbooks(spark, d).filter("regulation_id < 99").withColumn("file_name", F.lit("m.xlsx"))
    return files.extract(f).select("regulation_id", F.col("extract.text").alias("body"))


#: Boards, and pages of each, that one folder of saved pages holds: what a fetcher has in memory does not grow with the tables.
_FOLDER = 64


def _saved_pages(e: DataFrame, root: str) -> None:
    """e: board_no, event_id. List pages of fifty entries, newest first, in folders that executors find by board and page."""
    entry = F.to_json(F.struct(F.col("event_id").cast("string").alias("art_seq_no"), F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")).alias("art_title"), F.lit("2024-01-01").alias("write_date")))
    place = Window.partitionBy("board_no").orderBy(F.desc("event_id"))
    rows = e.withColumn("page", F.floor((F.row_number().over(place) - 1) / 50) + 1).withColumn("e", entry)
    listed = rows.groupBy("board_no", "page").agg(F.reverse(F.array_sort(F.collect_list(F.struct("event_id", "e")))).alias("rows"))
    html = F.concat(F.lit("var exData=["), F.array_join(F.transform("rows", lambda x: x["e"]), ","), F.lit("];"))
    folder = [F.floor(F.col(c) / _FOLDER).alias(name) for c, name in (("board_no", "boards"), ("page", "pages"))]
    listed.select("board_no", "page", html.alias("html"), *folder).repartition("boards", "pages").write.partitionBy("boards", "pages").parquet(root)


class _EventPages:
    """Pages out of that table, a folder at a time."""

    def __init__(self, root: str):
        self.root, self.folder, self.held, self.files = root, None, {}, None

    def __getstate__(self):
        return {"root": self.root, "folder": None, "held": {}, "files": None}

    def list_page(self, board_no: int, page: int) -> str:
        folder = f"boards={board_no // _FOLDER}/pages={page // _FOLDER}"
        if folder != self.folder:
            self.held, self.folder = self._pages(folder), folder
        return self.held.get((board_no, page), "")

    def _pages(self, folder: str) -> dict[tuple[int, int], str]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if self.files is None:
            self.files = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        where, root = self.files
        held = {}
        for f in where.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)):
            if f.base_name.endswith(".parquet"):
                with where.open_input_file(f.path) as source:
                    t = pq.ParquetFile(source).read(["board_no", "page", "html"])
                held |= dict(zip(zip(t["board_no"].to_pylist(), t["page"].to_pylist()), t["html"].to_pylist()))
        return held


@query("SELECT CAST(user_id AS INTEGER) AS board_no, event_id AS art_no, CAST(event_id AS VARCHAR) AS title FROM events")
def board_stream(spark, d):
    """A stream over the boards of all users: tasks of twenty pages read them to the end; upserted, and read again without a change."""
    from ..streaming.incremental import latest

    root = scratch(ship(spark), "board-stream")
    _saved_pages(read(spark, d, "events").select(F.col("user_id").cast("int").alias("board_no"), "event_id"), f"{root}/pages")
    spark.dataSource.register(pages.board_source(_EventPages(f"{root}/pages"), "event_boards"))
    # the option that names the boards is a list of their numbers; in order, so that neighbours are in one folder
    boards = ",".join(str(r.board_no) for r in spark.read.parquet(f"{root}/pages").select("board_no").distinct().orderBy("board_no").collect())
    for _ in range(2):
        source = spark.readStream.format("event_boards").option("boards", boards).option("pages_per_task", 20).option("requests_at_once", 1).load()
        upsert_stream(source, f"{root}/t", ["board_no", "art_no"], "art_no", f"{root}/c", parts=4).start().awaitTermination()
    return latest(spark, f"{root}/t").select("board_no", "art_no", "title")


@query("SELECT CAST(substr(source, 4) AS INTEGER) AS board_no, CAST(count(*) * 2 AS BIGINT) AS entries, count(DISTINCT doc_id)::BIGINT AS numbers FROM documents GROUP BY source")
def board_full(spark, d):
    """Every entry of every board comes once; nothing comes where nothing is new; all come again where a board is read in full."""
    root = scratch(ship(spark), "board-full")
    docs = read(spark, d, "documents").select(F.substring("source", 4, 9).cast("int").alias("board_no"), F.col("doc_id").alias("event_id"))
    _saved_pages(docs, f"{root}/pages")
    spark.dataSource.register(pages.board_source(_EventPages(f"{root}/pages"), "document_boards"))
    boards = ",".join(str(r.board_no) for r in docs.select("board_no").distinct().orderBy("board_no").collect())
    for full in ("false", "false", "true"):
        source = spark.readStream.format("document_boards").option("boards", boards).option("requests_at_once", 1).option("full", full).load()
        source.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("board_no").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("art_no").alias("numbers"))
