"""Board pages: list rows, posts over two hops, attachment links, and a streaming source of lists."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.text import file_kind, list_date, strip

#: Pages of one task of a stream.
PAGES_PER_TASK = 20
#: Fields of a list row, as the page's script has them.
ROW = "art_seq_no string, art_title string, mbr_nick string, read_cnt string, write_date string, add_file_yn string, notice_yn string"
REF = "board_no int, art_no bigint, position int, title string, author string, view_count int, posted_at timestamp, has_file boolean, is_notice boolean"


class PageFetcher(Protocol):
    """A site, as the executors call it; a session that has to log in does so when it is first used there.

    list_page: the HTML of a board's page, counted from 1, newest entries first, empty beyond the last; it is all that
    the streaming source needs. view_page: a post's page. inner_page: what the address of a view's frame shows.
    download: the bytes of an attachment by the address of its link. Where something is not there they give an empty
    value; what fails raises.
    """

    def list_page(self, board_no: int, page: int) -> str: ...

    def view_page(self, board_no: int, art_no: int) -> str: ...

    def inner_page(self, board_no: int, art_no: int, address: str) -> str: ...

    def download(self, board_no: int, address: str) -> bytes: ...


def list_array(html: Column) -> Column:
    """array<struct> of the page's inline array; null where there is none or it does not parse."""
    raw = F.regexp_extract(html, r"(?s)var\s+exData\s*=\s*(\[.*?\])\s*;", 1)
    clean = F.regexp_replace(F.regexp_replace(raw, r",\s*([\]}])", "$1"), r"\\'", "'")
    return F.from_json(clean, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in ROW.split(', '))}>>")


def list_rows(pages: DataFrame) -> DataFrame:
    """pages: board_no, html. One row per list entry with a numeric id, in order of the array."""
    rows = pages.select("board_no", F.posexplode(list_array(F.col("html"))).alias("position", "r"))
    flag = lambda c: F.coalesce(F.col(c) == "Y", F.lit(False))
    count = strip(F.col("r.read_cnt"))
    return rows.select(
        "board_no",
        F.col("r.art_seq_no").try_cast("bigint").alias("art_no"),
        "position",
        strip(F.coalesce("r.art_title", F.lit(""))).alias("title"),
        F.nullif("r.mbr_nick", F.lit("")).alias("author"),
        F.coalesce(F.when(count.rlike("^[0-9]+$"), count.try_cast("int")), F.lit(0)).alias("view_count"),
        list_date(F.col("r.write_date")).alias("posted_at"),
        flag("r.add_file_yn").alias("has_file"),
        flag("r.notice_yn").alias("is_notice"),
    ).filter("art_no is not null")


def since(refs: DataFrame, state: DataFrame, by_date: bool = False) -> DataFrame:
    """Entries above their board's mark (and, by_date, of later days); boards without a mark are read whole. Entries to be retried come again."""
    s = state.select(F.col("board_id").alias("board_no"), "last_art_no", "last_posted_at")
    new = F.col("last_art_no").isNull() | (F.col("art_no") > F.col("last_art_no"))
    if by_date:
        new &= F.col("last_posted_at").isNull() | F.col("posted_at").isNull() | (F.col("posted_at") > F.col("last_posted_at"))
    return refs.join(s, "board_no", "left").filter(new).select(refs.columns)


def post_bodies(refs: DataFrame, views: DataFrame, inner: DataFrame) -> DataFrame:
    """Second hop: the inner page a view's frame shows, else the view itself."""
    i = inner.select("board_no", "art_no", F.col("html").alias("inner_html"))
    out = refs.join(views.select("board_no", "art_no", F.col("html").alias("view_html")), ["board_no", "art_no"], "left").join(i, ["board_no", "art_no"], "left")
    framed = F.col("view_html").rlike(r"(?i)<iframe[^>]+src\s*=")
    return out.withColumn("body_html", F.when(framed, F.coalesce("inner_html", "view_html")).otherwise(F.col("view_html"))).drop("inner_html")


def attachment_links(views: DataFrame) -> DataFrame:
    """views: board_no, art_no, view_html. Links to downloads, first of each stored name, with names, kind and address."""
    links = views.select("board_no", "art_no", F.posexplode(F.regexp_extract_all("view_html", F.lit(r"[\"']([^\"']*downloadFile\.do\?[^\"']*)[\"']"), F.lit(1))).alias("position", "url"))
    clean = links.withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))
    query = lambda k: F.try_url_decode(F.regexp_extract("url", rf"[?&]{k}=([^&]*)", 1))
    rows = clean.withColumn("stored", query("fileNm")).withColumn("file_name", F.coalesce(F.nullif(query("fileRnm"), F.lit("")), F.col("stored")))
    first = Window.partitionBy("board_no", "art_no", "stored").orderBy("position")
    return rows.filter("stored <> ''").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n").withColumn("kind", file_kind(F.col("file_name")))


def fetch_bodies(refs: DataFrame, fetcher: PageFetcher) -> DataFrame:
    """refs with view_html, body_html and error, fetched by the executors: a view, and the page of its frame if it has one.

    A view that is not there, or a fetch that raises, is an error of its post; a frame without a page shows the view.
    """
    import re

    frame = re.compile(r"<iframe[^>]+src\s*=\s*[\"']?([^\"'\s>]+)", re.I)

    def one(board_no, art_no) -> tuple:
        try:
            view = fetcher.view_page(board_no, art_no)
            if not view:
                return None, None, "no page"
            found = frame.search(view)
            inner = fetcher.inner_page(board_no, art_no, found[1].replace("&amp;", "&")) if found else ""
            return view, inner or view, None
        except Exception as e:  # whatever a site does, other posts go on
            return None, None, f"{type(e).__name__}: {e}"[:500]

    return _fetched(refs, ("board_no", "art_no"), one, {"view_html": pa.string(), "body_html": pa.string(), "error": pa.string()}, "view_html string, body_html string, error string")


def fetch_files(links: DataFrame, fetcher: PageFetcher) -> DataFrame:
    """links (board_no, url) with content and error, fetched by the executors; a file that is not there has neither."""

    def one(board_no, url) -> tuple:
        try:
            return fetcher.download(board_no, url) or None, None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:500]

    return _fetched(links, ("board_no", "url"), one, {"content": pa.binary(), "error": pa.string()}, "content binary, error string")


def _fetched(rows: DataFrame, keys: tuple, one, kinds: dict, more: str, at_once: int = 16) -> DataFrame:
    """rows with the columns that one(*keys) gives, so many rows fetched and held at once."""
    from pyspark.sql.types import StructType

    schema = StructType(rows.schema.fields + StructType.fromDDL(more).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                values = [one(*k) for k in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in keys))]
                columns = [pa.array([v[i] for v in values], t) for i, t in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *kinds])

    return rows.mapInArrow(run, schema)


def fixture_pages(spark, directory: str) -> DataFrame:
    """Saved pages <directory>/<board>/<name>.html: board_no, name, html. A board without files has no rows."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(directory)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"/(\d+)/[^/]+$", 1).try_cast("int").alias("board_no"), F.regexp_extract(path, r"/([^/]+)\.html$", 1).alias("name"), F.col("value").alias("html"))


def fixture_files(spark, directory: str) -> DataFrame:
    """Saved attachments <directory>/<board>/files/<stored name>: board_no, stored, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    kept = files.select(F.regexp_extract("path", r"/(\d+)/files/[^/]+$", 1).try_cast("int").alias("board_no"), F.try_url_decode(F.regexp_extract("path", r"/files/([^/]+)$", 1)).alias("stored"), "content")
    return kept.filter("board_no is not null and stored <> ''")


class SavedPages:
    """Pages from a folder <path>/<board>/{board_p,post_,inner_}<n>.html and files/<stored name>, on any file system that pyarrow opens, shared by driver and executors."""

    def __init__(self, path: str):
        self.path = path if "://" in path else f"file://{path}"

    def _bytes(self, name: str) -> bytes:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path)
        try:
            with where.open_input_file(f"{root}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return b""

    def list_page(self, board_no: int, page: int) -> str:
        return self._bytes(f"{board_no}/board_p{page}.html").decode()

    def view_page(self, board_no: int, art_no: int) -> str:
        return self._bytes(f"{board_no}/post_{art_no}.html").decode()

    def inner_page(self, board_no: int, art_no: int, address: str) -> str:
        return self._bytes(f"{board_no}/inner_{art_no}.html").decode()

    def download(self, board_no: int, address: str) -> bytes:
        from urllib.parse import parse_qs, urlsplit

        stored = parse_qs(urlsplit(address).query).get("fileNm", [""])[0]
        return self._bytes(f"{board_no}/files/{stored}") if stored and "/" not in stored else b""


def page_rows(html: str) -> list[dict]:
    """Entries of a list page, in plain Python, for the reader below."""
    import re

    m = re.search(r"var\s+exData\s*=\s*(\[.*?\])\s*;", html, re.S)
    try:
        found = json.loads(re.sub(r",\s*([\]}])", r"\1", m[1]).replace("\\'", "'")) if m else []
    except ValueError:
        return []
    return [r for r in found if isinstance(r, dict)]


@dataclass
class Stretch:
    """Entries of a board with low < art_no <= high, the page where they began when they were planned, and how many they filled."""

    board: int
    low: int
    high: int
    page: int
    pages: int


@dataclass
class Stretches(InputPartition):
    """What one task reads: a long stretch, or several short ones."""

    of: list[Stretch]


class BoardReader(DataSourceStreamReader):
    """Entries above the newest one read so far, in tasks of about pages_per_task pages. The offset is {boards: {board: art_no}}.

    The driver asks for few pages only: the first of each board, for the offset; and, where there is news, those that tell
    by doubling and halving how many pages it fills and which entries its stretches begin with. The entries are read by the
    executors. Stretches end at entries, not at pages: new entries push old ones to later pages, removed ones pull them
    back, and a reader goes to where its stretch begins and on until it ends, so none is lost or read twice.

    Boards are read to their end, however long. A page that repeats the one before, and one far behind that is no older, are
    errors, as are more than most_pages of them where that option is set: silence would drop older entries for good. full reads boards from their beginning once more. Entries whose date is not after since (yyyy-MM-dd) end a
    board as well.
    """

    def __init__(self, options: dict, fetcher: PageFetcher | None = None):
        self.boards = [int(b) for b in options.get("boards", "").split(",") if b]
        self.fetcher = fetcher or SavedPages(options["path"])
        self.since = options.get("since", "")
        self.most, self.per_task = int(options.get("most_pages", 0)) or sys.maxsize, int(options.get("pages_per_task", PAGES_PER_TASK))
        self.at_once = int(options.get("requests_at_once", 8))
        self.run = uuid.uuid4().hex if options.get("full", "false") == "true" else ""

    def _entries(self, board: int, page: int) -> list[tuple[int, str, str]]:
        """(art_no, title, day) of a page's entries with a number; a page of others only is no end: number -1."""
        rows = page_rows(self.fetcher.list_page(board, page))
        found = [(int(r["art_seq_no"]), str(r.get("art_title", "")).strip(), str(r.get("write_date", ""))) for r in rows if str(r.get("art_seq_no", "")).isdigit()]
        return found or [(-1, "", "")] * bool(rows)

    def _each(self, work, boards) -> list:
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(work, boards))

    def initialOffset(self) -> dict:
        return {"run": "", "boards": {str(b): -1 for b in self.boards}}

    def latestOffset(self) -> dict:
        newest = self._each(lambda b: max((e[0] for e in self._entries(b, 1)), default=-1), self.boards)
        return {"run": self.run, "boards": {str(b): n for b, n in zip(self.boards, newest)}}

    def _new(self, entries: list, low: int) -> bool:
        """Whether a page has an entry to read, or may be before one."""
        return bool(entries) and any(e[0] == -1 or (e[0] > low and not (self.since and e[2] and e[2] <= self.since)) for e in entries)

    def _stretches(self, board: int, low: int, high: int) -> list[Stretch]:
        newest = lambda entries: max((e[0] for e in entries), default=-1)
        fills = lambda p: self._new(self._entries(board, p), low)
        last = 1
        if self.per_task < self.most and fills(1 + self.per_task):
            last, before = 1 + self.per_task, high
            while self._new(found := self._entries(board, min(2 * last, self.most + 1)), low):
                last = min(2 * last, self.most + 1)
                if last > self.most:
                    raise RuntimeError(f"board {board}: more than {self.most} pages")
                if newest(found) >= before:
                    raise RuntimeError(f"board {board}: page {last} repeats what came before")
                before = newest(found) if newest(found) != -1 else before
            over = 2 * last
            while over - last > 1:
                middle = (last + over) // 2
                last, over = (middle, over) if fills(middle) else (last, middle)
        pages = range(1, last + 1, self.per_task)
        begins = [high, *(max((e[0] for e in self._entries(board, p)), default=low) for p in pages[1:])]
        # an end is where the next one begins; a page without numbers in between joins its neighbour
        begins = [min(begins[: i + 1]) if b != -1 else None for i, b in enumerate(begins)]
        kept = [(p, b) for p, b in zip(pages, begins) if b is not None and b > low]
        ends = [*kept[1:], (last + 1, low)]
        return [Stretch(board, e, b, p, q - p) for (p, b), (q, e) in zip(kept, ends) if e < b]

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        known = start["boards"] if start.get("run", "") == end.get("run", "") else {}
        marks = [(b, int(known.get(str(b), -1)), int(end["boards"].get(str(b), -1))) for b in self.boards]
        news = [m for m in marks if m[2] > m[1]]
        tasks, room = [], 0
        for s in (s for some in self._each(lambda x: self._stretches(*x), news) for s in some):
            if s.pages > room:
                tasks.append(Stretches([]))
                room = self.per_task
            tasks[-1].of.append(s)
            room -= s.pages
        return tasks

    def read(self, partition: Stretches):
        for s in partition.of:
            yield from self._read(s)

    def _read(self, p: Stretch):
        page, before = p.page, None
        while page > 1 and max((e[0] for e in self._entries(p.board, page)), default=-1) < p.high:
            page -= 1  # entries before it have gone
        first = page
        while True:
            entries = self._entries(p.board, page)
            if not entries:
                return
            if entries == before:
                raise RuntimeError(f"board {p.board}: page {page} repeats the one before")
            if page - first >= self.most:
                raise RuntimeError(f"board {p.board}: more than {self.most} pages")
            for art, title, day in entries:
                if art == -1:
                    continue
                if art <= p.low or (self.since and day and day <= self.since):
                    return
                if art <= p.high:
                    yield (p.board, art, title, day)
            before, page = entries, page + 1

    def commit(self, end: dict) -> None:
        pass


def board_source(fetcher: PageFetcher | None = None, name: str = "boards") -> type[DataSource]:
    """A streaming source over a fetcher: spark.dataSource.register(board_source(fetcher)); readStream.format(name).option("boards", "1,2")."""

    class BoardSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "board_no int, art_no bigint, title string, write_date string"

        def streamReader(self, schema) -> BoardReader:
            return BoardReader(self.options, fetcher)

    return BoardSource


#: Pages saved in a folder: .option("path", folder).
BoardSource = board_source()
