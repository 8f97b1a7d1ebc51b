"""Attachments: kinds, extractors as plug-ins, and spreadsheets as cell grids."""

from __future__ import annotations

import base64
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import file_kind

#: (text, method) of a file's bytes and name, by kind; an engine may raise, which counts as having found nothing.
Extractor = Callable[[bytes, str], tuple[str | None, str | None]]
RESULT = "struct<text:string,status:string,method:string,pages:array<struct<page_no:int,text:string>>,is_table:boolean,error:string,page_count:int>"

# Header words of approval matrices, tried in this order.
HEADERS = {
    "business_category": ("대분류", "분류", "category"),
    "business_item": ("업무항목", "업무", "항목", "item"),
    "action_type": ("결재구분", "전결구분", "구분", "결재", "action"),
    "amount_expr": ("금액", "amount"),
    "approver_role": ("전결권자", "결재자", "전결자", "approver"),
    "consulter_roles": ("합의", "협의", "consult"),
    "condition_note": ("비고", "조건", "note"),
    "matrix_row_label": ("행", "row"),
    "matrix_col_label": ("열", "col"),
}


def header_fields(header: list[str], longest_first: bool = False) -> list[str | None]:
    """Field of each header cell: the first whose word it contains; longest_first lets longer words go before."""
    words = [(w, field) for field, ws in HEADERS.items() for w in ws]
    if longest_first:
        words.sort(key=lambda x: -len(x[0]))
    return [next((field for w, field in words if w in (h or "").strip()), None) for h in header]


def sheet_rows(content: bytes) -> list[list[str]]:
    """Cells of an xlsx file's first sheet, by reading its XML; gaps are empty strings."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iterfind(".//m:row", ns):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.findall("m:c", ns)):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                value = c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                cells[(at or k + 1) - 1] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def grid_text(rows: list[list[str]]) -> str:
    return "\n".join("\t".join(x.strip() for x in r) for r in rows if any(x.strip() for x in r))


def grid_cells(rows: list[list[str]], longest_first: bool = False) -> list[dict]:
    """Records of a matrix grid: header first, rows without a business item are left out, order_seq counts the rest."""
    if not rows:
        return []
    fields, out = header_fields([str(h) for h in rows[0]], longest_first), []
    for r in rows[1:]:
        rec: dict = {}
        for f, v in zip(fields, r):
            if f and v.strip():
                rec[f] = v.strip()
        if rec.get("business_item"):
            rec["consulter_roles"] = [x.strip() for x in re.split("[/,·;]", rec.get("consulter_roles", "")) if x.strip()]
            rec["order_seq"] = len(out)
            out.append(rec)
    return out


CELL = "business_category string, business_item string, action_type string, amount_expr string, approver_role string, consulter_roles array<string>, condition_note string, matrix_row_label string, matrix_col_label string, order_seq int"


def matrix_cells(files: DataFrame, key: str = "regulation_id", longest_first: bool = False) -> DataFrame:
    """files: key, content (xlsx). Their cell records, with error for files that cannot be read: those never fail the rest."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(CELL).fieldNames()
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [{key: k, "error": None} | {n: rec.get(n) for n in names} for rec in grid_cells(sheet_rows(content or b""), longest_first)]
                except Exception as e:
                    out.append({key: k, "error": type(e).__name__} | dict.fromkeys(names))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(key, batch.schema.field(0).type), ("error", pa.string())] + [(n, pa.list_(pa.string()) if n == "consulter_roles" else pa.int32() if n == "order_seq" else pa.string()) for n in names]))

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, error string, {CELL}")


class OcrClient:
    """Text recognition behind one call. post(path, body) sends a JSON body and returns the JSON reply."""

    def __init__(self, base_url: str = "", post: Callable[[str, dict], dict] | None = None, timeout: float = 120.0):
        self.base_url, self.timeout = base_url.rstrip("/"), timeout
        self.post = post or self._http

    def _http(self, path: str, body: dict) -> dict:
        from urllib.request import Request, urlopen

        request = Request(self.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def pages(self, content: bytes) -> list[tuple[int, str | None]]:
        """(number from 1, text) of each page."""
        body = {"document": {"document_url": "data:application/pdf;base64," + base64.b64encode(content).decode()}}
        return [(n, (page or {}).get("markdown")) for n, page in enumerate(self.post("/v1/ocr", body).get("pages") or [], 1)]


def result(text: str | None = None, status: str = "pending", method: str | None = None, pages: list = (), is_table: bool = False, error: str | None = None, page_count: int | None = None) -> dict:
    return {"text": text or None, "status": status, "method": method, "pages": [{"page_no": n, "text": t} for n, t in pages], "is_table": is_table, "error": error, "page_count": page_count}


def recognised(content: bytes, ocr: OcrClient) -> dict:
    try:
        pages = ocr.pages(content)
    except Exception as e:  # whatever the service does, the file has failed and nothing else
        return result(status="failed", method="ocr-shim", error=f"{type(e).__name__}: {e}")
    return result("\n\n".join(t for _, t in pages if t), "done", "ocr-shim", pages, page_count=len(pages))


#: Characters that a text layer must have to count as one.
LEAST_TEXT = 10


def extracted(content: bytes | None, name: str, kind: str, engines: dict[str, Extractor], ocr: OcrClient | None, least: int = LEAST_TEXT) -> dict:
    """What is in a file, by its kind. Never raises: a file that cannot be read has failed, one that nothing here reads is pending.

    Sheets are read here. hwp goes to its engine; without one, or where it finds nothing, the file has failed. pdf goes to
    its engine for the text layer; less than `least` characters are a scan, for ocr, as images are; without ocr they wait.
    """
    if not content:
        return result(error="no content")
    try:
        if kind == "excel":
            return result(grid_text(sheet_rows(content)), "done", "native", is_table=True)
        text, method = engines[kind](content, name) if kind in engines else (None, None)
    except Exception as e:
        text, method, failed = None, None, f"{type(e).__name__}: {e}"
        if kind not in ("hwp", "pdf"):
            return result(status="failed", error=failed)
    text = (text or "").strip()
    if kind == "hwp":
        return result(text, "done", method) if text else result(status="failed", error="no engine could read it")
    if kind == "pdf" and len(text) >= least:
        return result(text, "done", method or "native")
    if kind in ("pdf", "image"):
        return recognised(content, ocr) if ocr else result(method="native" if kind == "pdf" else None, error="no text layer, and no text recognition")
    return result(text, "done", method) if text else result(error=f"unsupported kind {kind}")


def extract(files: DataFrame, engines: dict[str, Extractor] | None = None, ocr: OcrClient | None = None, least: int = LEAST_TEXT) -> DataFrame:
    """files: file_name, content. Adds kind, sha256 of the content (null if empty) and extract (see extracted)."""
    arrow = pa.struct([("text", pa.string()), ("status", pa.string()), ("method", pa.string()), ("pages", pa.list_(pa.struct([("page_no", pa.int32()), ("text", pa.string())]))), ("is_table", pa.bool_()), ("error", pa.string()), ("page_count", pa.int32())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, contents, kinds in batches:
            yield pa.array([extracted(c.as_py(), n, k, engines or {}, ocr, least) for n, c, k in zip(names.to_pylist(), contents, kinds.to_pylist())], arrow)

    with_kind = files.withColumn("kind", file_kind(F.col("file_name"))).withColumn("sha256", F.when(F.length("content") > 0, F.sha2("content", 256)))
    return with_kind.withColumn("extract", arrow_udf(run, returnType=RESULT)("file_name", "content", "kind"))
