"""PDF files as tables: a reader of plain drawings without other libraries, and adapters for two libraries where installed.

read_documents() loads files with Spark's binaryFile source and parses each in one Python call. What it yields are rows,
pages and grids; nothing after it knows about PDF.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import PRIMARY, SECONDARY
from .tables import GRIDS, PAGES

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|\[|\]|/[^\s/\[\]()<>]+|<[0-9A-Fa-f\s]*>|[^\s\[\]()<>/]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    body = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw[1:-1])
    return re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S).decode("latin-1")


class PlainPdf:
    """Uncompressed or deflated files whose text is shown with Td, Tm, Tj and TJ in one-byte fonts."""

    def __init__(self, data: bytes) -> None:
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        if not data.startswith(b"%PDF") or not roots:
            raise ValueError("not a PDF file that can be read here")
        top = re.search(rb"/Pages\s+(\d+)", roots[0])
        self.pages = list(self._leaves(int(top[1]), None)) if top else []

    def _leaves(self, n: int, box: list[float] | None) -> Iterator[tuple[bytes, list[float]]]:
        body = self.objects.get(n, b"")
        own = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body)
        box = [float(x) for x in own[1].split()] if own else box
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if kids:
            for k in _REF.findall(kids[1]):
                yield from self._leaves(int(k), box)
        else:
            yield body, box or [0, 0, 612, 792]

    def _content(self, page: bytes) -> bytes:
        at = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        out = []
        for n in _REF.findall(at[1]) if at else []:
            body = self.objects.get(int(n), b"")
            m = _STREAM.search(body)
            if m:
                out.append(zlib.decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1])
        return b"\n".join(out)

    def read(self, number: int) -> dict:
        """Words with boxes from the top left, and counts of lines, curves and rectangles."""
        page, box = self.pages[number - 1]
        height = box[3] - box[1]
        stack: list = []
        words, count = [], {"n_lines": 0, "n_curves": 0, "n_rects": 0}
        x = y = lx = ly = 0.0
        size, lead = 10.0, 12.0

        def show(said: str) -> None:
            nonlocal x
            step = size * 0.5
            for m in re.finditer(r"\S+", said):
                words.append((x + m.start() * step, height - y - size, x + m.end() * step, height - y, m[0]))
            x += len(said) * step

        for t in _TOKEN.findall(self._content(page)):
            if t[:1] in b"([<]/" or re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
                stack.append(t)
                continue
            numbers = [float(v) for v in stack if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", v)]
            strings = [_string(v) for v in stack if v[:1] in b"(<"]
            if t == b"BT":
                x = y = lx = ly = 0.0
            elif t == b"Tf" and numbers:
                size = numbers[-1]
            elif t == b"TL" and numbers:
                lead = numbers[-1]
            elif t in (b"Td", b"TD") and len(numbers) >= 2:
                lx, ly = lx + numbers[-2], ly + numbers[-1]
                x, y = lx, ly
            elif t == b"Tm" and len(numbers) >= 6:
                lx, ly = numbers[-2:]
                x, y = lx, ly
            elif t == b"T*" or t == b"'":
                ly -= lead
                x, y = lx, ly
            if t in (b"Tj", b"TJ", b"'"):
                show("".join(strings))
            elif t == b"l":
                count["n_lines"] += 1
            elif t in (b"c", b"v", b"y"):
                count["n_curves"] += 1
            elif t == b"re":
                count["n_rects"] += 1
            stack.clear()
        return {"width": box[2] - box[0], "height": height, "words": words, **count}


def lines_of(words: list[tuple], slack: float = 3.0) -> list[list[tuple]]:
    """Words by line, top to bottom, each from left to right."""
    out: list[list[tuple]] = []
    for w in sorted(words, key=lambda w: (w[3], w[0])):
        if out and abs(out[-1][0][3] - w[3]) <= slack:
            out[-1].append(w)
        else:
            out.append([w])
    return [sorted(line) for line in out]


def grids_of(words: list[tuple], gap: float = 12.0) -> list[list[list[str | None]]]:
    """Tables from alignment: runs of lines with three or more cells, whose columns are the starts of the first line's cells."""
    found, rows, starts = [], [], []
    for line in [*lines_of(words), []]:
        cells: list[list] = []
        for w in line:
            if cells and w[0] - cells[-1][1] < gap:
                cells[-1][1], cells[-1][2] = w[2], f"{cells[-1][2]} {w[4]}"
            else:
                cells.append([w[0], w[2], w[4]])
        fits = bool(rows) and bool(cells) and all(any(abs(c[0] - s) <= gap / 2 for s in starts) for c in cells)
        if not fits:
            if len(rows) > 1:
                found.append(rows)
            rows, starts = ([], [c[0] for c in cells]) if len(cells) > 2 else ([], [])
        if starts:
            row: list[str | None] = [None] * len(starts)
            for c in cells:
                row[min(range(len(starts)), key=lambda i: abs(starts[i] - c[0]))] = c[2]
            rows.append(row)
    return found


def read_plain(data: bytes) -> Iterator[tuple[dict, list[tuple[str, int, list]]]]:
    """For every page its row and its grids; a page that can't be read has no text and no grids."""
    pdf = PlainPdf(data)
    for n in range(1, len(pdf.pages) + 1):
        try:
            got = pdf.read(n)
            said = "\n".join(" ".join(w[4] for w in line) for line in lines_of(got["words"]))
            grids = [(PRIMARY, i, g) for i, g in enumerate(grids_of(got["words"]))]
        except Exception:  # noqa: BLE001 - one bad page mustn't lose the document
            got, said, grids = {"words": []}, "", []
        yield {"page": n, "text": said, **got}, grids


def read_libraries(data: bytes) -> Iterator[tuple[dict, list[tuple[str, int, list]]]]:
    """The same through both parser libraries; ImportError where they are missing. A failing page or table yields nothing."""
    import fitz
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf, fitz.open(stream=data, filetype="pdf") as other:
        for n, page in enumerate(pdf.pages, 1):
            row: dict = {"page": n, "text": "", "width": float(page.width), "height": float(page.height), "words": []}
            grids: list[tuple[str, int, list]] = []
            for name in ("lines", "curves", "rects"):
                try:
                    row[f"n_{name}"] = len(getattr(page, name))
                except Exception:  # noqa: BLE001
                    row[f"n_{name}"] = 0
            try:
                row["text"] = page.extract_text() or ""
                row["words"] = [(w["x0"], w["top"], w["x1"], w["bottom"], w["text"]) for w in page.extract_words()]
            except Exception:  # noqa: BLE001
                pass
            try:
                grids += [(SECONDARY, i, t) for i, t in enumerate(page.extract_tables() or []) if t]
            except Exception:  # noqa: BLE001
                pass
            try:
                found = other[n - 1].find_tables().tables
            except Exception:  # noqa: BLE001
                found = []
            for i, t in enumerate(found):
                try:
                    cells = t.extract()
                except Exception:  # noqa: BLE001
                    cells = None
                if cells:
                    grids.append((PRIMARY, i, cells))
            yield row, grids


class Documents(NamedTuple):
    """documents(doc), pages, grids, errors(doc, error): what one parse of every file gave."""

    documents: DataFrame
    pages: DataFrame
    grids: DataFrame
    errors: DataFrame


def _names(spark: SparkSession, path: str) -> Column:
    """A file's name below the folder given, so that files of one name in two folders stay apart; its whole path if the path is a pattern."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    given = jvm.org.apache.hadoop.fs.Path(path)
    root = given.getFileSystem(conf).makeQualified(given).toString().rstrip("/")
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731 - file:/a and file:///a are one
    here, of = plain(F.col("path")), plain(F.lit(root))
    inside = F.startswith(here, F.concat(of, F.lit("/")))
    return F.when(here == of, F.element_at(F.split(here, "/"), -1)).when(inside, F.substring(here, F.length(of) + 2, F.length(here))).otherwise(here)


def read_documents(spark: SparkSession, path: str, reader: Callable = read_plain, pattern: str = "*.pdf", keep: Callable[[DataFrame], DataFrame] | None = None) -> Documents:
    """All files under a path; a document is known by its path below that.

    Pages, grids and errors come from one parse, which keep() holds on to (DataFrame.persist unless given otherwise; a
    function that writes and reads it again suits large collections). A file that fails in any way has no pages and one
    error; the other files of its batch are read as usual.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("doc", _names(spark, path))
    schema = f"{PAGES}, grids array<struct<parser:string,table_index:int,grid:array<array<string>>>>, error string"
    order = [c.split()[0] for c in PAGES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["doc"], pdf["content"], strict=True):
                out = []
                try:
                    for row, grids in reader(content):
                        words = [dict(zip(("x0", "y0", "x1", "y1", "word"), w, strict=True)) for w in row.get("words", [])]
                        out.append({"doc": doc, "width": None, "height": None, "n_lines": 0, "n_curves": 0, "n_rects": 0, **row, "words": words, "grids": [{"parser": p, "table_index": i, "grid": g} for p, i, g in grids], "error": None})
                except Exception as e:  # noqa: BLE001 - one bad file mustn't lose the others
                    out = [dict.fromkeys(order) | {"doc": doc, "words": [], "grids": [], "error": f"{type(e).__name__}: {e}"}]
                if out:
                    yield pd.DataFrame(out, columns=[*order, "grids", "error"]).astype(dict.fromkeys(("page", "n_lines", "n_curves", "n_rects"), "Int64"))

    parsed = (keep or DataFrame.persist)(files.select("doc", "content").mapInPandas(run, schema))
    good = parsed.where("error is null")
    grids = good.select("doc", "page", F.explode("grids").alias("g")).select("doc", "page", "g.parser", "g.table_index", "g.grid")
    assert grids.columns == [c.split()[0] for c in GRIDS.split(", ")]
    return Documents(files.select("doc"), good.drop("grids", "error"), grids, parsed.where("error is not null").select("doc", "error"))
