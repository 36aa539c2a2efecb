"""Sources: files of many formats as text, read with binaryFile and decoded where needed.

Contents go through Arrow batches, in one scan; of files that are refused only the listing is read. A
file that can't be read gives an ``error`` instead of failing the job.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.text import strip

MAX_FILE, MAX_EXPANDED = 20 << 20, 64 << 20
TEXT = ["txt", "md", "markdown", "rst", "log", "csv", "tsv", "json", "jsonl", "yaml", "yml", "ini", "cfg", "conf", "tex", "srt", "vtt"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def tidy(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


class _Blocks(HTMLParser):
    """Text of headings, paragraphs, list items, quotes and table rows; scripts and styles go."""

    KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "tr"}
    GONE = {"script", "style", "noscript", "svg"}

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[tuple[str, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.gone = 0
        self.rest: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.GONE:
            self.gone += 1
        elif tag in self.KEPT:
            if self.open and (tag == self.open[-1][0] or self.open[-1][0] == "p"):
                self._close()
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.GONE:
            self.gone = max(0, self.gone - 1)
        elif any(t == tag for t, _ in self.open):
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.gone:
            (self.open[-1][1] if self.open else self.rest).append(data)

    def _close(self) -> str:
        tag, parts = self.open.pop()
        if text := " ".join("".join(parts).split()):
            self.blocks.append((tag, text))
        return tag

    def result(self) -> list[tuple[str, str]]:
        while self.open:
            self._close()
        rest = " ".join("".join(self.rest).split())
        return self.blocks or ([("body", rest)] if rest else [])


def html_parts(source: str | None) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(source or "")
    parser.close()
    return parser.result()


def html_blocks(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, type, text): one row per block of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, t, x) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (t, x) in enumerate(html_parts(h))]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=[key, "pos", "type", "text"])

    return pages.select(F.col(key).cast("long"), column).mapInArrow(run, f"{key} long, pos int, type string, text string")


def decode_bytes(raw: bytes) -> str:
    """Plain text: UTF-8 if it is that, else windows-1251, whose one free byte stands for itself."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1251", "surrogateescape").replace("\udc98", "\x98")


def rtf_text(raw: bytes) -> str:
    """Text of an RTF file: escapes, paragraphs, tabs; groups of tables and controls go."""
    s = re.sub(r"{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:{[^{}]*}[^{}]*)*}", "", raw.decode("latin-1"))
    s = re.sub(r"\\u(-?\d+) ?(?:\\'[0-9a-fA-F]{2}|\?)?", lambda m: chr(int(m[1]) & 0xFFFF), s)
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1251", "replace"), s)
    s = re.sub(r"\\(?:par|line)\b ?", "\n", s)
    s = re.sub(r"\\tab\b ?", "\t", s)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]|\\\*", "", s).strip()


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _xml(raw: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError("document types are not read")
    return ElementTree.fromstring(raw)


def xml_text(raw: bytes, names: tuple[str, ...] = ("title", "subtitle", "p")) -> str:
    return "\n\n".join(x for e in _xml(raw).iter() if _local(e) in names and (x := " ".join("".join(e.itertext()).split())))


def _package(raw: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(raw))
    if sum(i.file_size for i in z.infolist()) > MAX_EXPANDED:
        raise ValueError("the package expands beyond the limit")
    if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in z.infolist()):
        raise ValueError("the package has unsafe paths")
    return z


def docx_text(raw: bytes) -> str:
    body = _xml(_package(raw).read("word/document.xml"))
    mark = {"t": lambda e: e.text or "", "tab": lambda _: "\t", "br": lambda _: "\n"}
    return "\n\n".join(x for p in body.iter() if _local(p) == "p" and (x := "".join(mark[_local(e)](e) for e in p.iter() if _local(e) in mark).strip()))


def odt_text(raw: bytes) -> str:
    return xml_text(_package(raw).read("content.xml"), ("h", "p"))


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx_text(raw: bytes) -> str:
    z = _package(raw)
    slides = _numbered(z, r"ppt/slides/slide(\d+)\.xml")
    return "\n\n".join(f"[Слайд {k}]\n" + "\n".join(e.text for e in _xml(z.read(n)).iter() if _local(e) == "t" and e.text) for k, n in enumerate(slides, 1))


def epub_text(raw: bytes) -> str:
    z = _package(raw)
    names = sorted(n for n in z.namelist() if re.search(r"\.x?html?$", n, re.I) and not re.search(r"(?:^|/)(?:nav|toc)[^/]*$", n, re.I))
    return "\n\n".join(t for n in names for _, t in html_parts(z.read(n).decode("utf-8", "replace")))


def _column(reference: str) -> int:
    """The number from 0 of the column that a cell reference names, or -1."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


#: Number formats of the standard that show a date.
DATE_FORMATS = frozenset((*range(14, 23), 27, 30, 36, *range(45, 48), 50, 57))


def _dated_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = _xml(z.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")) for e in root.iter() if _local(e) == "numFmt" and re.search("[dmyhs]", re.sub('"[^"]*"|\\[[^\\]]*\\]', "", e.get("formatCode", "")), re.I)}
    formats = next((e for e in root if _local(e) == "cellXfs"), ())
    return {k for k, e in enumerate(formats) if int(e.get("numFmtId", 0)) in own | DATE_FORMATS}


def _as_date(value: str) -> str:
    """A day number of a sheet as month/day/two-digit year."""
    day = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value))
    return f"{day.month}/{day.day}/{day.year % 100:02d}"


def _csv_cell(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if re.search('[\t\n"]', value) else value


def xlsx_text(raw: bytes) -> str:
    """Every sheet as tab-separated rows under its name, cells where their references put them; empty sheets are left out."""
    z = _package(raw)
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in e.iter() if _local(t) == "t") for e in _xml(z.read("xl/sharedStrings.xml")) if _local(e) == "si"]
    dated = _dated_styles(z)
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        targets = {e.get("Id"): e.get("Target", "") for e in _xml(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for k, sheet in enumerate((e for e in _xml(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"), 1):
        target = targets.get(next((v for a, v in sheet.attrib.items() if a.endswith("}id")), ""), f"worksheets/sheet{k}.xml")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part not in z.namelist():
            continue
        rows: dict[int, dict[int, str]] = {}
        for row in (e for e in _xml(z.read(part)).iter() if _local(e) == "row"):
            at = int(row.get("r") or max(rows, default=0) + 1)
            cells = rows.setdefault(at, {})
            for c in (e for e in row if _local(e) == "c"):
                column = _column(c.get("r", ""))
                value = next((v.text or "" for v in c if _local(v) == "v"), "".join(t.text or "" for t in c.iter() if _local(t) == "t"))
                if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                elif c.get("t") == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                elif c.get("t") in (None, "n") and value and int(c.get("s") or 0) in dated:
                    value = _as_date(value)
                if value:
                    cells[column if column >= 0 else max(cells, default=-1) + 1] = _csv_cell(value)
        filled = {k: v for k, v in rows.items() if v}
        if not filled:
            continue
        left, width = min(min(c) for c in filled.values()), max(max(c) for c in filled.values())
        lines = ["\t".join(rows.get(k, {}).get(c, "") for c in range(left, width + 1)) for k in range(min(filled), max(filled) + 1)]
        out.append(f"[{sheet.get('name', '')}]\n" + "\n".join(lines).strip())
    return "\n\n".join(out)


READERS: dict[str, Callable[[bytes], str]] = {
    "html": lambda b: "\n\n".join(t for _, t in html_parts(b.decode("utf-8", "replace"))),
    "htm": lambda b: "\n\n".join(t for _, t in html_parts(b.decode("utf-8", "replace"))),
    "xml": xml_text, "fb2": xml_text, "rtf": rtf_text, "docx": docx_text, "odt": odt_text, "pptx": pptx_text,
    "epub": epub_text, "xlsx": xlsx_text, "xlsm": xlsx_text,
}


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, extension, text, error): every file below ``path``; unknown extensions are read as plain text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("extension", extension(F.col("path")))
    # only the listing of what is refused is read
    reasons = {"doc": "legacy Word files are not read", "pdf": "no PDF reader is installed"}
    refused = F.when(F.col("length") > MAX_FILE, "the file is too large")
    for kind, why in reasons.items():
        refused = refused.when(F.col("extension") == kind, why)
    bad = named.where((F.col("length") > MAX_FILE) | F.col("extension").isin(*reasons)).select("path", "extension", F.lit(None).cast("string").alias("text"), refused.alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for ext, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = error = None
                try:
                    text = READERS.get(ext, decode_bytes)(raw)
                except Exception as e:  # one bad file is a row, not a failed job
                    error = f"{type(e).__name__}: {e}"[:200]
                texts.append(text)
                errors.append(error)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "extension", "text", "error"])

    good = named.where((F.col("length") <= MAX_FILE) & ~F.col("extension").isin(*reasons)).select("path", "extension", "content")
    both = good.mapInArrow(run, "path string, extension string, text string, error string").unionByName(bad).withColumn("text", tidy(F.col("text")))
    empty = F.col("error").isNull() & (F.coalesce("text", F.lit("")) == "")
    return both.withColumn("error", F.when(empty, "the file has no text").otherwise(F.col("error")))
