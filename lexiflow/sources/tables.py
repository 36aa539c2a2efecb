"""Cells, styles and digests of files as rows: what ``operators.tables`` and ``operators.styles`` work on.

Each reader turns one file or page into rows in a narrow stage; grids, chains and comparisons are joins and windows afterwards.
A file that can't be read gives one row with its ``error``.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.sources.readers import _local, _package, _xml

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _rows(frame: DataFrame, schema: str, read: Callable, *columns: str) -> DataFrame:
    """Rows of ``read(value)`` for each key and value, with the key before them; an error gives its kind as the last column."""
    key = dict(frame.dtypes)[columns[0]]
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                try:
                    own = [(*r, None) for r in read(value)] if value is not None else []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    own = [(*[None] * len(names), type(e).__name__)]
                rows += own
                at += [k] * len(own)
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + 1)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, [*types, pa.string()], strict=True))], names=[columns[0], *names, "error"])

    return frame.select(*columns).mapInArrow(run, f"{columns[0]} {key}, {schema}, error string")


class _Cells(HTMLParser):
    """The cells of a page's tables; tables within cells are told as an error."""

    SKIPPED = frozenset(("script", "style", "iframe", "object", "embed", "form", "svg", "math"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self.table, self.row, self.at, self.depth, self.skip, self.head, self.cell = -1, -1, -1, 0, 0, False, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag == "table":
            self.depth += 1
            if self.depth > 1:
                raise ValueError("a table stands in a cell")
            self.table, self.row, self.cell, self.head = self.table + 1, -1, None, False
        elif self.depth and tag in ("thead", "tbody", "tfoot"):
            self.head = tag == "thead"
        elif self.depth and tag == "tr":
            self.row, self.at, self.cell = self.row + 1, -1, None
        elif self.depth and tag in ("td", "th") and self.row >= 0:
            self.at += 1
            spans = [int(v) if (v := (dict(attrs).get(name) or "").strip()).isdecimal() and len(v) < 6 else None if not v else -1 for name in ("colspan", "rowspan")]
            self.cell = [self.table, self.row, self.at, *spans, self.head or tag == "th", []]
            self.cells.append(self.cell)
        elif self.cell is not None and tag in ("br", "p", "div", "li"):
            self.cell[6].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.depth:
            self.depth, self.cell = self.depth - 1, None
        elif tag in ("td", "th", "tr"):
            self.cell = None
        elif self.cell is not None and tag in ("p", "div", "li"):
            self.cell[6].append("\n")

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.skip:
            self.cell[6].append(data)


def _html_cells(page: str) -> list[tuple]:
    parser = _Cells()
    parser.feed(page)
    parser.close()
    lines = lambda parts: "\n".join(x for line in "".join(parts).split("\n") if (x := " ".join(line.split())))
    return [(*c[:6], lines(c[6])) for c in parser.cells]


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table, row, at, col_span, row_span, header, text, error): the cells of every table of each page, in source order.

    Spans that aren't given are null, and -1 if they aren't numbers (``tables.placed`` refuses the table). White space is one blank, blocks and
    breaks are lines. A page with a table in a cell gives one row with an error; one without tables or with a null gives none.
    """
    return _rows(pages, "table int, row int, at int, col_span int, row_span int, header boolean, text string", _html_cells, key, html)


def _word(e: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return None if e is None else e.find(_W + name)


def _value(e: ElementTree.Element | None, name: str = "val") -> str | None:
    return None if e is None else e.get(_W + name)


def _run_text(p: ElementTree.Element) -> str:
    mark = {"t": lambda e: e.text or "", "tab": lambda _: "\t", "br": lambda _: "\n", "cr": lambda _: "\n", "noBreakHyphen": lambda _: "‑", "softHyphen": lambda _: "­"}
    return "".join(mark[_local(e)](e) for e in p.iter() if _local(e) in mark)


def _docx_cells(raw: bytes) -> list[tuple]:
    out = []
    for t, table in enumerate(_xml(_package(raw).read("word/document.xml")).iter(_W + "tbl")):
        if any(True for _ in table.iter(_W + "drawing")) or sum(1 for _ in table.iter(_W + "tbl")) > 1:
            raise ValueError("a table holds another table or a picture")
        for row, tr in enumerate(table.findall(_W + "tr")):
            if any(int(_value(_word(_word(tr, "trPr"), name)) or 0) for name in ("gridBefore", "gridAfter")):
                raise ValueError("a row is not whole")
            for at, tc in enumerate(tr.findall(_W + "tc")):
                pr = _word(tc, "tcPr")
                merge = _word(pr, "vMerge")
                paragraphs = tc.findall(_W + "p")
                style = _value(_word(_word(paragraphs[0], "pPr"), "pStyle")) if paragraphs else None
                goes_on = None if merge is None else "restart" if _value(merge) == "restart" else "continue"
                out.append((t, row, at, int(_value(_word(pr, "gridSpan")) or 1), goes_on, style, "\n".join(map(_run_text, paragraphs))))
    return out


def docx_cells(files: DataFrame) -> DataFrame:
    """(path, table, row, at, col_span, merge, style_id, text, error): the cells of the tables of Word files (path, content), as ``tables.merged`` takes them.

    ``style_id`` is the style of a cell's first paragraph. A file with nested tables, pictures in tables, or rows that aren't whole gives
    one row with an error, so nothing is simplified on the way.
    """
    return _rows(files, "table int, row int, at int, col_span int, merge string, style_id string, text string", _docx_cells, "path", "content")


# How alignments are named.
ALIGNED = {"left": "left", "start": "left", "right": "right", "end": "right", "center": "center", "both": "justify"}


def _on(e: ElementTree.Element) -> bool:
    return (_value(e) or "").lower() not in ("0", "false", "off")


def _properties(style: ElementTree.Element) -> dict[str, str]:
    """What a style says of its runs and paragraphs."""
    run, paragraph, out = _word(style, "rPr"), _word(style, "pPr"), {}
    fonts, size, colour = _word(run, "rFonts"), _value(_word(run, "sz")), _value(_word(run, "color"))
    out["fontFamily"] = next((x for k in ("ascii", "hAnsi", "cs") if (x := _value(fonts, k))), None)
    out["fontSize"] = f"{int(size) / 2:g}pt" if size and size.isdecimal() else None
    out["color"] = f"#{colour.upper()}" if colour and len(colour) == 6 and all(c in "0123456789abcdefABCDEF" for c in colour) else None
    for name, key, yes, no in (("b", "fontWeight", "bold", "normal"), ("i", "fontStyle", "italic", "normal")):
        e = _word(run, name)
        out[key] = None if e is None else yes if _on(e) else no
    out["textAlign"] = ALIGNED.get(_value(_word(paragraph, "jc")))
    for side, key in (("before", "marginTop"), ("after", "marginBottom")):
        v = _value(_word(paragraph, "spacing"), side)
        out[key] = f"{int(v) / 20:g}pt" if v and v.isdecimal() else None
    return {k: v for k, v in out.items() if v}


def _docx_styles(raw: bytes) -> list[tuple]:
    styles = _xml(_package(raw).read("word/styles.xml")).iter(_W + "style")
    out = []
    for pos, s in enumerate(styles):
        own = (pos, _value(s, "styleId"), _value(_word(s, "basedOn")), _value(s, "type"), (_value(s, "default") or "") in ("1", "true", "on"))
        out += [(*own, k, v) for k, v in _properties(s).items()] or [(*own, None, None)]
    return out


def docx_styles(files: DataFrame) -> DataFrame:
    """(path, pos, style_id, based_on, type, is_default, name, value, error): the styles of Word files and what they say, a row a property (one with nulls without any)."""
    return _rows(files, "pos int, style_id string, based_on string, type string, is_default boolean, name string, value string", _docx_styles, "path", "content")


def _digests(raw: bytes) -> list[tuple]:
    z = _package(raw)
    return [(i.filename, i.file_size, hashlib.sha256(z.read(i)).hexdigest()) for i in z.infolist() if not i.is_dir()]


def part_digests(files: DataFrame) -> DataFrame:
    """(path, part, size, sha256, error): the parts of packages (path, content)."""
    return _rows(files, "part string, size long, sha256 string", _digests, "path", "content")


def changed_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, part, change): parts of packages that were ``added``, ``removed`` or ``changed`` from one ``part_digests`` to another.

    Files that are on one side only have all of their parts added or removed; of parts that repeat the greatest digest counts.
    """
    one = lambda d, name: d.where("part is not null").groupBy("path", "part").agg(F.max("sha256").alias(name))
    both = one(before, "was").join(one(after, "now"), ["path", "part"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("path", "part", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))
