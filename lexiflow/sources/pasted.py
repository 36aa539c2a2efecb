"""Pasted material as blocks: plain text and Markdown, HTML, pictures; limits, and blocks back to text and HTML.

Scale: one document a row, in Arrow batches; limits bound what a row may hold.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.documents import PROFILES, Block, block_text, numbered_captions, parsed
from lexiflow.operators.passes import _mapped

# Limits of pasted text, of HTML, and of a document.
TEXT_MOST, HTML_MOST, TAGS_MOST, NODES_MOST, DEPTH_MOST = 200_000, 32 << 20, 30_000, 15_000, 80
BLOCKS_MOST, ROWS_MOST, COLUMNS_MOST, IMAGES_MOST, IMAGE_MOST, PIXELS_MOST, ALL_PIXELS_MOST = 3000, 1000, 30, 50, 20 << 20, 30_000_000, 40_000_000
# Elements that part text, and those that are left out.
PARTS = frozenset("p div section article main header footer blockquote pre ul ol figure".split())
LEFT_OUT = frozenset("script style iframe object embed svg math video audio canvas form input button select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Refused(ValueError):
    """Why material is not taken."""


def picture_size(url: str) -> tuple[int, int, int]:
    """(width, height, bytes) of a PNG or JPEG in a data URL, from its header."""
    m = re.fullmatch("data:image/(png|jpeg);base64,([A-Za-z0-9+/]*={0,2})", url or "")
    if not m or len(m[2]) > -(-IMAGE_MOST // 3) * 4:
        raise Refused("no PNG or JPEG of up to 20 MB")
    try:
        raw = base64.b64decode(m[2], validate=True)
    except binascii.Error as e:
        raise Refused("the picture is damaged") from e
    size = (0, 0)
    if m[1] == "png" and len(raw) >= 33 and raw[:16] == b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR":
        size = int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    elif m[1] == "jpeg" and raw[:2] == b"\xff\xd8":
        size = _jpeg_size(raw)
    if not size[0] or not size[1] or size[0] * size[1] > PIXELS_MOST:
        raise Refused("the picture is damaged or has more than 30 megapixels")
    return (*size, len(raw))


def _jpeg_size(raw: bytes) -> tuple[int, int]:
    """From the first frame header; (0, 0) without one."""
    at = 2
    while at + 4 < len(raw) and raw[at] == 0xFF:
        while raw[at] == 0xFF and at + 1 < len(raw):
            at += 1
        marker, at = raw[at], at + 1
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(raw[at : at + 2], "big")
        if marker in (0xDA, 0xD9) or size < 2 or at + size > len(raw):
            break
        if marker in (0xC0, 0xC1, 0xC2) and size >= 8:
            return int.from_bytes(raw[at + 5 : at + 7], "big"), int.from_bytes(raw[at + 3 : at + 5], "big")
        at += size
    return 0, 0


def picture(url: str, alt: str | None) -> Block:
    """An image block, or one that says that its picture is missing."""
    try:
        picture_size(url)
    except Refused:
        return Block("imageMissing", title=alt or "picture")
    return Block("image", title=alt or "picture", raw=url)


def markdown_blocks(text: str) -> list[Block]:
    """Headings by ``#``, pictures, tables by ``|``, and what is between them as a document's blocks."""
    if len(text) > TEXT_MOST:
        raise Refused("more than 200,000 letters")
    lines = re.sub("\r\n?", "\n", text).split("\n")
    cells = lambda x: [c.strip() for c in re.sub("^\\||\\|$", "", x.strip()).split("|")]
    out: list[Block] = []
    rest: list[str] = []

    def flush() -> None:
        out.extend(parsed("\n".join(rest)))
        rest.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if m := re.fullmatch("(#{1,6})\\s+(.+)", line):
            flush()
            out.append(Block("heading", "section", len(m[1]), title=m[2]))
        elif m := re.fullmatch("\\s*!\\[([^\\]]*)\\]\\(([^)]+)\\)\\s*", line):
            flush()
            out.append(picture(m[2], m[1]))
        elif "|" in line and i < len(lines) and re.match("\\s*\\|?\\s*:?-{3,}", lines[i]):
            flush()
            rows, i = [cells(line)], i + 1
            while i < len(lines) and "|" in lines[i]:
                rows.append(cells(lines[i]))
                i += 1
            if any(len(r) != len(rows[0]) for r in rows):
                raise Refused("a table's rows differ in length")
            out.append(Block("table", lines=["\t".join(r) for r in rows]))
        else:
            rest.append(line)
    flush()
    return out


@dataclass
class _Element:
    tag: str
    attributes: dict[str, str | None]
    children: list = field(default_factory=list)


class _Tree(HTMLParser):
    """Elements and texts of HTML, as deep and as many as the limits allow."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]
        self.count = 0

    def handle_starttag(self, tag: str, attributes) -> None:
        self.count += 1
        if self.count > NODES_MOST or len(self.open) > DEPTH_MOST:
            raise Refused("the HTML is too large or too deep")
        if tag == "li":
            self._end("li", ("ul", "ol"))
        elif tag in ("p", *PARTS):
            self._end("p", tuple(PARTS - {"p"}))
        elif tag in ("td", "th", "tr"):
            self._end("td", ("table",))
            self._end("th", ("table",))
            if tag == "tr":
                self._end("tr", ("table",))
        e = _Element(tag, dict(attributes))
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def _end(self, tag: str, scope: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in scope:
                return

    def handle_endtag(self, tag: str) -> None:
        k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
        if k:
            del self.open[k:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _inner(e: _Element | str, skip: tuple[str, ...] = ()) -> str:
    """The text of an element, links with their address."""
    if isinstance(e, str):
        return e
    if e.tag in LEFT_OUT or e.tag in skip:
        return ""
    if e.tag == "br":
        return "\n"
    text = "".join(_inner(c, skip) for c in e.children)
    return text + _address(e, text) + ("\n" if e.tag in ("p", "div", "li", "pre") else "")


def _address(e: _Element, text: str) -> str:
    url = e.attributes.get("href") or "" if e.tag == "a" else ""
    return f" ({url})" if re.match("https?://", url, re.I) and url != text.strip() else ""


def list_numbers(e: _Element) -> list[int]:
    """The number of each item of an ordered list, by ``start``, ``value`` and ``reversed``."""
    items = [c for c in e.children if isinstance(c, _Element) and c.tag == "li"]
    step = -1 if "reversed" in e.attributes else 1
    whole = lambda v: int(v) if re.fullmatch("\\s*[+-]?[0-9]{1,15}\\s*", v or "") else None
    n = whole(e.attributes["start"]) if "start" in e.attributes else len(items) if step < 0 else 1
    out = []
    for item in items:
        n = whole(item.attributes["value"]) if "value" in item.attributes else n
        if n is None:
            raise Refused("a list item's number is no number")
        out.append(n)
        n += step
    return out


def html_blocks(html: str) -> list[Block]:
    """Headings, paragraphs, list items, tables and pictures of HTML, in order."""
    if len(html) > HTML_MOST or html.count("<") > TAGS_MOST:
        raise Refused("the HTML is too large")
    tree = _Tree()
    tree.feed(html)
    tree.close()
    out: list[Block] = []
    pending: list[str] = []

    def flush() -> None:
        text = re.sub("[ \t]+", " ", "".join(pending)).strip()
        pending.clear()
        if text:
            out.append(Block("paragraph", text=text))

    def visit(e: _Element | str, number: int | None = None) -> None:
        if isinstance(e, str):
            pending.append(e)
        elif e.tag in LEFT_OUT:
            return
        elif e.tag == "br":
            pending.append("\n")
        elif e.tag == "img":
            flush()
            out.append(picture(e.attributes.get("src") or "", e.attributes.get("alt")))
        elif e.tag == "table":
            flush()
            out.extend(_table(e))
        elif e.tag == "figcaption":
            flush()
            out.append(Block("caption", "figure", title=_inner(e).strip()))
        elif re.fullmatch("h[1-6]", e.tag):
            flush()
            out.append(Block("heading", "section", int(e.tag[1]), title=_inner(e).strip()))
        elif e.tag == "li":
            flush()
            text = "".join(_inner(c, ("ul", "ol")) for c in e.children).strip()
            if text:
                out.append(Block("list", lines=[f"{number}. {text}" if number is not None else f"• {text}"]))
            for c in e.children:
                if isinstance(c, _Element) and c.tag in ("ul", "ol"):
                    visit(c)
        else:
            part = e.tag in PARTS
            if part:
                flush()
            numbers: Iterator[int] = iter(list_numbers(e)) if e.tag == "ol" else iter(())
            for c in e.children:
                visit(c, next(numbers, None) if isinstance(c, _Element) and c.tag == "li" else None)
            pending.append(_address(e, _inner(_Element("", {}, e.children))))
            if part:
                flush()

    visit(tree.root)
    flush()
    return out


def _table(e: _Element) -> list[Block]:
    """A table's caption and its cells, those that span laid out over the places they cover."""
    found = []

    def walk(x: _Element) -> None:
        for c in (c for c in x.children if isinstance(c, _Element)):
            if c.tag == "tr":
                found.append([d for d in c.children if isinstance(d, _Element) and d.tag in ("td", "th")])
            elif c.tag in ("thead", "tbody", "tfoot"):
                walk(c)

    walk(e)
    span = lambda c, k: max(1, min(1000, int(v))) if (v := c.attributes.get(k) or "").isdigit() else 1
    taken: dict[tuple[int, int], str] = {}
    for r, cells in enumerate(found):
        column = 0
        for c in cells:
            while (r, column) in taken:
                column += 1
            text = re.sub("\\s+", " ", _inner(c)).strip()
            for dr in range(min(span(c, "rowspan"), len(found) - r)):
                for dc in range(min(span(c, "colspan"), COLUMNS_MOST + 1)):
                    taken[r + dr, column + dc] = "" if dr or dc else text
    width = max((c for _, c in taken), default=-1) + 1
    named = next((c for c in e.children if isinstance(c, _Element) and c.tag == "caption"), None)
    out = [Block("caption", "table", title=_inner(named).strip())] if named else []
    return out + ([Block("table", lines=["\t".join(taken.get((r, c), "") for c in range(width)) for r in range(len(found))])] if width else [])


# Limits, and blocks as text.


def over_limits(blocks: list[Block]) -> list[str]:
    """What of a document is beyond the limits: ``blocks``, ``text``, ``table``, ``image``."""
    tables = [[x.split("\t") for x in b.lines] for b in blocks if b.type == "table"]
    images = [picture_size(b.raw) for b in blocks if b.type == "image"]
    checks = {
        "blocks": len(blocks) > BLOCKS_MOST,
        "text": len(text_of(blocks)) > TEXT_MOST,
        "table": any(len(t) > ROWS_MOST or any(len(r) > COLUMNS_MOST or len(r) != len(t[0]) for r in t) for t in tables),
        "image": len(images) > IMAGES_MOST or sum(x[2] for x in images) > IMAGE_MOST or sum(w * h for w, h, _ in images) > ALL_PIXELS_MOST or any(b.type == "imageMissing" for b in blocks),
    }
    return [k for k, over in checks.items() if over]


def _line(b: Block) -> str:
    if b.type in ("image", "imageMissing"):
        return f"[{b.title}]"
    if b.type == "caption":
        name = b.prefix or b.kind.title()
        return f"{name} {b.number}".strip() + (f". {b.title}" if b.title else "")
    return b.title if b.type == "heading" else block_text(b, PROFILES["academic-report"])


def text_of(blocks: list[Block]) -> str:
    return "\n\n".join(map(_line, blocks))


def html_of(blocks: list[Block]) -> str:
    """Blocks as HTML that can be pasted again; a missing picture stays visible."""
    broken = lambda t: escape(t).replace("\n", "<br>")
    out = []
    for b in blocks:
        if b.type == "heading":
            level = min(6, max(1, b.level or 1))
            out.append(f"<h{level}>{broken(b.title)}</h{level}>")
        elif b.type == "caption":
            out.append(f"<p><em>{broken(_line(b))}</em></p>")
        elif b.type == "table":
            rows = [x.split("\t") for x in b.lines]
            cell = lambda k, c: f"<{'td' if k else 'th'}>{escape(c)}</{'td' if k else 'th'}>"
            out.append("<table>" + "".join(f"<tr>{''.join(cell(k, c) for c in r)}</tr>" for k, r in enumerate(rows)) + "</table>")
        elif b.type == "list":
            ordered = all(re.match("[0-9]+[.)]\\s", x) for x in b.lines)
            start = re.match("[0-9]+", b.lines[0])[0] if ordered else ""
            items = "".join(f"<li>{escape(re.sub('^(?:[-*•▪◦]|[0-9]+[.)])\\s+', '', x))}</li>" for x in b.lines)
            out.append(f'<ol start="{start}">{items}</ol>' if ordered else f"<ul>{items}</ul>")
        elif b.type == "image":
            out.append(f'<p><img src="{escape(b.raw)}" alt="{escape(b.title)}"></p>')
        elif b.type == "imageMissing":
            out.append(f"<p>[{escape(b.title)}]</p>")
        elif b.text:
            out.append(f"<p>{broken(b.text)}</p>")
    return '<meta charset="utf-8"><div>' + "\n".join(out) + "</div>"


# Colours by name, lengths, and other values that a table's style may have.
COLOURS = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "blue": "#0000ff", "green": "#008000", "gray": "#808080", "grey": "#808080", "silver": "#c0c0c0",
    "navy": "#000080", "yellow": "#ffff00", "transparent": "transparent",
}
LENGTH = "(?:0|[0-9]+(?:\\.[0-9]+)?(?:pt|px|cm|mm|in|%))"


def plain_colour(value: str | None) -> str | None:
    """A colour as #rrggbb, or None for what isn't one."""
    s = (value or "").strip().lower()
    if s in COLOURS or re.fullmatch("#[0-9a-f]{6}", s):
        return COLOURS.get(s, s)
    if re.fullmatch("#[0-9a-f]{3}", s):
        return "#" + "".join(c * 2 for c in s[1:])
    m = re.fullmatch("rgb\\(\\s*([0-9]+)[, ]+\\s*([0-9]+)[, ]+\\s*([0-9]+)\\s*\\)", s)
    return "#" + "".join(f"{int(x):02x}" for x in m.groups()) if m and all(int(x) <= 255 for x in m.groups()) else None


def plain_length(value: str | None) -> str | None:
    s = (value or "").strip().lower()
    return s if re.fullmatch(LENGTH, s) and float(re.match("[0-9.]+", s)[0]) <= 30_000 else None


# Tables.

BLOCKS = "doc_id long, pos int, type string, level int, text string, error string"


def _safe(read, text: str) -> tuple[list[Block], str | None]:
    try:
        return read(text), None
    except Refused as e:
        return [], str(e)


def _rows(read):
    def rows(i: int | None, t: str) -> list[tuple]:
        blocks, error = _safe(read, t)
        return [(i, None, None, None, None, error)] if error else [(i, k, b.type, b.level, _line(b), None) for k, b in enumerate(blocks)]

    return rows


def pasted_blocks(docs: DataFrame, html: bool = False) -> DataFrame:
    """The blocks (``BLOCKS``) of each document (doc_id, text) as Markdown or HTML; a refused one has a row with the reason."""
    return _mapped(docs, BLOCKS, _rows(html_blocks if html else markdown_blocks))


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, blocks, same, over): how many blocks each document has, whether they come back from HTML in the same words, and which limits it breaks."""

    def rows(i: int | None, t: str) -> list[tuple]:
        blocks = numbered_captions(parsed(t))[0]
        again, _ = _safe(html_blocks, html_of(blocks))
        words = lambda bs: re.findall("[^\\W_]+", " ".join(map(_line, bs)))
        return [(i, len(blocks), words(blocks) == words(again), ",".join(over_limits(blocks)))]

    return _mapped(docs, "doc_id long, blocks int, same boolean, over string", rows)


def page_blocks(pages: DataFrame) -> DataFrame:
    """The blocks of web pages (page_id, html)."""
    named = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return pasted_blocks(named, html=True).withColumnRenamed("doc_id", "page_id")
