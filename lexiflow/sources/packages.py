"""Word packages: reading blocks bound to their place, changing them in place, and writing new ones.

A package is refused, with a reason, rather than read in part: too large, too deep, with macros,
embedded programs, active fields or links to other programs. Paragraphs that hold more than plain
runs of one style are kept as they are. A changed package differs from its source only in the
bytes of the paragraphs that changed; without changes it is the source, byte for byte.

Scale: one file a row, in Arrow batches; a file is at most ``MAX_FILE`` bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from xml.parsers import expat
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import prose as P
from lexiflow.sources.readers import MAX_EXPANDED, MAX_FILE

MAX_ENTRIES, MAX_NODES, MAX_DEPTH = 2048, 250_000, 128
# Names, relations and fields of a package that run or load something.
UNSAFE_NAME = re.compile("(?:^|/)(?:embeddings|activeX|customUI)(?:/|$)|vbaProject|vbaData|_xmlsignatures", re.I)
UNSAFE_PATH = re.compile("(?:^|/)\\.\\.(?:/|$)|^/|\\\\")
UNSAFE_TEXT = re.compile(b"macroEnabled|vbaProject|activeX|oleObject", re.I)
UNSAFE_RELATION = re.compile("/(?:oleObject|package|aFChunk|attachedTemplate|control)$", re.I)
ACTIVE_FIELD = re.compile("(?:^|[^A-Za-z0-9_])(?:DDE|DDEAUTO|INCLUDETEXT|INCLUDEPICTURE|IMPORT|MACROBUTTON|DATABASE|LINK|AUTOTEXT)(?![A-Za-z0-9_])", re.I)
HEADING = re.compile("(?:heading|заголовок)\\s*([1-6])", re.I)
PLAIN_RUN = frozenset(("rPr", "t", "tab", "br", "cr"))


class Refused(ValueError):
    """Why a package is not read or written."""


@dataclass(slots=True)
class Node:
    """An element: its bytes are [start, end), those inside it [inner, inner_end); ``local`` is its name without a prefix."""

    name: str
    local: str
    attributes: dict[str, str]
    start: int
    inner: int = 0
    inner_end: int = 0
    end: int = 0
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children)


def scanned(raw: bytes) -> Node:
    """The element tree of XML with byte offsets; declarations, instructions, and what is too large or deep are refused."""
    parser, stack, roots, count = expat.ParserCreate(), [], [], 0

    def declared(*_) -> None:
        raise Refused("the XML holds declarations")

    def opened(name: str, attributes: dict[str, str]) -> None:
        nonlocal count
        count += 1
        if count > MAX_NODES or len(stack) > MAX_DEPTH:
            raise Refused("the XML is too large or too deep")
        node = Node(name, name.rpartition(":")[2], attributes, parser.CurrentByteIndex)
        node.inner = raw.index(b">", _tag_end(raw, node.start)) + 1
        (stack[-1].children if stack else roots).append(node)
        stack.append(node)

    def closed(_: str) -> None:
        node = stack.pop()
        at = parser.CurrentByteIndex
        if raw[node.inner - 2 : node.inner] == b"/>":
            node.inner_end = node.end = node.inner
        else:
            node.inner_end, node.end = at, raw.index(b">", at) + 1

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ProcessingInstructionHandler = declared
    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise Refused("the XML is damaged") from e
    return roots[0]


_QUOTED = re.compile(b"[^>\"']*(?:\"[^\"]*\"|'[^']*')?")


def _tag_end(raw: bytes, at: int) -> int:
    """Where the tag that begins at ``at`` has its last quoted value behind it."""
    end = raw.index(b">", at)
    if raw.find(b"'", at, end) < 0 and raw.count(b'"', at, end) % 2 == 0:  # one kind of quotes, all closed
        return end
    while True:
        end = _QUOTED.match(raw, at).end()
        if end == at or raw[end : end + 1] == b">":
            return end
        at = end


def _text(raw: bytes, node: Node) -> str:
    """The text of a paragraph's runs, with tabs and breaks."""
    return "".join(_MARKS.get(n.local, "") if n.local != "t" else _plain(raw[n.inner : n.inner_end].decode()) for n in node.walk())


_MARKS = {"tab": "\t", "br": "\n", "cr": "\n"}


def _plain(text: str) -> str:
    if "<" in text:
        text = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: escape(m[1]), text)
    return unescape(text, {"&quot;": '"', "&apos;": "'"}) if "&" in text else text


#: Parts of up to so many bytes are the same in many packages (settings, styles, relations), so what the last of them hold is told once.
SMALL = 1 << 16
_FIELDS = frozenset(("fldChar", "fldSimple"))
_TOLD = _FIELDS | {"altChunk", "object", "instrText"}


def _checked(raw: bytes, loads: bool) -> Node:
    """The element tree of a part without anything active; ``loads``: a part of relations."""
    tree = scanned(raw)
    if UNSAFE_TEXT.search(raw):
        raise Refused("the package holds active content")
    fields, chunks = [], []
    for n in tree.walk():
        if n.local not in _TOLD:
            continue
        if n.local in ("altChunk", "object") or n.local == "fldSimple" and ACTIVE_FIELD.search(" ".join(n.attributes.values())):
            raise Refused("the package holds active fields or objects")
        if n.local in _FIELDS:
            fields.append("".join(chunks))
            chunks = []
        else:
            chunks.append(unescape(raw[n.inner : n.inner_end].decode()))
    if any(ACTIVE_FIELD.search(f) for f in [*fields, "".join(chunks)]):
        raise Refused("the package holds active fields or objects")
    for n in tree.children if loads else ():
        kind, target, mode = (n.attributes.get(k, "") for k in ("Type", "Target", "TargetMode"))
        web = kind.endswith("/hyperlink") and re.match("(?:https?:|mailto:)", target, re.I)
        if UNSAFE_RELATION.search(kind) or mode.lower() == "external" and not web:
            raise Refused("the package loads other files")
    return tree


@lru_cache(maxsize=64)
def _passed(raw: bytes, loads: bool) -> None:
    """Refuses a small part that holds something active, as ``_checked`` does."""
    _checked(raw, loads)


@lru_cache(maxsize=64)
def _levels(styles: bytes) -> dict[str, int]:
    """Levels of the styles of a part that are headings by name."""
    out = {}
    for s in (n for n in scanned(styles).children if n.local == "style"):
        names = [v for n in s.children if n.local == "name" for k, v in n.attributes.items() if k.endswith("val")]
        key = next((v for k, v in s.attributes.items() if k.endswith("styleId")), "")
        if m := HEADING.fullmatch((names or [key])[0]):
            out[key] = int(m[1])
    return out


class Package:
    """A checked Word package."""

    def __init__(self, raw: bytes) -> None:
        if not raw or len(raw) > MAX_FILE:
            raise Refused("the file is empty or too large")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile as e:
            raise Refused("the file is no package") from e
        entries = self.zip.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_EXPANDED:
            raise Refused("the package holds too much")
        for e in entries:
            if UNSAFE_PATH.search(e.filename) or UNSAFE_NAME.search(e.filename):
                raise Refused("the package holds unsafe parts")
            if m := re.search(r"\.(xml|rels)$", e.filename, re.I):
                part, loads = self.zip.read(e), m[1].lower() == "rels"
                if e.filename == "word/document.xml":
                    self.tree = _checked(part, loads)
                elif len(part) <= SMALL:
                    _passed(part, loads)
                else:
                    _checked(part, loads)
        if "word/document.xml" not in self.zip.namelist():
            raise Refused("the package holds no document")
        self.raw, self.xml = raw, self.zip.read("word/document.xml")

    @cached_property
    def body(self) -> list[Node]:
        root = self.tree
        body = next((n for n in root.children if n.local == "body"), None)
        if root.local != "document" or body is None:
            raise Refused("the package holds no document")
        return body.children

    @cached_property
    def headings(self) -> dict[str, int]:
        """Levels of the styles that are headings by name."""
        if "word/styles.xml" not in self.zip.namelist():
            return {}
        raw = self.zip.read("word/styles.xml")
        return _levels(raw) if len(raw) <= SMALL else _levels.__wrapped__(raw)

    def editable(self, node: Node) -> bool:
        """Whether a paragraph is nothing but text runs of one style, without breaks and tabs."""
        runs = [n for n in node.children if n.local == "r"]
        if node.local != "p" or len(runs) + sum(n.local == "pPr" for n in node.children) < len(node.children):
            return False
        if any(c.local not in PLAIN_RUN or c.local in ("tab", "br", "cr") for r in runs for c in r.children):
            return False
        return len({b"".join(self.xml[c.start : c.end] for c in r.children if c.local == "rPr") for r in runs}) <= 1

    def blocks(self) -> list[tuple[int, str, int, str, bool]]:
        """(child, type, level, text, editable) of the body's children but its settings; what isn't plain text is a note."""
        out = []
        for k, n in enumerate(self.body):
            if n.local == "sectPr":
                continue
            text, able = _text(self.xml, n), self.editable(n)
            if n.local == "tbl":
                rows = [[" ".join(_text(self.xml, p) for p in c.walk() if p.local == "p") for c in r.children if c.local == "tc"] for r in n.children if r.local == "tr"]
                out.append((k, "table", 0, "\n".join("\t".join(r) for r in rows), False))
                continue
            style = next((v for c in n.children if c.local == "pPr" for s in c.children if s.local == "pStyle" for a, v in s.attributes.items() if a.endswith("val")), "")
            level = self.headings.get(style) or (int(m[1]) if (m := HEADING.fullmatch(style)) else 0)
            kind = "note" if not text or not able else "heading" if level else "paragraph"
            out.append((k, kind, level, text, able))
        return out

    def changed(self, texts: dict[int, str]) -> bytes:
        """The package with new texts of paragraphs, by child; the source itself if none differs."""
        edits, before, after = [], [], []
        for k, n in enumerate(self.body):
            if n.local != "p":
                continue
            old = _text(self.xml, n)
            new = texts.get(k, old)
            before.append(old)
            after.append(new)
            if new == old:
                continue
            if not self.editable(n) or re.search("[\x00-\x08\x0b\x0c\x0e-\x1f]", new):
                raise Refused(f"paragraph {k} can't be changed")
            if not P.compare(old, new).ok:
                raise Refused(f"paragraph {k} would change facts or references")
            edits.append((n.start, n.end, self._paragraph(n, new)))
        if any(k >= len(self.body) or self.body[k].local != "p" for k in texts):
            raise Refused("there is no such paragraph")
        if not edits:
            return self.raw
        if not P.compare("\n\n".join(before), "\n\n".join(after)).ok:
            raise Refused("the document would change facts or references")
        xml = self.xml
        for start, end, new in reversed(edits):
            xml = xml[:start] + new + xml[end:]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for e in self.zip.infolist():
                new = zipfile.ZipInfo(e.filename, e.date_time)
                new.compress_type, new.external_attr = e.compress_type, e.external_attr
                z.writestr(new, xml if e.filename == "word/document.xml" else self.zip.read(e))
        return out.getvalue()

    def _paragraph(self, n: Node, text: str) -> bytes:
        """A paragraph's bytes with its own properties and its first run's style."""
        prefix = n.name.partition(":")[0] + ":" if ":" in n.name else ""
        cut = lambda x: self.xml[x.start : x.end]
        opened = lambda x: re.sub(b"/>$", b">", self.xml[x.start : x.inner])
        run = next((c for c in n.children if c.local == "r"), None)
        own = b"".join(cut(c) for c in n.children if c.local == "pPr")
        style = b"".join(cut(c) for c in run.children if c.local == "rPr") if run else b""
        name = run.name if run else f"{prefix}r"
        parts = {"\t": f"<{prefix}tab/>", "\n": f"<{prefix}br/>"}
        runs = "".join(parts.get(x) or f'<{prefix}t xml:space="preserve">{escape(x)}</{prefix}t>' for x in re.split("([\t\n])", text) if x)
        return opened(n) + own + (opened(run) if run else f"<{name}>".encode()) + style + runs.encode() + f"</{name}></{n.name}>".encode()


# Writing.

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Width of the text on the page, and of a column at least, in twentieths of a point.
TEXT_WIDTH, COLUMN = 9355, 640


def column_widths(rows: list[list[str]], total: int = TEXT_WIDTH) -> list[int]:
    """Widths that sum to ``total``: a floor for each column and the rest by its longest cell, within limits; the last takes what is left over."""
    weights = [max(7, min(38, max(len(r[k]) if k < len(r) else 0 for r in rows))) for k in range(max(1, max(map(len, rows), default=1)))]
    least = max(1, min(COLUMN, total // len(weights)))
    rest = max(0, total - least * len(weights))
    out = [least + rest * w // sum(weights) for w in weights]
    out[-1] += total - sum(out)
    return out


def _p(text: str, style: str = "", extra: str = "") -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def _table(rows: list[list[str]]) -> str:
    widths = column_widths(rows)
    cell = lambda x, w: f'<w:tc><w:tcPr><w:tcW w:w="{w}" w:type="dxa"/></w:tcPr>{_p(x, extra=_CENTRE if re.fullmatch("[0-9.,% -]+", x) else "")}</w:tc>'
    line = lambda r, head: f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if head else ''}{''.join(cell(r[k] if k < len(r) else '', w) for k, w in enumerate(widths))}</w:tr>"
    edges = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    grid = "".join(f'<w:gridCol w:w="{w}"/>' for w in widths)
    return f"<w:tbl><w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{''.join(line(r, k == 0) for k, r in enumerate(rows))}</w:tbl>"


_CENTRE = '<w:jc w:val="center"/>'
_BREAK = "<w:pageBreakBefore/>"
_STYLES = f'<w:styles xmlns:w="{W}">' + "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:keepNext/><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr><w:b/></w:rPr></w:style>' for k in range(1, 7)) + "</w:styles>"
_FOOTER = f'<w:ftr xmlns:w="{W}"><w:p><w:pPr>{_CENTRE}</w:pPr><w:fldSimple w:instr=" PAGE "/></w:p></w:ftr>'
_OFFICE, _WORD = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.wordprocessingml"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def packed(blocks: list[dict]) -> bytes:
    """A Word package of blocks (type, level, text): a top heading begins a page unless it is the first, tables that meet are kept apart."""
    body, last = [], ""
    for k, b in enumerate(blocks):
        kind, text, level = b["type"], b["text"] or "", min(6, max(1, b.get("level") or 1))
        if kind == "heading":
            body.append(_p(text, f"Heading{level}", _BREAK if level == 1 and k else ""))
        elif kind == "table":
            body += ["<w:p/>"] * (last == "table") + [_table([line.split("\t") for line in text.split("\n")])]
        else:
            body += [_p(line, extra=_CENTRE if kind == "caption" else "") for line in text.split("\n")]
        last = kind
    section = '<w:sectPr><w:footerReference w:type="default" r:id="rId2"/><w:pgSz w:w="11906" w:h="16838"/></w:sectPr>'
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/word/{n}.xml" ContentType="{_WORD}.{t}+xml"/>' for n, t in (("document", "document.main"), ("styles", "styles"), ("footer1", "footer"), ("settings", "settings"))) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{_RELATIONS}">' + "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/{t}" Target="{n}.xml"/>' for k, (t, n) in enumerate((("styles", "styles"), ("footer", "footer1"), ("settings", "settings")), 1)) + "</Relationships>",
        "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{_OFFICE}"><w:body>{"".join(body)}{section}</w:body></w:document>',
        "word/styles.xml": _STYLES, "word/footer1.xml": _FOOTER, "word/settings.xml": f'<w:settings xmlns:w="{W}"><w:updateFields w:val="true"/></w:settings>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + text)
    return out.getvalue()


# Tables.


def docx_blocks(files: DataFrame) -> DataFrame:
    """(path, child, type, level, text, editable, error) of Word files (path, content): a row a block, or one with the reason why a file is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, *b, None) for b in Package(raw or b"").blocks()]
                except Refused as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "child", "type", "level", "text", "editable", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, child int, type string, level int, text string, editable boolean, error string")


def docx_changed(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, content, error): Word files (path, content) with the paragraphs of ``texts`` (path, child, text) changed in place; all or none of a file's."""
    listed = texts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("child", "text"))).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, errors = [], []
            for raw, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    content.append(Package(raw or b"").changed(dict(new or ())))
                    errors.append(None)
                except Refused as e:
                    content.append(None)
                    errors.append(str(e))
            yield pa.record_batch([batch.column(0), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select("path", "content").join(listed, "path", "left").mapInArrow(run, "path string, content binary, error string")


def docx_files(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): a Word package of each document's ``blocks`` (key, pos, type, level, text), in order."""
    listed = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "type", "level", "text"))).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([packed(b) for b in batch.column(1).to_pylist()], pa.binary())], names=[key, "content"])

    return listed.mapInArrow(run, f"{key} {dict(blocks.dtypes)[key]}, content binary")
