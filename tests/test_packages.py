"""Word packages: written, read again, changed in place, refused."""

import io
import zipfile

import pytest

from lexiflow.sources import packages as K
from lexiflow.sources import readers

BLOCKS = [
    {"type": "heading", "level": 1, "text": "Intro & more"}, {"type": "paragraph", "text": "We sold 5 < 6 units."}, {"type": "table", "text": "A\tB\n1\t22"},
    {"type": "table", "text": "C"}, {"type": "heading", "level": 2, "text": "Next"}, {"type": "paragraph", "text": "Plain text stays."},
]


def rezipped(raw: bytes, changes: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w") as new:
        for name in dict.fromkeys([*old.namelist(), *changes]):
            new.writestr(name, changes.get(name) or old.read(name))
    return out.getvalue()


def with_body(xml: str) -> bytes:
    raw = K.packed(BLOCKS[:2])
    return rezipped(raw, {"word/document.xml": f'<w:document xmlns:w="{K.W}"><w:body>{xml}</w:body></w:document>'.encode()})


def test_written_packages_read_back():
    raw = K.packed(BLOCKS)
    got = [(kind, level, text) for _, kind, level, text, _ in K.Package(raw).blocks() if kind != "note"]
    assert got == [("heading", 1, "Intro & more"), ("paragraph", 0, "We sold 5 < 6 units."), ("table", 0, "A\tB\n1\t22"), ("table", 0, "C"), ("heading", 2, "Next"), ("paragraph", 0, "Plain text stays.")]
    assert raw == K.packed(BLOCKS) and K.Package(K.packed([])).blocks() == []
    assert sum(K.column_widths([["a", "b" * 50], ["c"]])) == K.TEXT_WIDTH and K.column_widths([[""] * 30], 60) == [2] * 30


def test_changes_touch_only_their_paragraph():
    raw = K.packed(BLOCKS)
    p = K.Package(raw)
    assert p.changed({}) is p.raw and p.changed({1: "We sold 5 < 6 units."}) is p.raw
    new = K.Package(p.changed({1: "They bought 5 < 6 units."}))
    assert new.blocks()[1][3] == "They bought 5 < 6 units." and [b for b in new.blocks() if b[0] != 1] == [b for b in p.blocks() if b[0] != 1]
    a, b = p.body[1], new.body[1]
    assert p.xml[: a.start] == new.xml[: b.start] and p.xml[a.end :] == new.xml[b.end :]
    for wrong in ({1: "We sold 7 units."}, {2: "x"}, {99: "x"}, {1: "5 < 6 \x01"}):
        with pytest.raises(K.Refused):
            p.changed(wrong)


def test_complex_paragraphs_are_notes():
    r = lambda t, style="": f"<w:r>{style}<w:t>{t}</w:t></w:r>"
    bold = "<w:rPr><w:b/></w:rPr>"
    raw = with_body(f"<w:p>{r('one')}{r('two', bold)}</w:p><w:p>{r('a', bold)}{r('&amp;b', bold)}</w:p><w:p><w:r><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p><w:p><w:hyperlink>{r('l')}</w:hyperlink></w:p><w:p/><w:sectPr/>")
    got = [(k, kind, text) for k, kind, _, text, _ in K.Package(raw).blocks()]
    assert got == [(0, "note", "onetwo"), (1, "paragraph", "a&b"), (2, "note", "x\ny"), (3, "note", "l"), (4, "note", "")]
    new = K.Package(K.Package(raw).changed({1: "c<d", 4: "was\tempty"}))
    assert [b[3] for b in new.blocks()] == ["onetwo", "c<d", "x\ny", "l", "was\tempty"] and b"<w:rPr><w:b/></w:rPr><w:t" in new.xml


@pytest.mark.parametrize(
    "changes",
    [
        {"word/vbaProject.bin": b"x"}, {"word/embeddings/a.bin": b"x"}, {"../evil.xml": b"<a/>"}, {"word/x.xml": b"<!DOCTYPE a><a/>"}, {"word/x.xml": b"<a><b></a>"},
        {"word/x.xml": b"<a>macroEnabled</a>"}, {"word/x.xml": b"<a><object/></a>"}, {"word/x.xml": b"<a><r><instrText>INCLUDE</instrText></r><r><instrText>TEXT f</instrText></r></a>"},
        {"word/x.xml": b"<a><fldSimple instr='DDE x'/></a>"}, {"word/_rels/x.rels": b"<R><r Type='http://x/image' Target='http://y' TargetMode='External'/></R>"},
        {"word/_rels/x.rels": b"<R><r Type='http://x/attachedTemplate' Target='t'/></R>"}, {"word/x.xml": b"<a>" * 200 + b"</a>" * 200}, {"word/document.xml": b"<w/>"},
    ],
)
def test_unsafe_packages_are_refused(changes):
    with pytest.raises(K.Refused):
        K.Package(rezipped(K.packed(BLOCKS), changes)).blocks()


def test_links_to_the_web_are_fine():
    K.Package(rezipped(K.packed(BLOCKS), {"word/_rels/x.rels": b"<R><r Type='http://x/hyperlink' Target='https://y' TargetMode='External'/></R>"}))
    for raw in (b"", b"no zip"):
        with pytest.raises(K.Refused):
            K.Package(raw)


def test_tables(spark):
    rows = [(1, k, b["type"], b.get("level", 0), b["text"]) for k, b in enumerate(BLOCKS)] + [(2, 0, "paragraph", 0, None)]
    files = K.docx_files(spark.createDataFrame(rows, "doc_id long, pos int, type string, level int, text string"))
    files = files.selectExpr("concat('f', doc_id) path", "content").union(spark.createDataFrame([("bad", bytearray(b"x")), ("none", None)], "path string, content binary"))
    got = K.docx_blocks(files).collect()
    assert {r.path for r in got if r.error} == {"bad", "none"} and len([r for r in got if r.path == "f1" and r.type != "note"]) == 6
    texts = spark.createDataFrame([("f1", 1, "They bought 5 < 6 units."), ("bad", 0, "x")], "path string, child int, text string")
    out = {r.path: r for r in K.docx_changed(files, texts).collect()}
    same = {r.path: bytes(r.content or b"") for r in files.collect()}
    assert out["bad"].error and bytes(out["f2"].content) == same["f2"] and K.Package(bytes(out["f1"].content)).blocks()[1][3] == "They bought 5 < 6 units."


def test_sheets_go_by_their_references():
    sheet = lambda rows: f"<worksheet><sheetData>{rows}</sheetData></worksheet>"
    parts = {
        "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="Two" r:id="b"/><sheet name="None" r:id="c"/><sheet name="One" r:id="a"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": '<R><r Id="a" Target="worksheets/sheet1.xml"/><r Id="b" Target="/xl/worksheets/sheet2.xml"/><r Id="c" Target="worksheets/sheet3.xml"/></R>',
        "xl/sharedStrings.xml": "<s><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></s>",
        "xl/styles.xml": '<s><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></s>',
        "xl/worksheets/sheet1.xml": sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>7</v></c><c r="C3" s="1"><v>44197</v></c></row>'),
        "xl/worksheets/sheet2.xml": sheet('<row><c t="inlineStr"><is><t>in</t></is></c><c t="b"><v>1</v></c><c s="2"><v>1.5</v></c></row>'),
        "xl/worksheets/sheet3.xml": sheet('<row r="1"><c r="A1" s="1"/></row>'),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    assert readers.xlsx_text(out.getvalue()) == "[Two]\nin\tTRUE\t12/31/99\n\n[One]\nshared\t\trich\n\t\t\n\t7\t1/1/21"


def test_files_in_one_scan(spark, tmp_path):
    for name, raw in {"a.txt": "тест".encode("cp1251"), "b.txt": b"\xef\xbb\xbfx", "c.pdf": b"%", "d.doc": b"x", "e.txt": b" \n", "f.docx": b"no zip", "g.docx": K.packed(BLOCKS)}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[-1]: (r.text, bool(r.error)) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("тест", False) and got["b.txt"] == ("x", False) and got["g.docx"][0].startswith("Intro & more")
    assert {k for k, (_, e) in got.items() if e} == {"c.pdf", "d.doc", "e.txt", "f.docx"}
