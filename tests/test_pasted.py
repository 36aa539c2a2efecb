"""Pasted material on literal cases."""

import base64
import struct

import pytest

from lexiflow.sources import pasted as C


def png(w, h):
    return "data:image/png;base64," + base64.b64encode(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0" + b"crc!").decode()


def kinds(blocks):
    return [(b.type, b.level, C._line(b)) for b in blocks]


def test_markdown():
    text = f"# Top\nSome words that end here.\n\n| A | B |\n|---|---|\n| 1 | 2 |\n![cat]({png(3, 4)})\n![dog](http://x/y.png)\n- one\n- two"
    assert kinds(C.markdown_blocks(text)) == [("heading", 1, "Top"), ("paragraph", 0, "Some words that end here."), ("table", 0, "A\tB\n1\t2"), ("image", 0, "[cat]"), ("imageMissing", 0, "[dog]"), ("list", 0, "- one\n- two")]
    assert C.markdown_blocks("") == []
    with pytest.raises(C.Refused):
        C.markdown_blocks("| A | B |\n|---|---|\n| 1 |")
    with pytest.raises(C.Refused):
        C.markdown_blocks("x" * 200_001)


def test_html():
    html = "<h2>T<br>t</h2>loose <b>text</b><script>x</script><p>See <a href='https://a.b'>here</a>.<ol start=3><li>c<ul><li>in</ul><li value=9>d<li>e</ol><ol reversed><li>x<li>y</ol>"
    assert [C._line(b) for b in C.html_blocks(html)] == ["T\nt", "loose text", "See here (https://a.b).", "3. c", "• in", "9. d", "10. e", "2. x", "1. y"]
    table = "<table><caption>Cap</caption><tr><th colspan=2>a<th>b<tr><td rowspan=2>1<td>2<td>3<tr><td>4<td>5</table>"
    assert [C._line(b) for b in C.html_blocks(table)] == ["Table. Cap", "a\t\tb\n1\t2\t3\n\t4\t5"]
    assert C.html_blocks("") == [] and C.html_blocks("<table></table>") == []
    for bad in ("<div>" * 81, "<br>" * 15_001, "<" * 30_001, "<ol start=x><li>a</ol>"):
        with pytest.raises(C.Refused):
            C.html_blocks(bad)


def test_pictures():
    assert C.picture_size(png(30, 40))[:2] == (30, 40)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\x00"
    assert C.picture_size("data:image/jpeg;base64," + base64.b64encode(jpeg + b"....").decode())[:2] == (9, 7)
    for bad in ("", "http://x", png(0, 4), png(10_000, 10_000), "data:image/png;base64,QUJD", "data:image/jpeg;base64,/9g="):
        with pytest.raises(C.Refused):
            C.picture_size(bad)


def test_limits_and_values():
    assert C.over_limits([C.Block("table", lines=["a\tb", "c"]), C.Block("imageMissing")]) == ["table", "image"] and C.over_limits([]) == []
    assert C.over_limits([C.Block("paragraph", text="x" * 200_001)] * 1) == ["text"] and C.over_limits([C.Block("paragraph")] * 3001) == ["blocks"]
    assert [C.plain_colour(x) for x in ("Red", "#abc", "rgb(1, 2,3)", "rgb(1,2,999)", "url(x)", None)] == ["#ff0000", "#aabbcc", "#010203", None, None, None]
    assert [C.plain_length(x) for x in ("12px", "40000px", "calc(1px)", None)] == ["12px", None, None, None]


def test_html_of_blocks_reads_back():
    text = "1. Top\n\nSome words & more <here>.\n\n- one\n- two\n\nA\tB\n1\t2\n\n3. c\n4. d"
    blocks = C.parsed(text)
    again = C.html_blocks(C.html_of(blocks))
    assert [C._line(b) for b in again if b.type != "list"] == [C._line(b) if b.type != "heading" else b.title for b in blocks if b.type != "list"]
    assert [C._line(b) for b in again if b.type == "list"] == ["• one", "• two", "3. c", "4. d"]


def test_tables(spark):
    docs = spark.createDataFrame([(1, "# A\n\nSome words here."), (2, None), (3, "x" * 200_001)], "doc_id long, text string")
    got = C.pasted_blocks(docs).collect()
    assert {(r.doc_id, r.type) for r in got if not r.error} == {(1, "heading"), (1, "paragraph")} and [r.doc_id for r in got if r.error] == [3]
    assert {r.doc_id: (r.same, r.over) for r in C.round_trip(docs).collect()} == {1: (True, ""), 2: (True, ""), 3: (True, "text")}
    pages = spark.createDataFrame([(1, "<p>a"), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.text) for r in C.page_blocks(pages).collect()] == [(1, "a")]
