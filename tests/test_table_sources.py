"""Cells, styles and digests of files."""

import io
import zipfile

from lexiflow.operators import styles, tables
from lexiflow.sources import tables as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(document="", style="", **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{document}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{style}</w:styles>")
        for name, text in more.items():
            z.writestr(name, text)
    return out.getvalue()


def cell(text, span="", merge="", style=""):
    pr = (f'<w:gridSpan w:val="{span}"/>' if span else "") + merge
    return f'<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>'


def files(spark, *content):
    return spark.createDataFrame([(f"f{k}", c) for k, c in enumerate(content)], "path string, content binary")


def test_html_tables_on_their_grid(spark):
    html = (
        "<p>x</p><table><thead><tr><th colspan=2>A &amp; B<th rowspan='2'>tall</thead><tr><td>one<br> two <script>no</script><td><p>p</p><p>q</p></tr></table>"
        "<table><tr><td rowspan=0>all</td><td>x</td></tr><tr><td>y</td></tr></table><table><tr><td>a</td></tr><tr><td colspan=x>b</td></tr></table>"
    )
    pages = spark.createDataFrame([(1, html), (2, "<table><tr><td><table></table></td></tr></table>"), (3, None), (4, "no table")], "page_id long, html string")
    cells = S.html_cells(pages)
    assert {(r.page_id, r.error) for r in cells.collect() if r.error or r.page_id > 1} == {(2, "ValueError")}
    placed = tables.placed(cells.where("error is null"), ["page_id", "table"]).orderBy("table", "row", "at").collect()
    assert [(r.table, r.row, r.column, r.col_span, r.row_span, r.text, r.problem) for r in placed] == [
        (0, 0, 0, 2, 1, "A & B", None), (0, 0, 2, 1, 2, "tall", None), (0, 1, 0, 1, 1, "one\ntwo", None), (0, 1, 1, 1, 1, "p\nq", None),
        (1, 0, 0, 1, 2, "all", None), (1, 0, 1, 1, 1, "x", None), (1, 1, 1, 1, 1, "y", None), (2, 0, None, 1, 1, "a", "overlap"), (2, 1, None, -1, 1, "b", "overlap"),
    ]


def test_word_tables_with_their_styles(spark):
    rows = f'<w:tbl><w:tr>{cell("head", "2", style="own")}{cell("side", merge="""<w:vMerge w:val="restart"/>""")}</w:tr><w:tr>{cell("a")}{cell("b")}{cell("", merge="<w:vMerge/>")}</w:tr></w:tbl>'
    style = (
        '<w:style w:type="paragraph" w:styleId="base" w:default="1"><w:rPr><w:sz w:val="21"/><w:color w:val="ff0000"/></w:rPr></w:style>'
        '<w:style w:type="paragraph" w:styleId="own"><w:basedOn w:val="base"/><w:pPr><w:jc w:val="both"/><w:spacing w:before="240"/></w:pPr><w:rPr><w:b/><w:i w:val="0"/></w:rPr></w:style>'
    )
    nested = f"<w:tbl><w:tr><w:tc><w:tbl><w:tr>{cell('x')}</w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    f = files(spark, package(rows, style), package(nested), b"no package", None)
    cells = S.docx_cells(f)
    assert {(r.path, r.error) for r in cells.where("error is not null").collect()} == {("f1", "ValueError"), ("f2", "BadZipFile")}
    got = tables.merged(cells.where("error is null"), ["path", "table"]).orderBy("row", "at").collect()
    assert [(r.row, r.column, r.col_span, r.row_span, r.text, r.problem) for r in got] == [(0, 0, 2, 1, "head", None), (0, 2, 1, 2, "side", None), (1, 0, 1, 1, "a", None), (1, 1, 1, 1, "b", None)]
    said = S.docx_styles(f).where("error is null")
    chains = styles.style_chains(said.select("path", "style_id", "based_on").distinct(), ("path",))
    found = styles.inherited(chains, said.select("path", "style_id", "name", "value"), ("path",)).where("style_id = 'own'").collect()
    assert {r.name: (r.value, r.origin) for r in found} == {
        "fontSize": ("10.5pt", "base"), "color": ("#FF0000", "base"), "textAlign": ("justify", "own"), "marginTop": ("12pt", "own"), "fontWeight": ("bold", "own"), "fontStyle": ("normal", "own")
    }


def test_one_changed_part_is_one_row(spark):
    a, b = files(spark, package("<w:p/>", more="x", gone="y"), package()), files(spark, package("<w:p/>", more="z", new="n"), package())
    got = {(r.path, r.part): r.change for r in S.changed_parts(S.part_digests(a), S.part_digests(b)).collect()}
    assert got == {("f0", "more"): "changed", ("f0", "gone"): "removed", ("f0", "new"): "added"}
    assert S.changed_parts(S.part_digests(a), S.part_digests(a)).count() == 0
