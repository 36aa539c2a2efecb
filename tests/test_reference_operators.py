"""The text operators on small literal tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import cleaning, report, scores, spans
from lexiflow.sources import readers


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").coalesce(1)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_language_counts_and_empty_texts(spark):
    got = rows(scores.scores(texts(spark, "Привет, мир. Ещё раз!", "Hello there. Again!", "", None, "12 34")))
    assert [got[i].language for i in range(5)] == ["ru", "en", "en", "en", "en"]
    assert [(got[i].n_words, got[i].n_sentences) for i in range(5)] == [(4, 2), (3, 2), (0, 0), (0, 0), (2, 1)]
    assert got[2].score == got[3].score == 0


def test_dashes_leave_number_ranges_alone(spark):
    got = rows(scores.scores(texts(spark, "From 2026–2030 it holds.", "a — b — c — d", "a - - b", "well-known")))
    assert [got[i].n_dashes for i in range(4)] == [0, 3, 2, 0]
    assert got[1].em_dash == 100 and got[0].em_dash == 0


def test_score_parts(spark):
    even = " ".join("one two three four five six." for _ in range(6))
    got = rows(scores.scores(texts(spark, even, "Moreover, a. However, b. Thus, c. Also, d.", "It is not merely good. not only this, but also that.", "This is possibly fine.")))
    assert got[0].burstiness == 100 and got[0].flatness == 100 and got[0].opener_repeat == 100
    assert got[1].discourse == 100 and got[1].cliche == 20
    assert got[2].antithesis == 90 and got[2].score >= 90
    assert got[3].hedge == 100


def test_metrics_and_status(spark):
    wide = report.metrics_wide(texts(spark, "the cat sat on the mat. " * 40, "short text", None))
    got = rows(wide)
    assert got[0].ngramRepeat == 1.0 and got[0].openerRepeat == 1.0 and got[0].sentenceCv == 0.0
    assert got[1].sentenceCv is None and got[2].discourseShare == 0.0
    tall = {(r.doc_id, r.metric_id): r.status for r in report.metrics_tall(wide).collect()}
    assert tall[0, "ngramRepeat"] == "overshoot" and tall[0, "sentenceCv"] == "low" and tall[1, "ngramRepeat"] == "unknown"
    counts = rows(report.status_counts(report.metrics_tall(wide)))
    assert sum(counts[0][k] for k in ("n_ok", "n_low", "n_high", "n_overshoot", "n_unknown")) == 13


CLEAN = [
    ("Механика. . электроника. . Новый раздел!!", "Механика, электроника. Новый раздел!"),
    ("a. . . b", "a… b"),
    ("one/rntwo", "one\n\ntwo"),
    ("first n n second", "first \n\n second".replace(" \n\n ", "\n\n")),
    ("see https://x.org/a?b=1,2. And  then ,ok", "see https://x.org/a?b=1,2. And then, ok"),
    ("слово\nпродолжение и кое-\nчто", "слово продолжение и кое-что"),
    ("zero​width\r\n\r\n\r\nline", "zerowidth\n\nline"),
    (None, ""),
]


def test_cleaning(spark):
    got = rows(cleaning.clean(texts(spark, *(a for a, _ in CLEAN))))
    assert [got[i].text for i in range(len(CLEAN))] == [b for _, b in CLEAN]
    again = rows(cleaning.clean(texts(spark, *(b for _, b in CLEAN))))
    assert [again[i].text for i in range(len(CLEAN))] == [b for _, b in CLEAN]


def test_adjacent_repeats(spark):
    long = "This paragraph is long enough to count."
    got = rows(cleaning.drop_adjacent(texts(spark, f"{long}\n\n{long.upper()}\n\nother\n\n{long}", "a\n\na", "", None)))
    assert got[0].text == f"{long}\n\nother\n\n{long}" and got[0].duplicates == 1
    assert (got[1].text, got[1].duplicates, got[2].text, got[3].duplicates) == ("a\n\na", 0, "", 0)


def test_typography(spark):
    got = rows(cleaning.typography(texts(spark, 'He said "yes"... don\'t', 'Он сказал "да" 5 - 7', None)))
    assert got[0].text == "He said “yes”… don’t" and (got[0].ellipsis, got[0].quotes) == (1, 2)
    assert got[1].text == "Он сказал «да» 5–7" and got[1].ranges == 1 and got[2].text == ""


def test_anchor_multisets(spark):
    a, b = texts(spark, "In 1999 we sold 12,5% [3]. https://A.org/x"), texts(spark, "In 1998 we sold 12,5% [3]. https://A.org/x")
    got = {(r.type, r.value): (r.lost, r.added) for r in spans.anchor_diff(a, b).collect()}
    assert got == {("number", "1999"): (1, 0), ("number", "1998"): (0, 1)}


def test_qualifiers(spark):
    pairs = spark.createDataFrame([(1, "only usually", "usually"), (2, "all cats can", "all dogs can")], "pair_id long, source string, candidate string")
    assert {r.pair_id: r.changed for r in spans.qualifiers_kept(pairs).collect()} == {1: ["limit"], 2: []}


def test_intervals(spark):
    ranges = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 21), (2, 1, 2)], "doc_id long, start long, end long")
    assert sorted(tuple(r) for r in spans.merge_ranges(ranges).select("doc_id", "start", "end").collect()) == [(1, 0, 8), (1, 8, 9), (1, 20, 21), (2, 1, 2)]
    edits = spark.createDataFrame([(1, 8, 10), (1, 9, 12), (3, 0, 1)], "doc_id long, start long, end long")
    assert sorted(tuple(r) for r in spans.outside_ranges(edits, ranges).collect()) == [(1, 9, 12), (3, 0, 1)]


def test_history_and_top(spark):
    history = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3, 4)] + [("b", 1.0)], "k string, value double")
    now = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 1.0)], "k string, id long, value double")
    got = spans.mid_rank(history, now, ["k"]).collect()
    assert [(r.id, r.median, r.share) for r in got] == [(1, 2.0, 0.4)]
    assert spans.keep_last(history, "k", [F.desc("value")], 2).count() == 3
    s = spans.sentence_table(texts(spark, "One two three. Four five. Six."))
    assert [r.pos for r in spans.worst(s.withColumn("score", F.col("words"))).collect()] == [0]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0], [-3.0], -1.0), ([], [], None), ([0.0], [1.0], None), ([1.0], [1.0, 2.0], None)])
def test_cosine(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(spans.cosine(F.col("a"), F.col("b"))).first()[0]
    assert got == want if want is not None else got != got


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'
    files = {
        "a.txt": "line\r\n\r\n\r\n\r\nend".encode(), "b.md": "привет".encode("cp1251"), "c.html": b"<script>x</script><p>one<p>two</p>", "d.rtf": b"{\\rtf1 A\\par B\\" + b"u1078?}",
        "e.docx": package({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hi</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p/></w:body></w:document>"}),
        "f.odt": package({"content.xml": "<d><h>Head</h><p>text</p></d>"}),
        "g.pptx": package({"ppt/slides/slide2.xml": "<s><t>two</t></s>", "ppt/slides/slide1.xml": "<s><t>one</t></s>"}),
        "h.epub": package({"b.xhtml": "<p>b</p>", "a.html": "<p>a</p>", "nav.xhtml": "<p>nav</p>"}),
        "i.xlsx": package({"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>x</t></si></s>", "xl/worksheets/sheet1.xml": sheet}),
        "j.xml": b"<b><title>T</title><p>P</p></b>", "k.doc": b"old", "l.docx": b"broken", "m.txt": b"  ",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    want = {"a.txt": "line\n\nend", "b.md": "привет", "c.html": "one\n\ntwo", "d.rtf": "A\nBж", "e.docx": "Hi\tthere", "f.odt": "Head\n\ntext", "g.pptx": "[Слайд 1]\none\n\n[Слайд 2]\ntwo", "h.epub": "a\n\nb", "i.xlsx": "[S]\nx\t5", "j.xml": "T\n\nP"}
    assert {k: got[k].text for k in want} == want and all(got[k].error is None for k in want)
    assert all(got[k].error for k in ("k.doc", "l.docx", "m.txt"))
