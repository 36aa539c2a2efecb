"""Segments, media and pieces of work on literal cases."""

from lexiflow.operators import layout as Y
from lexiflow.operators.documents import BUSINESS_SECTIONS, Block, parsed

PLAN = "Some words first of all.\n\n1. Executive Summary\n\nWe sell tables.\n\nFinancial Plan\n\n—\n\nA\tB\nx\t5\n\nAppendix A\n\nMore here now."


def test_segments_know_their_sections():
    got = [(s.heading.title if s.heading else None, len(s.blocks), Y.filled(s)) for s in Y.segmented(parsed(PLAN))]
    assert got == [(None, 1, True), ("Executive Summary", 1, True), ("Financial Plan", 2, True), ("", 1, True)]
    assert Y.section_of("резюме", BUSINESS_SECTIONS).title == "Executive Summary" and Y.section_of("Other", BUSINESS_SECTIONS) is None
    s = Y.Segment(None, [Block("paragraph", text="Operating cash flow is fine")])
    assert Y.covers(s, "Operating cash flow") and not Y.covers(s, "Revenue forecast model") and not Y.covers(s, "a")
    assert Y.segmented([]) == [] and not Y.filled(Y.Segment(None, [Block("paragraph", text="—")]))


def test_sections_are_inferred_from_names():
    assert Y.inferred_section("Our marketing plan and the sales plan for spring", BUSINESS_SECTIONS) == "Marketing and Sales Plan"
    assert Y.inferred_section("Nothing of the kind", BUSINESS_SECTIONS) is None and Y.inferred_section("", BUSINESS_SECTIONS) is None
    assert Y.filled_tables("A\tB\nx\t\n\nA\tB\nx\t1") == 1


def table():
    return Block("table", lines=["a\tb", "1\t2"])


def text(t):
    return Block("paragraph", text=t)


def caption(kind, number):
    return Block("caption", kind, number=number, prefix=kind.title())


def test_media_move_behind_their_first_mention():
    blocks = [text("Intro."), caption("table", "1"), table(), text("Source: ours"), text("See Table 1 for it."), text("Table 1 again."), Block("heading", title="H"), text("Table 1 there.")]
    out, moved, warnings = Y.arranged(blocks)
    assert [b.type for b in out] == ["paragraph", "paragraph", "caption", "table", "paragraph", "paragraph", "heading", "paragraph"] and moved > 0 and not warnings
    assert out[1].text.startswith("See") and out[4].text == "Source: ours"
    stays = [caption("table", "1"), table(), text("As Table 1 above shows.")]
    assert Y.arranged(stays) == (stays, 0, ["placed by words"])
    twice = [caption("table", "1"), table(), text("x"), caption("table", "1"), table(), text("See Table 1.")]
    assert Y.arranged(twice)[1:] == (0, ["number twice"])
    assert Y.arranged([]) == ([], 0, [])


def test_captions_find_their_media():
    image = Block("image")
    blocks = Y.prepared([image, text("Figure 1. A view"), image, text("Рис. 2 - Вид"), text("Table 3 shows it.")])
    assert [b.type for b in blocks] == ["image", "caption", "image", "caption", "paragraph"]
    assert [u.members for u in Y.units(blocks)] == [[0, 1], [2, 3], [4]]
    assert Y.mentioned("See table 1.2, Рисунке 3 and Fig. 4; stable 5.") == [("table", "1.2"), ("figure", "3"), ("figure", "4")]
    assert [b.type for b in Y.with_captions([table(), caption("table", "1"), table(), table()], ["One", "Two"])] == ["caption", "paragraph", "table", "caption", "table", "table"]


def test_pieces_hold_whole_sentences():
    body = " ".join(f"Sentence {k} is here." for k in range(25))
    got = Y.pieces(body)
    assert [body[a:b].count(".") for a, b in got] == [10, 10, 5] and all(body[a:b].startswith("Sentence") for a, b in got)
    assert [body[a:b].count(".") for a, b in Y.pieces(body, 10, 45)] == [2] * 12 + [1]
    assert Y.pieces("One here.\n\nReferences\n\nA source. Another.\n\nAppendix A\n\nTwo here.") and Y.pieces("") == []


def test_tables(spark):
    docs = spark.createDataFrame([(1, PLAN), (2, None)], "doc_id long, text string")
    assert [r.section for r in Y.segment_rows(docs).orderBy("segment").collect()] == [None, "Executive Summary", "Financial Plan", None]
    ready = {r.section for r in Y.readiness(docs).where("doc_id = 1 and filled").collect()}
    assert ready == {"Executive Summary", "Financial Plan"} and Y.readiness(docs).count() == 16
    assert Y.inferred_sections(docs).count() == Y.arranged_documents(docs).count() == 2 and Y.work_pieces(docs).where("doc_id = 2").count() == 0
