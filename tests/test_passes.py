"""Edit passes and document structure against literal cases."""

import pytest

from lexiflow.functions import prose as P
from lexiflow.operators import documents as D
from lexiflow.operators import passes as A

SENTENCES = "In addition, demand grew by 12% in 2024 as reported. Moreover, the share of the firm reached 12.5% in spring. Therefore, revenue doubled against the year before. Thus, the plant paid off after eighteen months of work."


def of(text, kind):
    return [e for e in A.proposals(A.Draft(text)) if e.kind == kind]


def accepted(text, pick=lambda e: e.accepted):
    return A.apply(text, [A.replace(e, accepted=pick(e)) for e in A.proposals(A.Draft(text))])


def test_fillers_go_and_capitals_come_back():
    out, n, ok = accepted("Безусловно, компания выросла на 12% за 2024 год. Кроме того, выручка удвоилась по данным отчёта.", lambda e: e.sure)
    assert ok and n == 2 and out == "Компания выросла на 12% за 2024 год. Выручка удвоилась по данным отчёта."
    assert accepted("В данном разделе рассматривается рынок доставки. Рынок вырос на 12% за 2024 год.")[0] == "Рынок вырос на 12% за 2024 год."
    assert accepted("Of course, it's really good to have very good data.", lambda e: True)[0] == "It's good to have good data."


def test_facts_that_change_roll_all_edits_back():
    text = "Безусловно, выручка составила 12 млн руб. за 2024 год."
    edits = [A.replace(e, accepted=True, after="в 2025 году ") for e in A.proposals(A.Draft(text))]
    assert edits and A.apply(text, edits) == (text, 0, False)


def test_some_links_stay_for_the_zone():
    links = of(SENTENCES, "connectives")
    assert len(links) == 4 and [e.kept for e in links] == [True, False, False, False] and [e.accepted for e in links] == [False, True, True, True]
    assert all(not e.accepted for e in of("However, sales fell by 4% in 2024 overall. However, the market grew all the same.", "connectives"))
    assert of("Thus, it grew fast.", "connectives") == []  # too little would be left


def test_denominalisation_keeps_the_government():
    for text, expected in (
        ("Структура затрат оказывает влияние на маржинальность бизнеса в 2024 году.", "влияет на маржинальность"),
        ("Проект находится в зависимости от поставок сырья из двух регионов.", "зависит от поставок"),
        ("The platform makes use of the existing data in the second quarter.", "uses the existing data"),
        ("The implementation of the plan took a year.", "Implementing the plan"),
    ):
        out, _, ok = accepted(text)
        assert ok and expected in out
    assert of("It broke down during the implementation of the plan.", "denominalization") == []
    hints = A.manual(A.Draft("Наблюдается рост выручки на 3,2 млрд руб. за 2024 год по данным отчёта компании."))
    assert [h[2] for h in hints] == ["Наблюдается рост"]


def test_long_sentences_are_parted_only_on_request():
    text = (
        "Команда собрала прототип за шесть недель и вывела его на два региона без остановки текущих продаж, "
        "и уже в первом квартале выручка выросла на 12% относительно аналогичного периода прошлого года."
    )
    (e,) = of(text, "rhythm")
    assert not e.accepted and "продаж. Уже в первом квартале" in accepted(text, lambda e: True)[0]


def test_repeats_and_summaries_are_only_proposed():
    text = "Компания увеличила выручку за счёт расширения ассортимента и роста среднего чека. Расширение ассортимента и рост среднего чека увеличили выручку компании. Отдельно выросли продажи в регионах."
    (e,) = of(text, "reduction")
    assert not e.sure and text[e.start : e.end].startswith("Расширение")


def test_asides_within_their_share_and_explanations():
    aside = "The firm grew, for example, in the north, and sold more. "
    out, _, ok = accepted(aside * 7 + "It has two parts, namely tables and chairs.")
    assert ok and out.count("(for example, in the north)") == 1 and "parts: tables and chairs" in out


def test_series_and_periods_join():
    out, _, ok = accepted("First, we look at the market. Second, we count the costs. Third, we choose a place.")
    assert ok and out == "First, we look at the market; second, we count the costs; third, we choose a place."
    long = "The team built the first version in six weeks and showed it to two large clients in spring. This work let the owners see how much the second stage would cost them in all later years."
    (e,) = of(long, "period")
    assert e.long and e.sure and "in spring; this work" in accepted(long)[0]
    assert of(long.replace("This", "Ozon"), "period") == []


def test_edits_never_overlap_or_touch_references():
    text = SENTENCES + " See https://a.example/in-order-to/very and (In Order To, 2010) in order to see."
    edits = A.proposals(A.Draft(text))
    assert all(x.end <= y.start for x, y in zip(edits, edits[1:], strict=False))
    assert all("a.example" not in text[e.start : e.end] and "2010" not in text[e.start : e.end] for e in edits)


def test_anchors_and_comparison():
    kinds = {k for k, _ in P.anchors("On 2020-01-02 v1.2.3 weighed 12 kg, see https://a.b/C [3] and Moscow.")}
    assert kinds == {"url", "citation", "date", "version", "number", "unit", "proper"}
    got = P.compare("It cost 5 USD.", "It cost 6 USD.")
    assert got.lost == [("number", "5", 1)] and got.added == [("number", "6", 1)] and not got.ok
    assert P.compare("See [1, p. 2].", "See [1, p. 3].").lost[0][0] == "citation"


def test_spark_rows(spark):
    docs = spark.createDataFrame([(1, SENTENCES, "x"), (2, None, "x"), (2, "", "x"), (None, "Of course, all is well here.", "x")], "doc_id long, text string, before string")
    rows = A.edit_proposals(docs).collect()
    assert len([r for r in rows if r.doc_id == 1]) >= 4 and not [r for r in rows if r.doc_id == 2]
    assert all(SENTENCES[r.start : r.end] == r.before for r in rows if r.doc_id == 1)
    once = {r.doc_id: r.text for r in A.edited(docs.where("doc_id <> 2")).collect()}
    given = {r.doc_id: (r.text, r.ok) for r in A.apply_rows(docs.where("doc_id <> 2"), A.edit_proposals(docs)).collect()}
    assert given[1] == (once[1], True) == (A.apply(SENTENCES, A.proposals(A.Draft(SENTENCES)))[0], True)
    wrong = A.edit_proposals(docs).withColumn("before", A.F.lit("?"))
    assert [(r.text, r.ok) for r in A.apply_rows(docs.where("doc_id = 1"), wrong).collect()] == [(SENTENCES, False)]
    assert A.edit_proposals(docs.limit(0)).count() == 0 and A.edit_summary(docs).count() == 4
    report = spark.createDataFrame([(1, "paragraphCv", "low"), (1, "dashShare", "ok")], "doc_id long, metric string, status string")
    assert {r.method for r in A.author_hints(report).collect()} == {20, 13, 23, 24}


FULL = "\n\n".join(x for k, s in enumerate(D.BUSINESS_SECTIONS, 1) for x in (f"{k}. {s.title}", f"Text of section {k} with 25% in it.")) + "\n\nContents\n\nPages.\n\nConclusion\n\nAll fine here.\n\nReferences\n\nSources follow."


def test_block_kinds():
    kind = lambda t: (b := D.classified(t)) and (b.type, b.kind, b.number, b.title, b.level)
    assert kind("2.4.1. Целевой сегмент") == ("heading", "section", "2.4.1", "Целевой сегмент", 3)
    assert kind("Выручка выросла.")[0] == "paragraph" and kind(" \n") is None
    assert kind("Таблица 7 — Допущения")[:4] == ("caption", "table", "7", "Допущения")
    assert kind("Appendix D. Tables") == ("heading", "appendix", "D", "Tables", 1)
    assert kind("a\tb\nc\td")[0] == "table" and kind("- one\n- two")[0] == "list" and kind("• one")[0] == "list"
    assert kind("CONTENTS")[4] == 1 and kind("Some heading")[4] == 2


def test_stubs_numbers_and_rollback():
    profile = D.PROFILES["business-plan"]
    full = D.structured(FULL, profile)
    assert full.inserted == [] and "1. EXECUTIVE SUMMARY" in full.text
    some = D.structured("1. Executive Summary\n\nDescription here.\n\n7. Financial Plan\n\nFigures here.", profile)
    titles = [b.title for b in some.blocks if b.type == "heading"]
    assert titles.index("Marketing and Sales Plan") < titles.index("Production Plan") < titles.index("Financial Plan") and titles[0] == "Contents"
    numbers = [b.number for b in some.blocks if b.type == "heading" and b.number]
    assert len(set(numbers)) == len(numbers) and [b.number for b in some.blocks if b.title == "Financial Plan"] == ["7"]
    captions = [b for b in D.structured("Table 2 - B\n\nTable - A\n\nТаблица - C\n\nРисунок 3. Схема", profile, False).blocks if b.type == "caption"]
    assert [(b.prefix, b.number) for b in captions] == [("Table", "2"), ("Table", "1"), ("Table", "3"), ("Figure", "3")]
    assert D.structured("  ", profile).text == ""
    assert D.structured("Введение\n\nРабота посвящена анализу.\n\nContents\n\nОглавление.\n\nConclusion\n\nВывод.\n\nReferences\n\nИсточники.", D.PROFILES["academic-report"]).inserted == []
    assert D.structured("Intro\n\nline one\nline two 5", profile).lost == []


@pytest.mark.parametrize(
    ("text", "problem", "item"),
    [
        ("1. Executive Summary\n\nПоказатель NPV положителен, систему ЦКАД строит подрядчик.", "abbreviations", ["ЦКАД"]),
        ("1. Executive Summary\n\nЕдиная диспетчерская служба (ЕДС) принимает заявки. ЕДС работает круглосуточно.", "abbreviations", []),
        ("1. Executive Summary\n\nПо данным обзора [14] рынок растёт.", "citations-by-number", ["1"]),
        ("1. Executive Summary\n\nText here.\n\nAppendix D. Supporting tables\n\nTables here.", "appendix-unreferenced", ["Appendix D"]),
        ("1. Executive Summary\n\nSee appendix B for more.", "appendix-missing", ["Appendix B"]),
        ("Table 3 - Costs\n\nNo mention in this text.", "captions", ["Table 3"]),
        ("Table 3 - Costs\n\nSee table 3 for this.", "captions", []),
    ],
)
def test_compliance(text, problem, item):
    assert dict(D.structured(text, D.PROFILES["business-plan"]).problems).get(problem, []) == item


def test_structure_rows(spark):
    docs = spark.createDataFrame([(1, FULL), (2, None), (3, "Intro\n\nSome text."), (3, "Intro\n\nSome text.")], "doc_id long, text string")
    assert D.document_blocks(docs).where("doc_id = 3").count() == 4
    out = {r.doc_id: r for r in D.structured_documents(docs).collect()}
    assert out[2].text == "" and out[1].placeholders == 0 and out[3].placeholders == 11
    assert {r.part for r in D.missing_parts(docs).where("doc_id = 3").collect()} == {"Contents", "Conclusion", "References"}
    assert D.compliance_report(docs).where("doc_id = 3 and problem = 'placeholders'").count() == 22
    assert D.structured_blocks(docs.limit(0)).count() == 0
