"""Anchors, claims, weak sentences, style and compliance on small literal tables."""

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import evidence, spans
from tests.test_reference_operators import rows, texts


def test_dates_versions_and_units(spark):
    docs = texts(spark, "On 12.05.2024 and March 3, 2021, v1.2.3 took 5 km for 20 % more; 2020 года, Q3 2022", "", None, "abc12.05.2024x 7кг")
    got = rows(docs.select("doc_id", *(evidence.dated(F.coalesce("text", F.lit("")), k).alias(k) for k in ("date", "version")), evidence.units(F.coalesce("text", F.lit(""))).alias("unit")))
    assert got[0].date == ["12.05.2024", "March 3, 2021", "Q3 2022"] and got[0].unit == ["km", "%", "года"]
    assert "v1.2.3" in got[0].version
    assert got[1].date == got[2].date == [] and got[3].date == [] and got[3].unit == ["кг"]


def test_names_stand_nowhere_in_small_letters(spark):
    got = evidence.proper_nouns(texts(spark, "The Anna met Green here. Green and green. Ask NATO or NATO-X2. Also Boris.", None, "")).collect()
    assert {(r.doc_id, r.value, r.n) for r in got} == {(0, "anna", 1), (0, "nato", 1), (0, "nato-x2", 1), (0, "boris", 1)}


def test_density_and_empty_claims(spark):
    docs = texts(spark, "It improves sales. It improves sales by 12%. A robust plan for Anna.", "", None)
    assert {r.doc_id: r.value for r in evidence.anchor_density(docs).collect()} == {0: pytest.approx(3 * 100 / 13), 1: None, 2: None}
    assert {r.doc_id: r.value for r in evidence.empty_claims(docs).collect()} == {0: pytest.approx(2 / 3), 1: 0.0, 2: 0.0}


def test_weak_sentences_carry_reasons(spark):
    got = evidence.weak_spots(texts(spark, 'Moreover, it improves things. It rained on 3 of 7 days. "Fine." It is possibly so, moreover and at the end of the day leverage.', "", None)).collect()
    by = {r.pos: r for r in got}
    assert {r.doc_id for r in got} == {0} and len(by) == 4
    assert by[0].reasons == ["discourse", "cliche", "empty_claim"] and by[0].score == 70
    assert by[1].reasons == ["concrete", "repeated_opener", "average_length"] and by[1].score == 5
    assert by[3].reasons == ["cliche", "hedge", "repeated_opener"] and by[3].score == 70


def test_style_of_an_author(spark):
    got = rows(evidence.style(texts(spark, "One two three. Four five.\n\nSix", "", None)))
    assert got[0].sentence_words == 2 and got[0].short_share == 1 and got[0].paragraph_words == 3
    assert got[0].sentence_spread == pytest.approx((2 / 3) ** 0.5 / 2)
    assert tuple(got[1])[1:] == tuple(got[2])[1:] == (0, 0, 0, 0)
    assert rows(evidence.style_distance(evidence.style(texts(spark, "One two.")), 4.0))[0].distance == 0.25


def test_citations_pages_abbreviations(spark):
    docs = texts(spark, "As shown (Ivanov, 1999) and [1, 2]. The Local Unit Board (LUB) met the XQZ and GDP. XQZ (extra quick zone).", "", None)
    got = rows(evidence.compliance(docs))
    assert (got[0].cited, got[0].foreign, got[0].pages) == (1, 1, 1) and got[2].pages == 1
    assert [(r.doc_id, r.token) for r in evidence.abbreviations(docs).collect()] == [(0, "XQZ")]


def test_parallel_headings(spark):
    got = evidence.heading_schemas(texts(spark, "Testing all the code\nBuilding many new things\nWriting good long texts\nThis is a sentence.", "One\nTwo", None)).collect()
    assert [(r.doc_id, r.headings, r.dominant, r.share, r.parallel) for r in got] == [(0, 3, "action:long", 1.0, True)]


def test_mid_rank_holds_against_plain_counts(spark):
    past = [("a", float(v)) for v in (1, 1, 2, 3, 3, 3, 9)] + [("b", 1.0)] * 4 + [("a", None)]
    now = [("a", 1, 3.0), ("a", 2, 0.5), ("a", 3, None), ("b", 4, 1.0), ("c", 5, 1.0)]
    got = spans.mid_rank(spark.createDataFrame(past, "k string, value double"), spark.createDataFrame(now, "k string, id long, value double"), ["k"])
    assert {(r.id, r.median, r.share) for r in got.collect()} == {(1, 3.0, (3 + 3 / 2) / 7), (2, 3.0, 0.0)}
    assert spans.mid_rank(spark.createDataFrame([], "k string, value double"), spark.createDataFrame(now, "k string, id long, value double"), ["k"]).count() == 0
