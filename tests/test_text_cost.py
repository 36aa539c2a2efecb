"""What the text functions cost: no work that grows with the square of a text, and none done again for its versions."""

import time

import pytest
import regex

from lexiflow.functions import edit_lexicon as E
from lexiflow.functions import prose as P
from lexiflow.functions.prose import pattern
from lexiflow.operators import evidence, passes, rewriting, selection, spans


def _took(work) -> float:
    began = time.process_time()
    work()
    return time.process_time() - began


def test_triads_take_time_in_proportion():
    text = "word " * 40_000 + "."
    assert _took(lambda: passes.manual(passes.Draft(text))) < 8


@pytest.mark.parametrize("text", ["one two, three four, and five six. seven eight, nine ten, or eleven (aa, bbb, ccc, and ddd)", "ab, abc, abcd, and efg", "a; bcd,efg, or hij. klm, nop, and qrs", ""])
def test_triads_are_those_of_the_plain_pattern(text):
    plain = regex.compile("[^,;:()]{3,},[^,;:()]{3,},\\s*(?:and|or)\\s+[^,.;:()]{3,}", regex.I)
    assert [m.span() for m in pattern(E.TRIAD).finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_versions_of_a_paragraph_share_one_look_through_the_dictionary():
    rewriting._places.cache_clear()
    rewriting.variants("In order to win, we are able to take a wide range of steps; it is important to note that this works. " * 3)
    assert rewriting._places.cache_info().misses == 1


def test_a_source_is_taken_apart_once_for_all_its_candidates():
    P._counted.cache_clear()
    for k in range(5):
        P.compare("In 2020 ACME sold 5 kg.", f"In 2020 ACME sold {k} kg.")
    assert P._counted.cache_info().misses <= 6


@pytest.mark.parametrize("text", ["v1.2.3 on 12 March 2024, 5 kg at https://a.b/c and 7 % (Smith, 2020)", "ſeptember 3, 2020; 5 Kg; İstanbul 2020 year", "9\x1cг. 5 млн, 12.03.2024 xv2.0 www.a.b", "2024-01-02 q3 2024 1.2.3.4.5.6"])
def test_fast_anchors_are_those_of_the_plain_patterns(text):
    plain = [(k, v) for k, p in P._FACTS.items() for m in p.finditer(text) if (v := P.plain_value(m[0]))]
    assert P.hard_anchors(text) == plain


def test_openers_are_counted_once():
    text = "\n\n".join(f"{w} goes on and on." for w in (chr(97 + k % 26) + str(k) for k in range(20_000)))
    assert _took(lambda: selection.weakness(text, "en")) < 8


def test_weak_spots_tell_the_language_once_a_text(spark):
    text = " ".join(f"Слово {k} тут стоит." for k in range(6_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    plan = evidence.weak_spots(docs)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]  # what is done to each sentence
    assert "IsCyrillic" not in above
    assert evidence.weak_spots(docs).count() == 6_000


def test_qualifiers_are_counted_as_by_the_plain_patterns(spark):
    pairs = spark.createDataFrame([("Only all of it. Can", "only ALL of it"), ("alwayſ", "x"), ("if", "IF if"), ("", "Прежде всего всё")], "source string, candidate string")
    assert [r["changed"] for r in spans.qualifiers_kept(pairs).collect()] == [["ability"], ["universal"], ["condition"], ["accent"]]


def test_a_table_of_one_large_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    from lexiflow import session

    spark.range(2_000).selectExpr("id as doc_id", "repeat('x', 50) as text").coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "SPREAD_BYTES", 10)
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    dealt = session.spread(df, heavy=True)
    assert dealt.rdd.getNumPartitions() >= cores and dealt.count() == 2_000
    assert session.spread(dealt, heavy=True).rdd.getNumPartitions() == dealt.rdd.getNumPartitions()
