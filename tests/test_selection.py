"""Candidates, sentence polishing, scorers and reordering on literal cases."""

import math

import numpy as np

from lexiflow.operators import candidates, evidence
from lexiflow.operators import selection as S

TEXT = "Moreover, it is important to note that the platform supports growth. The team wrote 12 reports in 2020. Furthermore, it provides a wide range of services. Rain fell on the roof all night long."


def test_candidates_are_distinct_and_keep_facts():
    found = S.generated(TEXT)
    texts = [t for t, _ in found]
    assert texts[0] == TEXT and len(set(texts)) == len(texts) <= 8 and all("12 reports in 2020" in t for t in texts)
    assert S.generated("") == [("", "source")] and len(S.generated(TEXT, limit=2)) == 2
    best, origin, score, before = S.improved(TEXT)
    assert score <= before and best in texts


def test_ties_and_missing_scores():
    assert S.best_of(["a", "b"], [3.0, 3.0]) == 0 and S.best_of(["a", "b", "c"], [3.0, math.nan, 2.0]) == 2 and S.best_of(["a"], [math.nan]) == 0
    assert S.hybrid(["One. Two."], lambda ts: [2.0]) == [S.by_rules(["One. Two."])[0] / 100 - 2.0]
    assert S.hybrid(["One. Two."], lambda ts: [math.nan]) == [S.by_rules(["One. Two."])[0] / 100]
    assert S.with_perplexity([1.0, 1.0, 1.0, 1.0, 1.0], [range(3), range(3, 5)], [1.0, 1.5, 9.0, 1.0, None]) == [1.0, 3.0, 5.0, 1.0, 1.0]


def test_reordering_moves_words_only():
    got = S.reordered("The new system supports quick payment and safe storage.", "en")
    assert "The new system supports safe storage and quick payment." in got
    assert S.reordered("The new platform reduces operating costs by sharing all servers.", "en") == ["By sharing all servers, the new platform reduces operating costs."]
    assert S.reordered("Компания развивает продажи готовых изделий в северных областях страны.", "ru") == ["В северных областях страны компания развивает продажи готовых изделий."]
    assert S.reordered("One; two and three four.", "en") == [] and S.reordered("", "en") == []


def test_polishing_takes_the_weakest_and_keeps_facts():
    out, rows = S.polished(TEXT)
    assert rows and all(TEXT[a:b] == before for a, b, before, *_ in rows) and "12 reports in 2020" in out and "Rain fell on the roof" in out
    assert all(gain > 0 for *_, gain in rows) and S.polished("") == ("", [])
    assert S.accepted("a 1 b", [(0, 1, "a", "c"), (2, 3, "1", "2")]) == ("c 1 b", [(0, 1, "a", "c")])
    assert S.replaced("abc", [(0, 2, "ab", "x"), (1, 3, "bc", "y")]) is None
    assert S.normalized("We don't know.", "We do not know.", "en") == "We do not know."


def test_weakness_is_that_of_the_columns(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    rows = {r.pos: (r.score, set(r.reasons)) for r in evidence.weak_spots(docs).collect()}
    assert {i: (score, set(why)) for i, (_, score, why) in enumerate(S.weakness(TEXT, "en"))} == rows


def test_fresh_profile_is_that_of_the_columns(spark):
    pairs = [("The new system supports quick payment and safe storage.", "The new system supports safe storage and quick payment."), ("a b c d", "a b c d"), ("One thing.", "Другая вещь совсем иная тут.")]
    frame = spark.createDataFrame([(i, a, b, True) for i, (a, b) in enumerate(pairs)], "i int, source string, candidate string, checked boolean")
    for r in candidates.profile(frame).collect():
        safe, novelty, ratio = S.fresh_profile(r.source, r.candidate, "en")
        assert (safe, round(novelty, 9), ratio) == (r.safe, round(r.novelty, 9), r.length_ratio)
    one = spark.createDataFrame([("The firm sold many useful books last summer.", "The firm sold many clever books this winter.", True)], "source string, candidate string, checked boolean")
    assert [candidates.profile(one, verified=v).first().safe for v in (None, "checked")] == [False, True]


def test_likelihoods():
    flat = np.zeros((4, 7))
    a, b, ratio = S.likelihoods(flat, flat, np.array([1, 2, 3, 4]))
    assert math.isclose(math.exp(a), 7) and math.isclose(ratio, 1) and math.isclose(a, b)
    assert all(map(math.isnan, S.likelihoods(flat, np.zeros((4, 6)), np.array([1, 2])))) and all(map(math.isnan, S.likelihoods(flat, flat, np.array([1]))))


def test_tables(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    assert {r.doc_id for r in S.candidate_rows(docs).where("cand_no = 0").collect()} == {1, 2}
    assert S.improved_documents(docs).count() == S.polished_documents(docs).count() == 2
    spans = S.sentence_spans(docs)
    assert spans.count() == 4 and S.reorder_rows(docs).count() >= 0
    around = {r.start: (r.before, r.after) for r in S.context(spans, docs, 10).collect()}
    assert around[0] == ("", TEXT[spans.orderBy("start").first().end :][:10].strip())
    scored = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 1.0, 1.5), (2, 0, 1.0, None), (2, 1, 1.0, 1.0)], "doc_id long, cand_no int, score double, log_perplexity double")
    assert sorted((r.doc_id, r.cand_no, r.score) for r in S.perplexity_penalty(scored).collect()) == [(1, 0, 1.0), (1, 1, 3.0), (2, 0, 1.0), (2, 1, 1.0)]
    logits = spark.createDataFrame([(1, [0.0] * 21, [0.0] * 21, [0, 1, 2], 7), (2, [0.0] * 21, [0.0] * 14, [0, 1, 2], 7), (3, None, None, None, None)], "row_id long, observer array<double>, performer array<double>, ids array<int>, vocabulary int")
    got = {r.row_id: r.perplexity for r in S.logit_scores(logits).collect()}
    assert math.isclose(got[1], 7) and got[2] is None and got[3] is None


def test_meaning_vouches_for_other_words(spark):
    old, new = "The firm sold many useful books last summer.", "The firm sold many clever books last winter."
    rows = [(1, old, new, [1.0, 0.0], [1.0, 0.1]), (2, old, new, [1.0, 0.0], [0.0, 1.0]), (3, old, new, None, [1.0, 0.0]), (4, old, old, [1.0], [1.0]), (5, old, "The firm never sold any books", [1.0], [1.0])]
    pairs = spark.createDataFrame(rows, "i int, source string, candidate string, source_vector array<double>, candidate_vector array<double>")
    assert {r.i: r.verified for r in candidates.gated(pairs).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_profiles_and_terms_are_checked(spark):
    rows = [("en", 300, 10, 12.0, 0.5, 0.2, 80.0), ("en", 100, 10, 12.0, 0.5, 0.2, 80.0), ("de", 300, 10, 12.0, 0.5, 0.2, 80.0), ("ru", 300, 10, float("nan"), 0.5, 0.2, 80.0), ("ru", 300, 10, 12.0, 0.5, None, 80.0)]
    frame = spark.createDataFrame(rows, "language string, words int, sentences int, sentence_words double, sentence_spread double, short_share double, paragraph_words double")
    assert candidates.valid_profiles(frame).count() == 1
    t = spark.createDataFrame([([" a ", "a", "", "<b>", "x" * 81, None, "c d"],), (None,)], "t array<string>")
    assert [r.t for r in t.select(candidates.plain_terms(candidates.F.col("t")).alias("t")).collect()] == [["a", "c d"], None]
