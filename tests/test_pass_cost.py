"""A pass that can't apply costs little, and what the loop doesn't need isn't worked out."""

import random
import time

import pytest

from lexiflow.functions import measure as M
from lexiflow.functions import prose as P
from lexiflow.operators import cleaning, passes, references
from lexiflow.operators import rewriting as R
from lexiflow.plans import registry

TEXTS = [
    "First, the team sold 5 kg. Second, it grew, for example, in the north, and so on. This section describes the plan. It is basically very clear. Moreover, it works well for all of us here.",
    "It works well, namely, for all of us. The team made an analysis of the market in 2020 [3], and it grew. " * 3,
    "Во-первых, команда растёт, например, на севере, и это видно. Во-вторых, рынок растёт, а именно, спрос. Таким образом, всё очень хорошо.", "Nothing here.", "",
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("kind", passes.METHOD)
def test_one_pass_is_that_of_all_proposals(text, kind):
    edits = [passes.replace(e, accepted=e.kind == kind and e.sure and not e.kept) for e in passes.proposals(passes.Draft(text))]
    assert passes.apply_pass(text, kind) == passes.apply(text, edits)[:2]
    assert passes.may_apply(text, kind) or not any(e.accepted for e in edits)


def test_a_pass_without_a_sure_edit_asks_no_other(monkeypatch):
    monkeypatch.setattr(passes, "proposals", None)
    assert passes.apply_pass("Cats and dogs sit here now.", "punctuation") == ("Cats and dogs sit here now.", 0)


def test_repeated_sentences_are_those_of_all_pairs():
    dice, told, sets = random.Random(7), passes.Told(), []
    for _ in range(300):
        own = {dice.choice("abcdefghijklmnop") for _ in range(dice.randrange(1, 6))}
        if dice.random() < 0.5:
            own = {x + str(dice.randrange(9)) for x in own}
        assert told.repeated(own, 0.6) == any(P.shared(own, x) >= 0.6 for x in sets)
        told.add(own)
        sets.append(own)


def test_long_sentences_are_parted_in_time():
    text = "one two, and three " * 20_000
    began = time.process_time()
    assert len(list(passes.rhythm(passes.Draft(text, "en")))) == 1
    assert time.process_time() - began < 8


@pytest.mark.parametrize("text", [*TEXTS, "ſection 3 and İ [1], https://a.b.", "x\nReferences\nA 2020\nAppendix A\nSee Table 3 (Smith, 2020), рис. 4, 10.1234/ab.", "Список литературы:\nИванов"])
def test_references_are_those_of_all_patterns(text, monkeypatch):
    found = references._Finder().merged(text)
    monkeypatch.setattr(references, "may_hold", lambda *_: True)
    assert references._Finder().merged(text) == found


def test_anchors_are_counted_only_for_a_step_that_asks(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(R, "loose_needed", lambda t: bool(asked.append(t)))
    monkeypatch.setattr(R, "_mapped", lambda docs, schema, rows: [rows(k, t) for k, t in enumerate(docs)])
    out = R.humanized_documents(["Cats sit here.", "Dogs run; birds fly (high)!"])
    assert len(out) == 2 and not asked


def test_words_by_place_are_those_of_the_parts():
    text = "ab, cd-ef _x, and gh"
    for at in range(len(text)):
        spans = P.word_spans(text)
        assert sum(a < at for a, _ in spans) == P.n_words(text[:at]) and sum(b > at for _, b in spans) == P.n_words(text[at:])


def test_revision_joins_nothing_and_scores_a_text_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "In order to win , we work.It works."), (1, "Plain."), (None, None), (2, "  ")], "doc_id long, text string")
    found = R.revised_documents(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 1
    want = [R.revised(t, cleaning.cleaned(t)[0], cleaning.typeset) for t in ("In order to win , we work.It works.", "Plain.", "", "  ")]
    assert sorted((r["text"], r["language"], r["before"], r["after"], r["replacements"], r["reverted"]) for r in found.collect()) == sorted((r.text, r.lang, r.before, r.after, r.replaced, r.reverted) for r in want)
    seen = []
    monkeypatch.setattr(M, "scored", lambda t, lang=None, f=M.scored: seen.append(t) or f(t, lang))
    M._lately.cache_clear()
    R.revised("Cats sit here. Dogs run.", "Cats sit here. Dogs run.", cleaning.typeset)
    assert len(seen) == 1


@pytest.mark.parametrize("text", ["a  b", "a \tb ,c", "( a)", "x \n y", "\n\n\n", " a", "a ", "a\n", "", 'he said "yes" 5 - 6', "it's 5 kg № 4", "a\x1cb\x1c"])
def test_tidied_and_typeset_as_by_all_patterns(text, monkeypatch):
    plain = text
    for body, to in P.TIDY:
        plain = P.pattern(body, "").sub(to, plain)
    assert P.tidy(text) == P.pattern(f"^{P.GAP}+|{P.GAP}+$", "").sub("", plain)
    found = cleaning.cleaned(text)
    monkeypatch.setattr(cleaning, "_STEPS", [(p, to, counter, None) for p, to, counter, _ in cleaning._STEPS])
    assert cleaning.cleaned(text) == found


def test_revised_texts_are_those_of_their_own_documents(spark, tmp_path):
    rows = [(k, f"Document {k} says , in order to win, what number {k * 7} is.It works.") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))  # one file, so it is dealt out
    found = registry.QUERIES["revise_documents"](spark, str(tmp_path)).collect()
    assert len(found) == 200 and all(f"{r.doc_id} says" in r.text and str(r.doc_id * 7) in r.text for r in found)
