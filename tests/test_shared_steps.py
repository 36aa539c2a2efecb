"""Steps that versions of a text have in common are done once, with the results of doing each alone."""

import pytest

from lexiflow.functions import measure as M
from lexiflow.functions import prose as P
from lexiflow.operators import rewriting as R
from lexiflow.operators import selection as S

TEXTS = [
    "In order to win, we take a wide range of steps; it works well for them. The team is here. The team grows in the first year. The team — and it shows — wins at home. " * 2,
    "In the year of growth, the team sold 5 kg (Smith, 2020), and it was not only fast, but also cheap. It is here; they are there now. The team helps in the year.\n- The team is here.\n\nThe end.",
    "Команда растёт в этом году — и это заметно. Команда здесь; они знают план. Во время работы, команда растёт. В целях роста мы были здесь, но они там были вчера.",
    "Nothing here", "", " \n ",
]


@pytest.mark.parametrize("text", TEXTS)
def test_layers_are_those_of_the_single_rewritings(text):
    layers = [*S.LAYERS, *S.SENTENCE_LAYERS, R.STEPS[:4]]
    assert list(R.layered(text, layers)) == [R.rewrite(text, x)[0] for x in layers]


def test_candidates_do_each_step_once_for_a_base(monkeypatch):
    done = []
    for name in ("tune_rhythm", "vary_openers"):
        monkeypatch.setattr(R, name, lambda lines, *a, f=getattr(R, name), name=name: done.append(name) or f(lines, *a))
    S.generated("The man goes home. The dog goes home, too. A cat sits there now.")
    assert done.count("tune_rhythm") == 1 and done.count("vary_openers") <= 2  # of the text itself, which is also its only paraphrase


@pytest.mark.parametrize("text", TEXTS)
def test_paraphrases_end_where_they_come_again(text, monkeypatch):
    found = R.variants(text, limit=6)
    monkeypatch.setattr(R, "_cycle", lambda *_: 99)
    assert R.variants(text, limit=6) == found


def test_paraphrases_without_a_choice_are_made_once(monkeypatch):
    seen = []
    monkeypatch.setattr(R, "paraphrased", lambda *a, f=R.paraphrased: seen.append(a) or f(*a))
    assert R.variants("The man goes home.") == ["The man goes home."] and len(seen) == 1


def test_facts_are_compared_without_names(monkeypatch):
    pairs = [("In 2020 ACME sold 5 kg [3].", x) for x in ("In 2020 Acme sold 5 kg [3].", "In 2021 ACME sold 5 kg [3].", "In 2020 ACME sold 5 kg [4].", "In 2020 sold 5 kg [3] to BETA.")]
    want = [P.compare(a, b).ok for a, b in pairs]
    monkeypatch.setattr(P, "names", None)
    assert [P.intact(a, b) for a, b in pairs] == want == [True, False, False, True]


def test_ranges_are_sought_only_in_texts_with_dashes(monkeypatch):
    texts = [*TEXTS, "From 5 - 10 to 7–9 — or so. It goes on (5-6). It ends? It does!"]
    want = [M.scored(t) for t in texts]
    monkeypatch.setattr(M, "_dashed", lambda _: True)
    assert [M.scored(t) for t in texts] == want
    monkeypatch.undo()
    monkeypatch.setattr(M, "_RANGE", None)
    monkeypatch.setattr(M, "_RANGE_ANY", None)
    assert S.improved("The man goes home. The dog goes, too. A cat sits there now. It is late.")[0]
