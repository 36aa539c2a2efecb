"""What to ask the author: questions on paragraphs without facts, and terms written in several ways."""

from __future__ import annotations

from collections import Counter

import regex
from pyspark.sql import DataFrame

from lexiflow.functions import prose as P
from lexiflow.functions.prose import LEFT, RIGHT, pattern
from lexiflow.operators.passes import _mapped

# Words of a paragraph that is asked about, and anchors on 100 words that it should have.
WORDS_FROM, DENSITY = 20, 3
# Claims of a benefit, hedges and universal words, by language.
BENEFIT = {
    "ru": "(?:позволя[ею]т?|улучша[ею]т?|повыша[ею]т?|снижа[ею]т?|увеличива[ею]т?|оптимизиру[ею]т?|ускоря[ею]т?|значительно|существенно|эффективн\\p{L}*)",
    "en": "(?:enables?|improves?|increases?|reduces?|optimi[sz]es?|significantly|substantial|efficien\\p{L}*|accelerates?)",
}
UNIVERSAL = {"ru": "(?:все|всех|любой|любая|каждый|каждая|всегда|никогда|ни один|всякий)", "en": "(?:all|any|every|always|never|none)"}
HEDGE = {
    "ru": "(?:возможно|вероятно|как правило|скорее всего|по-видимому|представляется|зачастую|потенциально|теоретически|в целом)",
    "en": "(?:possibly|probably|arguably|generally|typically|presumably|potentially)",
}
# Fixed values: (kind, method, what is asked).
CHECKLIST = [
    ("position", 12, "one main thought in a section"), ("tradeoff", 13, "gain and cost"), ("omission", 14, "what is left out on purpose"),
    ("situation", 15, "when, where, for whom"), ("case", 16, "one case instead of a generality"), ("falsifiable", 17, "a claim one could disagree with"),
]
TERM_WORD, TERM_KEY, TERMS = regex.compile("\\p{L}[\\p{L}\\p{N}-]{3,}"), 6, 8


def asked(text: str, lang: str | None = None) -> list[tuple[int, str, int, str]]:
    """(paragraph from 1, kind, method, word that gave rise) of all questions on a text."""
    lang = lang or P.language(text)
    out = []
    for k, raw in enumerate(regex.split("\n{2,}", text), 1):
        p = raw.strip()
        words = P.n_words(p)
        if words < WORDS_FROM:
            continue
        anchors = P.anchors(p)
        kinds = {t for t, _ in anchors}
        if len(anchors) * 100 / words < DENSITY:
            out += [(k, kind, method, "") for kind, method, needs in (("numbers", 11, {"number", "unit"}), ("period", 15, {"date"}), ("names", 16, {"proper"})) if not kinds & needs]
        found = lambda bodies, p=p: pattern(LEFT + bodies[lang] + RIGHT).search(p)
        if "number" not in kinds and (m := found(BENEFIT)):
            out.append((k, "how much", 13, m[0]))
        out += [(k, kind, method, m[0]) for kind, method, bodies in (("hedge", 11, HEDGE), ("falsifiable", 17, UNIVERSAL)) if (m := found(bodies))]
    return out


def drift(text: str) -> list[tuple[int, str, list[str], int]]:
    """(rank from 1, key, forms, places) of terms that a text writes in several ways, the most frequent first; ties as they come up."""
    words = [w.lower() for w in TERM_WORD.findall(text)]
    forms: dict[str, Counter] = {}
    for i, w in enumerate(words):
        for form in (w, f"{w} {words[i + 1]}") if i + 1 < len(words) else (w,):
            key = form.replace("-", "").replace(" ", "")
            if len(key) >= TERM_KEY:
                forms.setdefault(key, Counter())[form] += 1
    several = sorted(((k, c) for k, c in forms.items() if len(c) > 1), key=lambda x: -x[1].total())
    return [(rank, k, [f for f, _ in c.most_common()], c.total()) for rank, (k, c) in enumerate(several[:TERMS], 1)]


def questions(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, kind, method, word): what to ask about each paragraph of twenty words or more."""
    return _mapped(docs, "doc_id long, paragraph int, kind string, method int, word string", lambda i, t: [(i, *q) for q in asked(t)])


def checklist(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, method, asks): the standing questions, for every document."""
    return _mapped(docs, "doc_id long, kind string, method int, asks string", lambda i, t: [(i, *c) for c in CHECKLIST])


def terminology(docs: DataFrame) -> DataFrame:
    """(doc_id, rank, key, forms, n): up to eight terms that a text writes with and without hyphen or blank; forms by their number."""
    return _mapped(docs, "doc_id long, rank int, key string, forms array<string>, n long", lambda i, t: [(i, *d) for d in drift(t)])
