"""Candidates for a text or a sentence, how they are scored, and which one takes the source's place.

Scores are better when lower. The source is always a candidate and wins ties; a score that is no
number drops out. Scorers are functions from texts to scores, so a model's can stand in for the rules'.

Scale: one document at a time in Arrow batches; a document has sixteen candidates at most and a
sentence as many as it has options, so nothing grows with the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import chain
from math import ceil, floor, isfinite

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import lexicon as L
from lexiflow.functions import measure as M
from lexiflow.functions import prose as P
from lexiflow.functions.prose import LEFT, RIGHT, pattern
from lexiflow.operators import rewriting as R
from lexiflow.operators.candidates import ENDING_RU, FINITE_RU, LENGTH, NOVELTY, STOP
from lexiflow.operators.edits import lcs
from lexiflow.operators.passes import _mapped

Scorer = Callable[[list[str]], list[float]]

# Structural steps that make candidates of a base, in order; steps that a sentence alone allows.
LAYERS = ((), ("rhythm",), ("openers",), ("rhythm", "openers"), ("dashes", "rhythm", "openers"))
SENTENCE_LAYERS = (("dashes",), ("antithesis",), ("dashes", "antithesis"))
# Candidates of a text, sentences polished at once, and how far a fresh wording may score above its source.
LIMIT, MOST, POLISHED, POLISHED_MOST, SLACK, NOVELTY_GAIN, LENGTH_COST = 8, 16, 5, 12, 4, 30, 6
SHARE_LEAST, SHARE_MOST, WEAK_SHARE, FRESH_WORDS, CONTEXT, PENALTY_MOST = 0.15, 0.6, 0.6, (6, 80), 350, 4


def by_rules(texts: list[str], lang: str | None = None) -> list[float]:
    """The rules' score of each text."""
    return [float(M.score(t, lang)["score"]) for t in texts]


def hybrid(texts: list[str], model: Scorer, lang: str | None = None) -> list[float]:
    """A hundredth of the rules' score and a model's log-likelihood with its sign turned; without the latter the former alone."""
    return [r / 100 + (-m if isfinite(m) else 0.0) for r, m in zip(by_rules(texts, lang), model(texts), strict=True)]


def with_perplexity(scores: list[float], groups: list[range], log_perplexity: list[float | None]) -> list[float]:
    """Scores with a penalty for candidates that a model finds less likely than their group's first text; a group with a missing value gets none."""
    out = list(scores)
    for g in groups:
        seen = [log_perplexity[i] for i in g]
        if len(g) > 1 and all(x is not None and isfinite(x) and x >= 0 for x in seen):
            for i, x in zip(g, seen, strict=True):
                out[i] += min(PENALTY_MOST, max(0.0, x - seen[0]) * PENALTY_MOST)
    return out


def generated(text: str, lang: str | None = None, limit: int = LIMIT, layers: bool = True) -> list[tuple[str, str]]:
    """(candidate, origin): the text and up to three paraphrases, each plain and after structural steps; distinct, with all facts of the text."""
    lang, limit, seen, out = lang or P.language(text), max(2, min(limit, MOST)), set(), []
    for base, origin in [(text, "source"), *((v, "dictionary") for v in R.variants(text, lang) if v != text)]:  # the text again gives nothing new
        used = LAYERS if layers else LAYERS[:1]
        for steps, made in zip(used, chain([base], R.layered(base, used[1:], lang)), strict=True):
            if made not in seen:
                seen.add(made)
                if made == text or P.intact(text, made):
                    out.append((made, " + ".join((origin, *steps))))
            if len(out) >= limit:
                return out
    return out


def best_of(texts: list[str], scores: list[float]) -> int:
    """Which text has the lowest score; the first, the source, wins ties and where none has a score."""
    fine = [i for i, s in enumerate(scores) if isfinite(s)]
    return min(fine, key=lambda i: (scores[i], i), default=0)


def improved(text: str, lang: str | None = None, limit: int = LIMIT, scorer: Scorer = by_rules) -> tuple[str, str, float, float]:
    """(best candidate, origin, its score, the source's)."""
    found = generated(text, lang, limit)
    scores = scorer([t for t, _ in found])
    best = best_of([t for t, _ in found], scores)
    return (*found[best], scores[best], scores[0])


# Sentences.


def reordered(sentence: str, lang: str) -> list[str]:
    """The same words in another order: joined objects swapped, a manner or a last adverbial put first."""
    source = sentence.strip()
    end = pattern("[.!?…]+$", "").search(source)
    mark, body = (end[0], source[: end.start()].strip()) if end else ("", source)
    out: list[str] = []
    if not body or pattern("[;:|\t]", "").search(body):
        return out

    def keep(text: str) -> None:
        text = pattern("\\s+", "").sub(" ", text).strip()
        if text and text != source and text not in out:
            out.append(text)

    words = lambda t: len(P.WORD_.findall(t))
    upper = lambda t: t[:1].upper() + t[1:]
    common = lambda t: not pattern("[A-ZА-ЯЁ]{2}", "").match(t) and (lang == "ru" or pattern(f"(?:The|A|An|This|These|That|Those|It|We|They|Our|Their|Your){P.EDGE}", "").match(t))
    lower = lambda t: t[:1].lower() + t[1:] if t and common(t) else t
    nested = lambda t: lang == "en" and pattern(f"(?i){P.EDGE}(?:{NESTING}){P.EDGE}", "").search(t)
    verb_in = lambda t: pattern(f"(?i)(?:^|\\s)({VERB[lang]})(?=\\s|$|[,.!?])", "").search(t)
    verb = verb_in(body)
    if verb and verb.start(1) > 1:
        subject, tail = body[: verb.start(1)].strip(), body[verb.end(1) :].strip()
        parts = regex.split("\\s+и\\s+" if lang == "ru" else "(?i)\\s+and\\s+", tail)
        if len(parts) == 2 and min(map(words, parts)) >= 2 and not nested(parts[0]):
            a, b, link = parts[0].strip(), parts[1].strip(), " и " if lang == "ru" else " and "
            second = verb_in(b)
            swapped = f"{b}{link}{verb[1]} {a}" if second and second.start(1) == 0 else f"{verb[1]} {b}{link}{a}"
            keep(f"{subject} {swapped}{mark}")
    if lang == "en" and verb and "," not in body:
        ways = list(pattern(f"(?i)\\s+by\\s+[a-z]+ing{P.EDGE}", "").finditer(body))
        if len(ways) == 1 and ways[0].start() > verb.start(1):
            head, way = body[: ways[0].start()].strip(), body[ways[0].start() :].strip()
            plain = pattern(f"(?i){PLAIN_OBJECT}", "").fullmatch(body[verb.end(1) : ways[0].start()].strip())
            if plain and words(head) >= 4 and words(way) >= 3 and not pattern(f"(?i){P.EDGE}(?:who|which|that|because|when|if|where){P.EDGE}", "").search(head):
                keep(f"{upper(way)}, {lower(head)}{mark}")
    letter = "а-яё" if lang == "ru" else "a-z"
    last = [m for m in pattern(f"(?i)\\s+(?:{TERMINAL[lang]})\\s+(?=[{letter}])", "").finditer(body) if m.start() > len(body) * 0.42]
    if last:
        head, phrase = body[: last[-1].start()].strip(), body[last[-1].start() :].strip()
        if lang == "ru":
            phrase = pattern("(?i)^в\\s+достижении(?=\\s|$)", "").sub("Для достижения", phrase)
        if not nested(head) and min(words(head), words(phrase)) >= 3:
            keep(f"{upper(phrase)} {lower(head)}{mark}")
    return out


# Verbs, prepositions and objects by which parts of a sentence are told.
VERB = {
    "ru": "[а-яё-]+(?:ает|яет|ует|ирует|ывает|ивает|ет|ёт|ит|ут|ют|ат|ят)",
    "en": "is|are|has|have|helps?|supports?|provides?|creates?|improves?|increases?|reduces?|enables?|allows?|uses?|builds?|keeps?|makes?",
}
NESTING = "by|through|with|without|during|within|in|on|at|for|from|of|to"
TERMINAL = {"ru": "в|во|на|при|для|по|с|со|из|за|благодаря", "en": "in|on|at|for|with|from|through|during|within"}
PLAIN_OBJECT = (
    "(?:(?:the|its|their)\\s+)?(?:(?:operating|operational|production|administrative|overall|total|customer|employee)\\s+){0,2}"
    "(?:costs|losses|delays|efficiency|sales|revenue|productivity|retention|profits)"
)


def sentence_variants(sentence: str, lang: str, fresh: bool = False) -> list[str]:
    """Versions of one sentence with all its facts: paraphrases, single options, dashes and contrasts; ``fresh``: other orders too."""
    made = [*R.variants(sentence, lang), *(v for *_, vs in R.replacement_options(sentence, lang) for v in vs), *(R.rewrite(sentence, x, lang)[0] for x in SENTENCE_LAYERS)]
    made += reordered(sentence, lang) if fresh else []
    distinct = [v for v in dict.fromkeys(x.strip() for x in made) if v and v != sentence]
    return [v for v in distinct if P.intact(sentence, v)]


def _stems(text: str, lang: str) -> list[str]:
    words = [w.lower() for w in P.WORD_.findall(text)]
    stem = (lambda w: regex.sub(ENDING_RU, "", w)) if lang == "ru" else (lambda w: pattern("(?:ing|ied|ed|es|s)$", "").sub(lambda m: "y" if m[0] == "ied" else "", w))
    return sorted(stem(w) for w in words if len(w) >= 5 and w not in STOP[lang])


def fresh_profile(source: str, candidate: str, lang: str, verified: bool = False) -> tuple[bool, float, float]:
    """(is it a safe rewording, novelty, length ratio); ``verified``: its meaning is checked, so the vocabulary may differ."""
    a, b = ([w.lower() for w in P.WORD_.findall(t)] for t in (source, candidate))
    ratio = len(b) / len(a) if a else 0.0
    novelty = 1 - 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
    opens = lang == "ru" and a[:1] != b[:1] and b and regex.search(FINITE_RU, b[0])
    stable = _stems(source, lang) == _stems(candidate, lang) or verified and 0.85 <= ratio <= 1.15
    safe = LENGTH[0] <= ratio <= LENGTH[1] and NOVELTY[0] <= novelty <= NOVELTY[1] and (len(b) < 4 or P.language(candidate) == lang) and stable and not opens
    return bool(safe and 1 <= len(P.sentences(candidate)) <= 2), novelty, ratio


def weakness(text: str, lang: str) -> list[tuple[P.Sentence, int, list[str]]]:
    """(sentence, score, reasons): what weighs each sentence down, as ``weak_spots`` has it in columns."""
    ss = [s for p in P.paragraphs(text) for s in p]
    if not ss:
        return []
    pick = lambda ru, en: ru if lang == "ru" else en
    sizes = [P.n_words(s.text) for s in ss]
    mean = sum(sizes) / len(ss)
    first = [(P.WORD.search(s.text) or [""])[0].lower() for s in ss]
    openers = Counter(first)
    out = []
    for s, size, opener in zip(ss, sizes, first, strict=True):
        low = s.text.lower()
        hard = len(P.hard_anchors(s.text))
        found = {
            "discourse": int(pattern("^[^\\p{L}]+", "").sub("", low).startswith(tuple(pick(L.DISCOURSE_RU, L.DISCOURSE_EN)))),
            "cliche": min(2, sum(p in low for p in pick(L.CLICHE_RU, L.CLICHE_EN))),
            "hedge": int(any(p in low for p in pick(L.HEDGE_RU, L.HEDGE_EN))),
            "empty_claim": int(not hard and pattern(f"{LEFT}(?:{L.SENTENCE_CLAIMS[lang]}){RIGHT}").search(s.text) is not None),
            "concrete": int(hard >= 2),
            "repeated_opener": int(opener != "" and openers[opener] > 1),
            "average_length": int(mean > 0 and abs(size - mean) / mean < 0.15 and len(ss) >= 4),
        }
        score = sum(n * L.WEAK_WEIGHTS[k] for k, n in found.items())
        out.append((s, max(0, min(100, score)), [k for k, n in found.items() if n]))
    return out


def targets(text: str, lang: str, limit: int = POLISHED, fresh: bool = False, share: float = WEAK_SHARE) -> list[int]:
    """Which sentences to polish: the weakest; ``fresh``: those among them that can be put otherwise, and others evenly spread over the text."""
    ranked = weakness(text, lang)
    by_score = sorted((i for i, (_, score, _) in enumerate(ranked) if score > 0), key=lambda i: (-ranked[i][1], i))
    limit = max(1, min(limit, POLISHED_MOST))
    if not fresh:
        return by_score[:limit]
    able = [i for i, (s, *_) in enumerate(ranked) if FRESH_WORDS[0] <= len(P.WORD_.findall(s.text)) <= FRESH_WORDS[1] and not pattern("[\t|]", "").search(s.text) and reordered(s.text, lang)]
    if not able:
        return []
    desired = max(1, min(limit, len(able), ceil(len(ranked) * max(SHARE_LEAST, min(share, SHARE_MOST)))))
    weak = [i for i in by_score if i in set(able)]
    quota = min(len(weak), max(1, floor(desired * WEAK_SHARE))) if weak else 0
    chosen = weak[:quota]
    for slot in range(desired - quota):
        wanted = able[min(len(able) - 1, floor((slot + 0.5) * len(able) / max(1, desired - quota)))]
        chosen.append(min((i for i in able if i not in chosen), key=lambda i: abs(i - wanted)))
    return sorted(chosen)


def polished(text: str, lang: str | None = None, limit: int = POLISHED, fresh: bool = False, scorer: Scorer = by_rules) -> tuple[str, list[tuple[int, int, str, str, float]]]:
    """(a text with its weakest sentences in their best version, (start, end, before, after, gain) of each).

    ``fresh``: new wordings count more, the more they differ at about the same length, and may score a little
    worse. If the whole changes a fact, replacements are taken one by one, those that don't.
    """
    lang = lang or P.language(text)
    ss = [s for p in P.paragraphs(text) for s in p]
    rows = []
    for i in targets(text, lang, limit, fresh):
        s, before = ss[i], ss[i].text.strip()
        options = sentence_variants(before, lang, fresh)
        base, *values = scorer([before, *options])
        found = [(v, o) for v, o in zip(values, options, strict=True) if isfinite(v)]
        if fresh:
            told = [(v, o, *fresh_profile(before, o, lang)) for v, o in found if v <= base + SLACK]
            found = [(v - NOVELTY_GAIN * novelty + LENGTH_COST * abs(1 - ratio), o) for v, o, safe, novelty, ratio in told if safe]
        best = min(found, key=lambda x: x[0], default=None)
        if best and isfinite(base) and base > best[0]:
            at = s.start + len(s.text) - len(s.text.lstrip())
            rows.append((at, at + len(before), before, best[1], base - best[0]))
    return accepted(text, rows)


def replaced(text: str, rows: list[tuple]) -> str | None:
    """``rows`` (start, end, before, after, ...) put into a text; None where one overlaps another or its ``before`` isn't there."""
    last = len(text)
    for start, end, before, after, *_ in sorted(rows, key=lambda r: -r[0]):
        if not 0 <= start < end <= last or text[start:end] != before:
            return None
        text, last = text[:start] + after + text[end:], start
    return text


def accepted(text: str, rows: list[tuple]) -> tuple[str, list[tuple]]:
    """(the text with all rows, or with those that go one by one without a changed fact; these rows)."""
    whole = replaced(text, rows)
    if whole is not None and P.intact(text, whole):
        return whole, rows
    out, kept = text, []
    for row in rows:
        tried = replaced(text, [*kept, row])
        if tried is not None and P.intact(text, tried):
            out, kept = tried, [*kept, row]
    return out, kept


def normalized(candidate: str, original: str, lang: str) -> str:
    """A model's candidate through dictionary and typography, if that keeps the original's facts; else as it is."""
    from lexiflow.operators.cleaning import typeset

    made = typeset(R.paraphrased(candidate, lang)[0]).strip()
    return made if made and P.intact(original, made) else candidate


# Tables.


def candidate_scores(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, cand_no, score): the candidates of each document without their texts, which stay where they are made."""
    rows = lambda i, t: [(i, k, s) for k, s in enumerate(by_rules([c for c, _ in generated(t, limit=limit)]))]
    return _mapped(docs, "doc_id long, cand_no int, score double", rows)


def candidate_rows(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, cand_no, text, origin, score): the candidates of each document; number 0 is the source."""

    def rows(i: int | None, t: str) -> list[tuple]:
        found = generated(t, limit=limit)
        return [(i, k, c, o, s) for k, ((c, o), s) in enumerate(zip(found, by_rules([c for c, _ in found]), strict=True))]

    return _mapped(docs, "doc_id long, cand_no int, text string, origin string, score double", rows)


def improved_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text, origin, score, before): each document's best candidate."""
    return _mapped(docs, "doc_id long, text string, origin string, score double, before double", lambda i, t: [(i, *improved(t, limit=limit))])


def polished_documents(docs: DataFrame, limit: int = POLISHED, fresh: bool = False) -> DataFrame:
    """(doc_id, text, replaced, changed_share): each document with its weakest sentences in their best version."""

    def rows(i: int | None, t: str) -> list[tuple]:
        out, found = polished(t, None, limit, fresh)
        words = len(P.WORD_.findall(t))
        return [(i, out, len(found), sum(len(P.WORD_.findall(r[2])) for r in found) / words if words else 0.0)]

    return _mapped(docs, "doc_id long, text string, replaced int, changed_share double", rows)


def reorder_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, variant, text): other orders of every sentence that has some."""
    rows = lambda i, t: [(i, s.start, k, v) for p in P.paragraphs(t) for s in p for k, v in enumerate(reordered(s.text, P.language(t)))]
    return _mapped(docs, "doc_id long, start long, variant int, text string", rows)


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, pos, start, end, gap, words): every sentence by its place; ``gap`` is where the blanks behind it end."""
    rows = lambda i, t: [(i, k, n, s.start, s.end, s.gap, s.words) for k, p in enumerate(P.paragraphs(t)) for n, s in enumerate(p)]
    return _mapped(docs, "doc_id long, paragraph int, pos int, start long, end long, gap long, words long", rows)


def context(spans: DataFrame, docs: DataFrame, most: int = CONTEXT) -> DataFrame:
    """(doc_id, start, end, before, after): what stands around spans, ``most`` letters on each side."""
    both = spans.select("doc_id", "start", "end").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    before = F.substring("text", F.greatest(F.lit(1), F.col("start") - most + 1).cast("int"), F.least(F.lit(most), F.col("start")).cast("int"))
    after = F.substring("text", (F.col("end") + 1).cast("int"), F.lit(most))
    return both.select("doc_id", "start", "end", F.trim(before).alias("before"), F.trim(after).alias("after"))


def perplexity_penalty(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``scored`` (key, cand_no, score, log_perplexity) with ``score`` raised by what a model finds less likely than candidate 0.

    A key with a missing or impossible value, or with one candidate, stays as it is.
    """
    group = Window.partitionBy(key)
    lp = F.col("log_perplexity")
    fine = F.min(F.coalesce(lp.isNotNull() & ~F.isnan(lp) & (lp >= 0) & (lp < float("inf")), F.lit(False)).cast("int")).over(group) == 1
    source = F.max(F.when(F.col("cand_no") == 0, lp)).over(group)
    penalty = F.least(F.lit(float(PENALTY_MOST)), F.greatest(F.lit(0.0), lp - source) * PENALTY_MOST)
    return scored.withColumn("score", F.col("score") + F.when(fine & (F.count("*").over(group) > 1), penalty).otherwise(0.0))


def likelihoods(observer: np.ndarray, performer: np.ndarray, ids: np.ndarray) -> tuple[float, float, float]:
    """(log-perplexity of ids 1.. under ``performer``, its cross-entropy under ``observer``, their ratio).

    Rows are logits of positions 0..; positions whose id or values are impossible don't count; NaN without any.
    """
    n = min(len(observer), len(performer), len(ids)) - 1
    if n < 1 or observer.shape != performer.shape:
        return (float("nan"),) * 3
    o, p, goal = observer[:n].astype(float), performer[:n].astype(float), np.asarray(ids[1 : n + 1])
    weight = np.exp(o - o.max(axis=1, keepdims=True))
    top = p.max(axis=1)
    norm = top + np.log(np.exp(p - top[:, None]).sum(axis=1))
    able = (goal >= 0) & (goal < p.shape[1])
    nll = norm - p[np.arange(n), np.where(able, goal, 0)]
    cross = norm - (weight * p).sum(axis=1) / weight.sum(axis=1)
    able &= np.isfinite(nll) & np.isfinite(cross) & (cross > 0)
    if not able.any():
        return (float("nan"),) * 3
    a, b = float(nll[able].mean()), float(cross[able].mean())
    return a, b, a / b


def logit_scores(rows: DataFrame) -> DataFrame:
    """``row_id``, log_perplexity, perplexity, cross_entropy, binoculars of ``rows`` (row_id, observer, performer, ids, vocabulary).

    Logits are flat arrays, ``vocabulary`` values a position; shapes that don't fit and nulls give nulls.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for key, observer, performer, ids, size in batch.itertuples(index=False, name=None):
                fits = observer is not None and performer is not None and ids is not None and size and size > 1 and len(observer) == len(performer) and len(observer) % size == 0
                a, b, ratio = likelihoods(*(np.asarray(x, float).reshape(-1, int(size)) for x in (observer, performer)), np.asarray(ids)) if fits else (float("nan"),) * 3
                out.append((key, *(None if x != x else x for x in (a, np.exp(min(a, 50.0)), b, ratio))))
            yield pd.DataFrame(out, columns=["row_id", "log_perplexity", "perplexity", "cross_entropy", "binoculars"])

    return rows.select("row_id", "observer", "performer", "ids", "vocabulary").mapInPandas(run, "row_id long, log_perplexity double, perplexity double, cross_entropy double, binoculars double")
