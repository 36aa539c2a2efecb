"""Scores and metrics of a text in plain Python: one pass that tokenises once and counts from that.

Words, sentences and paragraphs are found once per text; every component and metric is a count over
them. Shapes of words are looked up in a bounded memory of words seen before.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import islice
from math import sqrt

from lexiflow.functions import lexicon as L
from lexiflow.functions import prose as P

#: Up to how many letters a text may have for its number of words to be kept.
SENTENCE = 600
COMPONENTS = ("em_dash", "burstiness", "cliche", "antithesis", "flatness", "discourse", "opener_repeat", "hedge", "paragraphs")
METRICS = tuple(L.ZONES["en"])
_GAP = P.GAP
_WORD, _FIRST = re.compile("[\\w-]+"), re.compile("(?:[^\\W_]|-)+")
_RANGE, _RANGE_ANY = (re.compile(f"[0-9]{_GAP}*[{d}]{_GAP}*[0-9]") for d in ("—–", "—–-"))
_CONNECTOR = re.compile(f"[—–]|(?<={_GAP})-(?={_GAP})")
_AFTER, _BLANK, _PART, _LINES = re.compile(f"(?<=[.!?…]){_GAP}+"), re.compile(f"^{_GAP}+|{_GAP}+$"), re.compile("\n{2,}"), re.compile("\n+")
_ITEM = re.compile(f"(?:[-*•▪◦]|[0-9]+[.)]){_GAP}+")
_LETTERS = "[^\\W\\d_]"
_NO_LETTERS = re.compile(f"^(?:(?!{_LETTERS})[\\s\\S])+")
_TRIAD = re.compile(f"[^,;:()]{{3}},[^,;:()]{{3,}},{_GAP}*(?:and|or|и|или|а также){_GAP}", re.I)
_CONTRAST = [{k: re.compile(v.replace("\\p{L}", _LETTERS).replace("\\b", "(?<![A-Za-z0-9_])"), re.I) for k, v in table.items()} for table in (L.ANTITHESIS_STRONG, L.ANTITHESIS_WEAK)]
_EDGED = {k: re.compile("(?<![\\w-])(?:" + v.replace("\\p{L}", _LETTERS).replace("\\s", _GAP) + ")(?![\\w-])") for k, v in L.PASSIVE.items()}
_SHAPES = {k: tuple(re.compile(t[k].replace("\\p{L}", _LETTERS)) for t in (L.NOMINAL, L.ABSTRACT)) for k in ("ru", "en")}
_LINKS = {"ru": tuple(L.DISCOURSE_RU), "en": tuple(L.DISCOURSE_EN)}
_HEDGES = {"ru": L.HEDGE_RU, "en": L.HEDGE_EN}
_CLICHES = {"ru": L.CLICHE_RU, "en": L.CLICHE_EN}


@lru_cache(maxsize=1 << 12)
def _few(text: str) -> int:
    return len(_WORD.findall(text))


def n_words(text: str) -> int:
    """Words of a text; those of sentences are kept for a while, as versions of a text share most of them."""
    return _few(text) if len(text) <= SENTENCE else len(_WORD.findall(text))


def strip(text: str) -> str:
    return _BLANK.sub("", text)


def spread(values: list[int], least: int = 3) -> float | None:
    """Population standard deviation over mean; None below ``least`` values or at mean 0."""
    if len(values) < least or not sum(values):
        return None
    mean = sum(values) / len(values)
    total = 0.0
    for v in values:
        total += (v - mean) * (v - mean)
    return sqrt(total / len(values)) / mean


def _capped(x: float) -> int:
    return int(min(100, max(0, x)))


def _hits(text: str, phrases: list[str]) -> int:
    return sum(text.count(p) for p in phrases)


def _linked(sentences: list[str], lang: str) -> int:
    """How many sentences begin with a link, within the first forty letters on from the first letter."""
    lower = (s.lower() for s in sentences)
    return sum((s if "a" <= s[:1] <= "z" else _NO_LETTERS.sub("", s)[:40]).startswith(_LINKS[lang]) for s in lower)


def _marks(text: str, singles: str) -> int:
    return sum(text.count(c) for c in singles) + sum(text.count(c) for c in "«»\"“”") // 2


@lru_cache(maxsize=1 << 17)
def _shape(word: str, lang: str) -> tuple[bool, bool]:
    """Whether a lower-case word is nominal, and abstract, by its ending."""
    nominal, abstract = _SHAPES[lang]
    return nominal.fullmatch(word) is not None, abstract.fullmatch(word) is not None


def _dashed(text: str) -> bool:
    return "-" in text or "–" in text or "—" in text


def dashes(text: str) -> int:
    """Dashes between words; those of number ranges don't count."""
    if not _dashed(text):
        return 0
    return len(_CONNECTOR.findall(_RANGE.sub("", text)))


def score(text: str, lang: str | None = None) -> dict[str, int]:
    """The components by name, and ``score``."""
    out = _lately(text, lang)
    return {k: out[k] for k in (*COMPONENTS, "score")}


@lru_cache(maxsize=8)
def _lately(text: str, lang: str | None) -> dict:
    """``scored``, kept while versions of a text are weighed against each other."""
    return scored(text, lang)


def scored(text: str, lang: str | None = None) -> dict:
    """language, n_words, n_sentences, n_dashes, the components and ``score`` of a text."""
    lang = lang or P.language(text)
    lower = text.lower()
    ss = [s for s in _AFTER.split(text) if s and not s.isspace()]
    n, lens = len(ss), [n_words(s) for s in ss]
    words, cv = sum(lens), spread([x for x in lens if x])
    out = {"language": lang, "n_words": words, "n_sentences": n, "n_dashes": dashes(text)} | dict.fromkeys(COMPONENTS, 0)
    out["em_dash"] = _capped((out["n_dashes"] - max(1, P.half_up(n * L.DASH_RATE[lang]))) * 50)
    out["burstiness"] = 0 if cv is None else _capped(P.half_up(max(0.0, (0.55 - cv) / 0.55) * 100))
    out["cliche"] = _capped(_hits(lower, _CLICHES[lang]) * 20)
    strong, weak = (len(p[lang].findall(text)) for p in _CONTRAST) if ("не" if lang == "ru" else "not") in lower else (0, 0)
    out["antithesis"] = _capped(max(0, strong - L.ANTITHESIS_FREE[lang]) * 45 + max(0, weak - 1) * 30)
    if n >= 4:
        gap = lambda floor, have: max(0.0, floor - have) / floor
        marks = _marks(_RANGE_ANY.sub("", text) if _dashed(text) else text, ":;()?!")
        out["flatness"] = _capped(P.half_up(50 * gap(L.MARK_FLOOR[lang], marks / n) + 50 * gap(L.LONG_FLOOR[lang], sum(x >= 35 for x in lens) / n)))
    if n:
        out["discourse"] = _capped((_linked(ss, lang) - max(1, P.half_up(n * L.DISCOURSE_RATE[lang]))) * 35)
    if n >= 3:
        firsts = Counter(m[0].lower() for s in ss if (m := _FIRST.match(s) or _FIRST.search(s)))
        out["opener_repeat"] = _capped(P.half_up(max(0.0, sum(c for c in firsts.values() if c > 1) / n - L.OPENER_RATE[lang]) * 300))
    if words:
        out["hedge"] = _capped(P.half_up(max(0.0, _hits(lower, _HEDGES[lang]) * 100 / words - L.HEDGE_RATE[lang]) * 35))
    parts = [n_words(p) for p in _PART.split(text) if strip(p)] if "\n\n" in text else []
    even = spread(parts)
    if len(parts) >= 3 and min(parts) >= 40 and even is not None and even < 0.3:
        out["paragraphs"] = _capped(P.half_up((0.3 - even) / 0.3 * 100))
    mixed = 0.0
    for k, w in L.WEIGHTS.items():
        mixed += out[k] * w
    return out | {"score": max(P.half_up(mixed), out["antithesis"])}


def repeated_share(words: list[str], size: int = 4) -> float:
    """Share of words inside n-grams that stand twice or more; 0 below two n-grams' worth of words."""
    if len(words) < 2 * size:
        return 0.0
    grams = list(zip(*(words[k:] for k in range(size)), strict=False))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0.0
    covered, last = 0, -size
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += min(size, i - last)
            last = i
    return covered / len(words)


def measured(text: str) -> dict:
    """language, n_words, n_sentences, every metric of a text (None where it can't be measured), and beside them
    the longest sentence's words, the spread of list items, and whether three or more of them are even."""
    lang, lower = P.language(text), text.lower()
    ss = [s for x in _AFTER.split(_LINES.sub(" ", text)) if (s := strip(x))]
    par = [s for x in _PART.split(text) if (s := strip(x))]
    n, sizes = len(ss), [n_words(s) for s in ss]
    lens, tokens = [x for x in sizes if x], _WORD.findall(lower)
    words = len(tokens)
    per = lambda x, base: x / base if base > 0 else 0.0
    shapes = Counter(_shape(w, lang) for w in tokens)
    nominal, abstract = (sum(c for s, c in shapes.items() if s[k]) for k in (0, 1))
    openers = Counter(" ".join(found) for s in ss if (found := [m[0] for m in islice(_FIRST.finditer(s.lower()), 2)]))
    dash = dashes(text)
    items = spread([n_words(x) for x in lines]) if len(lines := [x for x in map(strip, text.split("\n")) if _ITEM.match(x)]) >= 3 else None
    plain = _RANGE.sub("", text) if dash or any(c in text for c in "—–") else text
    return {
        "language": lang, "n_words": words, "n_sentences": n,
        "longest": max(lens, default=0), "list_cv": items, "even_list": items is not None and items < 0.15,
        "sentenceCv": spread(lens),
        "shortPerParagraph": per(sum(x < 6 for x in lens), len(par)),
        "discourseShare": per(_linked(ss, lang), n),
        "hedgeDensity": per(_hits(lower, _HEDGES[lang]) * 100, words),
        "nominalizationDensity": per((nominal + len(_EDGED[lang].findall(lower))) * 100.0, words),
        "paragraphCv": spread([n_words(p) for p in par]) if len(par) >= 3 else None,
        "openerRepeat": per(sum(c for c in openers.values() if c > 1), n),
        "ngramRepeat": repeated_share(tokens),
        "abstractShare": per(abstract, words),
        "dashShare": per(dash, dash + sum(plain.count(c) for c in ",:;(")),
        "punctInventory": per(_marks(_RANGE_ANY.sub("", text), ":;(?!"), n),
        "longSentences": per(sum(x >= 35 for x in lens), len(lens)),
        "triadShare": per(sum(s.count(",") > 1 and _TRIAD.search(s) is not None for s in ss), n),
    }
