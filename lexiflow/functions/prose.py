"""Texts in plain Python, for Arrow batches: spans, anchors, literal references, and guards over them.

Offsets count code points; null texts are the caller's to replace by empty ones. Everything here
takes time in proportion to the text, but for masks, which cost a search per reference.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import regex

from lexiflow.functions import lexicon as L

#: White space as the patterns of this engine mean it.
GAP = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
LEFT, RIGHT = "(?<![\\p{L}\\p{N}_-])", "(?![\\p{L}\\p{N}_-])"
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
WORD = regex.compile("[\\p{L}\\p{N}-]+")
WORD_ = regex.compile("[\\p{L}\\p{N}_-]+")
NAME = regex.compile("\\p{L}[\\p{L}\\p{N}'’-]+")
LETTER = regex.compile("\\p{L}")
ACRONYM = regex.compile(f"{LEFT}\\p{{Lu}}{{2,}}(?:-\\p{{Lu}}\\p{{N}}*)?{RIGHT}")
#: What follows a sentence is the first group; marks are found faster than the blanks behind them.
AFTER_SENTENCE = re.compile(f"[.!?…][\"»”')\\]]?({GAP}+)")
AFTER_MARK = re.compile(f"[.!?…]({GAP}+)")
_PARTS, _PLAIN_WORD, _BLANKS, _QUOTES = re.compile("(\n{2,})"), re.compile("[\\w-]+"), re.compile(f"{GAP}+"), re.compile("[«»\"'“”]")
#: Underscores, and scripts in which the two regular expression modules may not agree on what a letter is.
_RARE = re.compile("[_\u0530-\u1fff\u2070-\u209f\u2150-\U0010ffff]")
#: Letters that a search in either case takes for others, though their small letters differ; small letters tell nothing of a text with them.
_ODD = re.compile("[\u0130\u0131\u017f\u1c80-\u1c8a\u212a\ua64a\ua64b]")


@functools.lru_cache(maxsize=4096)
def pattern(body: str, flags: str = "i") -> regex.Pattern:
    """A compiled pattern in which ``_`` after a backslash stands for white space."""
    return regex.compile(body.replace("\\_", GAP), regex.IGNORECASE if "i" in flags else 0)


def lowered(text: str) -> str | None:
    """A text in small letters, for ``may_hold``; None where they don't tell what a search in either case finds."""
    return None if _ODD.search(text) else text.lower()


def may_hold(low: str | None, needle: str) -> bool:
    """Whether a search in either case for a pattern with ``needle`` in it is worth while; never false where it would find something."""
    return low is None or needle in low


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


#: Holds every Cyrillic letter, and is found fast.
_MAYBE_CYRILLIC = re.compile("[\u0400-\u052f\u1c80-\u1c8f\u1d2b\u1d78\u2de0-\u2dff\ua640-\ua69f\ufe2e\ufe2f\U0001e030-\U0001e08f]")
_CYRILLIC, _LATIN = (regex.compile(f"\\p{{Script={s}}}+") for s in ("Cyrillic", "Latin"))


def language(text: str) -> str:
    """ru where Cyrillic letters outnumber Latin ones, else en."""
    if not _MAYBE_CYRILLIC.search(text):
        return "en"
    cyrillic, latin = (sum(map(len, p.findall(text))) for p in (_CYRILLIC, _LATIN))
    return "ru" if cyrillic > latin else "en"


def n_words(text: str) -> int:
    return len(_words(text))


def _words(text: str) -> list[str]:
    return (WORD if _RARE.search(text) else _PLAIN_WORD).findall(text)


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word."""
    return [m.span() for m in (WORD if _RARE.search(text) else _PLAIN_WORD).finditer(text)]


def stems(text: str) -> set[str]:
    """Five-letter stems of the words that tell something."""
    return {w[:5] for w in _words(text.lower()) if len(w) >= 4 and w not in L.STOP_WORDS}


def shared(a: set[str], b: set[str]) -> float:
    """Overlap coefficient; 0 with an empty set."""
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def capital(text: str) -> str:
    """The first letter of a text in upper case."""
    m = LETTER.search(text)
    return text[: m.start()] + m[0].upper() + text[m.end() :] if m else text


@dataclass(frozen=True)
class Sentence:
    """A sentence at [start, end) of its text; ``gap`` is where the white space behind it ends."""

    start: int
    end: int
    gap: int
    text: str
    words: int


def split_at(text: str, gaps: re.Pattern) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of the gap behind) of what stands between gaps, a pattern's first group, and isn't blank."""
    at = 0
    for m in gaps.finditer(text):
        start, end = m.span(1)
        if text[at:start].strip():
            yield at, start, end
        at = end
    if text[at:].strip():
        yield at, len(text), len(text)


def sentences(text: str, offset: int = 0) -> list[Sentence]:
    return [Sentence(offset + a, offset + b, offset + c, text[a:b], n_words(text[a:b])) for a, b, c in split_at(text, AFTER_SENTENCE)]


def paragraphs(text: str) -> list[list[Sentence]]:
    """The sentences of each paragraph; blank lines part them."""
    return [sentences(text[a:b], a) for a, b, _ in split_at(text, _PARTS)]


# Anchors: what an edit may neither lose nor bring in.

# Addresses, citations and numbers.
FACTS = {
    "url": "https?://[^\\s<>()]+|www\\.[^\\s<>()]+",
    "citation": "\\([^()\\n]{2,80}?,\\s*[0-9]{4}[a-z]?\\)|\\[\\s*[0-9]+(?:\\s*[,–-]\\s*[0-9]+)*\\s*\\]",
    "date": L.EVIDENCE["date"].replace("\\b", EDGE),
    "version": L.EVIDENCE["version"].replace("\\b", EDGE),
    "number": "[0-9]+(?:[.,][0-9]+)?(?:\\s*%)?",
    "unit": "(?<=[0-9][\\s\\u00a0]?)(?:" + L.UNITS.replace("\\b", EDGE) + ")",
}
_FACTS = {k: regex.compile(v, 0 if k in ("citation", "number") else regex.IGNORECASE) for k, v in FACTS.items()}


#: The same facts for texts without ``_ODD`` letters, in patterns that begin with what is found fast; the last group is the fact.
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_ASCII_WORD = "[A-Za-z0-9_]"
_QUICK = {
    "url": "((?:https?://|www\\.)[^\\s<>()]+)".replace("[^\\s", "[^" + _SPACE[1:-1]),
    "date": f"(?<!{_ASCII_WORD})({L.EVIDENCE['date'].removeprefix(chr(92) + 'b')})".replace("\\s", _SPACE),
    "version": f"(?<!{_ASCII_WORD})(v?[0-9]+(?:\\.[0-9]+){{1,4}}){EDGE}",
    "unit": f"[0-9]{_SPACE}?({L.UNITS.replace(chr(92) + 'b', EDGE)})",
}
_QUICK = {k: re.compile(v, re.IGNORECASE) for k, v in _QUICK.items()}
#: What a text with such a fact has.
_SIGNS = {"url": re.compile("://|www\\.", re.IGNORECASE), "citation": re.compile("[(\\[]"), **dict.fromkeys(("date", "number", "unit"), re.compile("[0-9]")), "version": re.compile("[0-9]\\.[0-9]")}


def _facts(text: str, kind: str) -> list[str]:
    """All facts of a kind, as they stand."""
    if not _SIGNS[kind].search(text):
        return []
    quick = _QUICK.get(kind)
    return quick.findall(text) if quick and not _ODD.search(text) else [m[0] for m in _FACTS[kind].finditer(text)]


def plain_value(value: str) -> str:
    return _QUOTES.sub("", _BLANKS.sub(" ", value)).strip().lower()


def names(text: str) -> Iterator[str]:
    """Acronyms, and words with a capital inside a sentence that stand nowhere in small letters."""
    yield from (plain_value(x) for x in ACRONYM.findall(text))
    big = [w for a, b, _ in split_at(text, AFTER_MARK) for w in NAME.findall(text[a:b])[1:] if w[0] == w[0].upper() and w != w.upper()]
    big = [w.lower() for w in big if w.lower() not in L.OPENER_STOP]
    small = {w.lower() for w in (WORD_ if _RARE.search(text) else _PLAIN_WORD).findall(text) if len(w) > 1 and w[0] == w[0].lower()} if big else set()
    yield from (w for w in big if w not in small)


def anchors(text: str) -> list[tuple[str, str]]:
    """(type, value) of all anchors: url, citation, date, version, number, unit, proper."""
    return hard_anchors(text) + [("proper", n) for n in names(text)]


def hard_anchors(text: str) -> list[tuple[str, str]]:
    """The anchors but for names."""
    return [(kind, value) for kind in _FACTS for x in _facts(text, kind) if (value := plain_value(x))]


@dataclass(frozen=True)
class Compared:
    """What an edited text lost and gained, as (type, value, count); names are only noted."""

    lost: list[tuple[str, str, int]]
    added: list[tuple[str, str, int]]
    notes: list[tuple[str, str, int]]

    @property
    def ok(self) -> bool:
        return not self.lost and not self.added


@functools.lru_cache(maxsize=32)
def _facts_of(text: str) -> tuple[Counter, list[str]]:
    """(anchors but for names, values of the literal references) of a text; versions of one text are compared with it one by one."""
    return Counter(hard_anchors(text)), [v for *_, v in references(text)]


@functools.lru_cache(maxsize=32)
def _counted(text: str) -> tuple[Counter, list[str]]:
    """(anchors, values of the literal references) of a text."""
    facts, refs = _facts_of(text)
    return facts + Counter(("proper", n) for n in names(text)), refs


def intact(source: str, candidate: str) -> bool:
    """Whether ``compare`` finds nothing lost or added; names, which it only notes, aren't looked for."""
    return source == candidate or _facts_of(source) == _facts_of(candidate)


def compare(source: str, candidate: str) -> Compared:
    """The multiset difference of anchors; a changed sequence of literal references counts as a lost citation."""
    if source == candidate:
        return Compared([], [], [])
    (a, refs), (b, new_refs) = _counted(source), _counted(candidate)
    lost, added = ([(t, v, n) for (t, v), n in (x - y).items()] for x, y in ((a, b), (b, a)))
    notes = [x for x in (*lost, *added) if x[0] == "proper"]
    lost, added = ([x for x in rows if x[0] != "proper"] for rows in (lost, added))
    if refs != new_refs:
        lost.insert(0, ("citation", "literal references", 1))
    return Compared(lost, added, notes)


# Literal references.


@functools.lru_cache(maxsize=1)
def _finder():
    from lexiflow.operators.references import _Finder

    return _Finder()


def references(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of spans that edits leave as they are."""
    return [(a, b, text[a:b]) for a, b, _ in _finder().merged(text)] if text else []


def masked(text: str, edit: Callable[[str], str]) -> tuple[str, bool]:
    """(``edit`` of the text with its references out of reach, whether they came through); else the text itself."""
    spans = references(text)
    if not spans:
        return edit(text), True
    head = "\ue700REF"
    while head in text:
        head += "X"
    tokens = [f"{head}{chr(0xE800 + k % 256)}{'X' * (k // 256)}\ue701" for k in range(len(spans))]
    out, at = [], 0
    for (a, b, _), token in zip(spans, tokens, strict=True):
        out += [text[at:a], token]
        at = b
    found = edit("".join([*out, text[at:]]))
    for (*_, value), token in zip(spans, tokens, strict=True):
        if found.count(token) != 1:
            return text, False
        found = found.replace(token, value)
    intact = head not in found and [v for *_, v in spans] == [v for *_, v in references(found)]
    return (found, True) if intact else (text, False)


# Blanks that tidying closes up, in order, and what a text must hold for each to be found.
TIDY = (
    ("[ \u00a0\t]{2,}", " "), ("[ \u00a0\t]+([,.;:!?…])", "\\1"), ("([(«\"'])[ \u00a0]+", "\\1"), ("\n[ \u00a0\t]+", "\n"), ("[ \u00a0\t]+\n", "\n"), ("\n{3,}", "\n\n"),
)

_RARE_BLANKS = ("\u00a0", "\t")
TIDY_NEEDS = (
    ("  ", *_RARE_BLANKS), (*(f" {c}" for c in ",.;:!?…"), *_RARE_BLANKS), ("(", "«", '"', "'"), ("\n ", "\n\u00a0", "\n\t"), (" \n", "\u00a0\n", "\t\n"), ("\n\n\n",),
)


def tidy(text: str) -> str:
    for (body, to), needs in zip(TIDY, TIDY_NEEDS, strict=True):
        if any(x in text for x in needs):
            text = pattern(body, "").sub(to, text)
    if not text or not (_BLANKS.match(text[0]) or _BLANKS.match(text[-1])):
        return text
    return pattern(f"^{GAP}+|{GAP}+$", "").sub("", text)
