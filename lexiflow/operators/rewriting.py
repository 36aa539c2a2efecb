"""Rewriting: a phrase dictionary, structural steps, and the loop that keeps what lowers the score.

Everything works on one text and is made of steps that can be undone: a step's outcome is taken
only if facts, references, paragraphs and volume hold and the score doesn't get worse.

Scale: one document at a time in Arrow batches, in narrow stages; loops are bounded by the
document's sentences, never by jobs. Choices among variants follow a hash of the text, so a
retried task gives the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache, partial
from math import ceil, inf, lcm

import numpy as np
import regex
from pyspark.sql import DataFrame

from lexiflow.functions import measure as M
from lexiflow.functions import prose as P
from lexiflow.functions import rewrite_lexicon as R
from lexiflow.functions.phrase_lexicon import PHRASES
from lexiflow.functions.prose import LEFT, RIGHT, pattern
from lexiflow.operators import passes
from lexiflow.operators.passes import _mapped

_PROTECTED, _RANGE, _DASH = regex.compile(R.PROTECTED, regex.I), regex.compile(R.NUMBER_RANGE), regex.compile(R.DASH)
#: What a text has that holds something protected, or a number.
_MAYBE_PROTECTED, _DIGIT = re.compile("[\\[«“\"`]|://"), re.compile("[0-9]")
_PARTED, _LINED = regex.compile("(\n{2,})"), regex.compile("(\n+)")
_LIST, _ENDS = regex.compile(R.LIST_LINE), regex.compile("(?<=[.!?…])\\s+")
_CLOSE, _CLOSED = regex.compile("[.!?…][\"»”')\\]]*$"), regex.compile("[.!?…][\"»”')\\]]*\\s*$")


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 2166136261
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return h


class Shelter:
    """A text with addresses, brackets, quotes, code and, if asked, number ranges out of reach."""

    def __init__(self, text: str, ranges: bool = False, marks: tuple[str, str] = ("\ue100", "\ue101")) -> None:
        self.values: list[str] = []
        self.marks = marks
        self.text = _PROTECTED.sub(self._store, text) if _MAYBE_PROTECTED.search(text) else text
        if ranges and _DIGIT.search(self.text):
            self.text = _RANGE.sub(self._store, self.text)

    def _store(self, m: regex.Match) -> str:
        self.values.append(m[0])
        return f"{self.marks[0]}{len(self.values) - 1}{self.marks[1]}"

    def back(self, text: str) -> str:
        found = lambda m: self.values[int(m[1])] if int(m[1]) < len(self.values) else ""
        for _ in range(2 if len(self.values) else 0):  # a range may hold what was sheltered before it
            text = pattern(f"{self.marks[0]}([0-9]+){self.marks[1]}", "").sub(found, text)
        return text


# The dictionary.


@dataclass(frozen=True)
class Rule:
    pattern: regex.Pattern
    options: tuple[str, ...]
    varied: bool
    #: what every match has in small letters, at its start
    needle: str


def compiled(entries) -> list[Rule]:
    """Rules of (pattern, options, marks): bounded by words, on the right unless ``open``, in either case unless ``cased``."""
    out = []
    for body, options, *marks in entries:
        flags = 0 if "cased" in marks else regex.I
        out.append(Rule(regex.compile(LEFT + body + ("" if "open" in marks else RIGHT), flags), tuple(options), "varied" in marks, needle(body)))
    return out


def needle(body: str) -> str:
    """The letters and blanks that a pattern begins with; none where it has other branches or case rules of its own."""
    head = pattern("[A-Za-zА-Яа-яЁё' ]*", "").match(body)[0].lower()
    rest, depth = body[len(head) :], 0
    for c in pattern("\\\\.|\\[(?:\\\\.|[^\\]])*\\]", "").sub("", rest):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return ""
    return head[:-1] if rest[:1] in ("?", "*", "{") and rest else head


RULES = {lang: compiled(entries) for lang, entries in PHRASES.items()}


def with_case(source: str, option: str) -> str:
    """``option`` with a capital if the source's first letter has one."""
    m = P.LETTER.search(source)
    return P.capital(option) if m and m[0] == m[0].upper() else option


def _first_free(found: list[tuple]) -> Iterator[tuple]:
    """Of (start, end, ...) those that overlap none before; the longest of one start comes first."""
    last = -1
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= last:
            took = yield x
            last = last if took is False else x[1]


@lru_cache(maxsize=64)
def _places(paragraph: str, lang: str) -> tuple[Shelter, int, list[tuple]]:
    """(a paragraph with its shelter, its seed, (start, end, phrase, rule's number, rule) of each place of a dictionary phrase): the same for all versions.

    Without a place nothing depends on the seed, which is 0 then.
    """
    shelter = Shelter(paragraph)
    low = P.lowered(shelter.text)
    found = [(m.start(), m.end(), m[0], k, r) for k, r in enumerate(RULES[lang]) if (low is None or r.needle in low) for m in r.pattern.finditer(shelter.text)]
    return shelter, fnv1a(paragraph) if found else 0, found


def reworded(paragraph: str, lang: str, offset: int = 0) -> tuple[str, int]:
    """(a paragraph with dictionary phrases replaced, how many); short lines without a full stop stay. Mere variations are few."""
    words = M.n_words(paragraph)
    if words <= 12 and not _CLOSED.search(paragraph):
        return paragraph, 0
    shelter, seed, places = _places(paragraph, lang)
    if not places:
        return shelter.back(shelter.text), 0
    seed += offset
    found = [(a, b, with_case(source, r.options[(seed + k + a) % len(r.options)]), r.varied) for a, b, source, k, r in places]
    spare, chosen, last = min(3, max(1, ceil(words / 45))), [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= last and (spare or not x[3]):
            spare -= x[3]
            chosen.append(x)
            last = x[1]
    out, at = [], 0
    for start, end, option, _ in chosen:
        out += [shelter.text[at:start], option]
        at = end
    return shelter.back("".join([*out, shelter.text[at:]])), len(chosen)


def paraphrased(text: str, lang: str | None = None, offset: int = 0) -> tuple[str, int]:
    """(a text with dictionary phrases replaced, how many); the source if numbers, addresses or paragraphs changed."""
    lang, n, out = lang or P.language(text), 0, []
    for part in _PARTED.split(text):
        if not part.startswith("\n\n"):
            part, k = reworded(part, lang, offset)
            n += k
        out.append(part)
    made = "".join(out)
    if made == text:
        return text, n
    kept = lambda body: sorted(x.lower() for x in pattern(body, "").findall(text)) == sorted(x.lower() for x in pattern(body, "").findall(made))
    same = kept("[0-9]+(?:[.,][0-9]+)?") and kept("(?i)https?://[^\\s<>()]+") and len(pattern("\n{2,}", "").split(text)) == len(pattern("\n{2,}", "").split(made))
    return (made, n) if same else (text, 0)


def _cycle(text: str, lang: str) -> int:
    """After how many offsets the paraphrases of a text come again: each place goes through its options in turn."""
    return lcm(*(len(r.options) for part in _PARTED.split(text) if not part.startswith("\n\n") for *_, r in _places(part, lang)[2]))


def variants(text: str, lang: str | None = None, limit: int = 3) -> list[str]:
    """Distinct paraphrases, six at most, by moving the choice among options along."""
    lang, wanted, out = lang or P.language(text), max(1, min(limit, 6)), []
    for offset in range(min(wanted * 3, _cycle(text, lang))):
        made = paraphrased(text, lang, offset)[0]
        if made not in out:
            out.append(made)
        if len(out) == wanted:
            break
    return out


def replacement_options(text: str, lang: str | None = None) -> list[tuple[str, list[str], list[str]]]:
    """(phrase, options, texts with one option each) of every place that has a choice."""
    shelter, _, places = _places(text, lang or P.language(text))
    found = [(a, b, source, [with_case(source, o) for o in r.options]) for a, b, source, _, r in places if len(r.options) > 1]
    return [(source, options, [shelter.back(shelter.text[:a] + o + shelter.text[b:]) for o in options]) for a, b, source, options in _first_free(found)]


# Structure: lines of sentences.


@dataclass
class Line:
    """A line's sentences, or with ``gap`` the line breaks between two."""

    sentences: list[str] = field(default_factory=list)
    listed: bool = False
    gap: str = ""


def _parts(text: str) -> list[str]:
    return [s for s in _ENDS.split(text) if s]


def lines_of(text: str) -> list[Line]:
    return [Line(gap=x) if x.startswith("\n") else Line(_parts(x), _LIST.match(x) is not None) for x in _LINED.split(text)]


def joined(lines: list[Line]) -> str:
    return "".join(x.gap or " ".join(x.sentences) for x in lines)


def _word(text: str) -> str:
    m = _LETTERS.search(text)
    return m[0].lower() if m else ""


def _small(text: str) -> str:
    m = P.LETTER.search(text)
    return text[: m.start()] + m[0].lower() + text[m.end() :] if m else text


def undashed(sentence: str, lang: str, budget: int) -> tuple[str, int]:
    """(a sentence with one dash, or a pair, put otherwise; how many went): commas for a short aside, a sentence of its own for a clause, brackets for a tail."""
    at = [] if _LIST.match(sentence) else [m.span() for m in _DASH.finditer(sentence)]
    if budget <= 0 or not at:
        return sentence, 0
    if len(at) == 2 and budget >= 2:
        inner = sentence[at[0][1] : at[1][0]]
        if "," not in inner and 1 <= M.n_words(inner) <= 12:
            return f"{sentence[: at[0][0]].rstrip()}, {inner.strip()}, {sentence[at[1][1] :].lstrip()}", 2
    for a, b in at:
        head, tail = sentence[:a].rstrip(), sentence[b:].lstrip()
        first, n = _word(tail), M.n_words(tail)
        if not head or not tail or first in R.COPULA[lang] or M.n_words(head) < 3:
            continue
        bare = pattern("[,;:]$", "").sub("", head)
        if first in R.LINKS[lang] and n >= R.SPLIT_LEAST:
            link, rest = R.LINKS[lang][first], pattern("^[\\s,]+", "").sub("", tail[len(first) :])
            return f"{bare}. {f'{link} {rest}' if link else P.capital(rest)}", 1
        if first in R.STARTERS[lang] and n >= 3 or n >= R.SPLIT_LEAST and pattern(R.FINITE[lang]).search(tail):
            return f"{bare}. {P.capital(tail)}", 1
        close = _CLOSE.search(tail)
        if (a, b) == at[-1] and close and "(" not in tail and ")" not in tail and 2 <= n <= 20:
            body = pattern("[\\s,;:]+$", "").sub("", tail[: close.start()])
            if body:
                return f"{bare} ({body}){close[0]}", 1
    return sentence, 0


def undash(lines: list[Line], lang: str) -> int:
    """Put dashes otherwise until about one in five sentences has one; how many went."""
    every = [s for x in lines for s in x.sentences]
    budget = start = len(_DASH.findall(" ".join(every))) - max(1, P.half_up(len(every) / 5))
    for line in lines:
        if line.listed or budget <= 0:
            continue
        out: list[str] = []
        for s in line.sentences:
            for _ in range(4):
                s, used = undashed(s, lang, budget)
                budget -= used
                if not used:
                    break
            out += _parts(s)
        line.sentences = out
    return max(0, start) - max(0, budget) if start > 0 else 0


def fold_contrasts(lines: list[Line], lang: str) -> int:
    """Rhetorical contrasts as plain pairs; how many."""
    n = 0
    for line in lines:
        for k, s in enumerate(line.sentences):
            for body, to in R.ANTITHESIS[lang]:
                s, used = pattern(LEFT + body).subn(to, s)
                n += used
            line.sentences[k] = s
    return n


@lru_cache(maxsize=4)
def _linked(lang: str, loose: bool) -> tuple[dict[str, str], regex.Pattern]:
    """(what stands for a link at a sentence's start, where a comma and a link stand)."""
    links = R.LINKS[lang] | (R.LOOSE_LINKS[lang] if loose else {})
    return links, pattern(f",\\s+({'|'.join(links)})\\s+")


_DOT = regex.compile("\\.([\"»”')\\]]*)$")


def _split(sentence: str, lang: str, loose: bool) -> tuple[str, str] | None:
    """A sentence as two, at a semicolon or at a link before a clause of its own."""
    enough = lambda a, b: min(M.n_words(a), M.n_words(b)) >= R.SPLIT_LEAST
    head, mark, tail = sentence.partition("; ")
    if head and mark and enough(head, tail):
        return f"{head}.", P.capital(tail)
    if "," not in sentence:
        return None
    links, linked = _linked(lang, loose)
    m = linked.search(sentence)
    if m and m.start():
        head, tail = sentence[: m.start()], sentence[m.end() :]
        if (_word(tail) in R.STARTERS[lang] or pattern("\\p{Lu}", "").match(tail)) and enough(head, tail):
            link = links[m[1].lower()]
            return f"{head}.", f"{link} {_small(tail)}" if link else P.capital(tail)
    return None


def _merged(first: str, second: str, lang: str, words: int | None = None) -> str | None:
    """Two sentences as one, if the second begins with a word that may lose its capital; ``words``: how many they have, if known. The one has as many."""
    if (M.n_words(first) + M.n_words(second) if words is None else words) > R.MERGE_MOST or _word(second) not in R.SAFE_LOWER[lang]:
        return None
    m = _DOT.search(first)
    if not m:
        return None
    return f"{first[: m.start()]}{m[1]}; {_small(second)}"


def _cv(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Spread over mean from counts and sums; infinite below three values."""
    mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
    var = np.maximum(np.divide(squares, n, out=np.zeros(len(n)), where=n > 0) - mean**2, 0)
    return np.where((n >= 3) & (mean > 0), np.sqrt(var) / np.where(mean > 0, mean, 1), np.inf)


def tune_rhythm(lines: list[Line], lang: str, loose: bool = False) -> tuple[int, int]:
    """(splits, merges): the step that spreads sentence lengths most, again and again, up to a share of the sentences.

    The sums over lengths are carried along, so a step costs one look at each sentence's own changes.
    """
    place = [(x, k) for x in lines if not x.listed for k in range(len(x.sentences))]
    if len(place) < 3:
        return 0, 0
    texts = [x.sentences[k] for x, k in place]
    owner = [id(x) for x, _ in place]
    size = [M.n_words(t) for t in texts]
    split = [_split(t, lang, loose) for t in texts]
    both = lambda i: _merged(texts[i], texts[i + 1], lang, size[i] + size[i + 1]) if i + 1 < len(texts) and owner[i] == owner[i + 1] else None
    merge = [both(i) for i in range(len(texts))]
    count = lambda values: (sum(v > 0 for v in values), sum(values), sum(v * v for v in values))
    now, done = np.array(count(size), float), [0, 0]
    change = lambda new, old: tuple(a - b for a, b in zip(count(new), count(old), strict=True))
    none = (np.nan,) * 3  # where a sentence has no such step
    own = lambda i: (change([M.n_words(p) for p in split[i]], size[i : i + 1]) if split[i] else none, change([size[i] + size[i + 1]], size[i : i + 2]) if merge[i] else none)
    rows = lambda places: np.array([own(i) for i in places], float).reshape(-1, 2, 3)
    delta = rows(range(len(texts)))
    for _ in range(max(1, P.half_up(len(place) * R.OPERATIONS))):
        cv = float(_cv(*(np.array([v]) for v in now))[0])
        options = np.flatnonzero(~np.isnan(delta[:, :, 0]))
        if cv >= R.RHYTHM_CV or not len(options):
            break
        after = now + delta.reshape(-1, 3)[options]
        values = _cv(after[:, 0], after[:, 1], after[:, 2])
        best = int(np.argmax(values))
        if values[best] <= cv + 1e-6:
            break
        i, kind = divmod(int(options[best]), 2)
        now, done[kind] = now + delta[i, kind], done[kind] + 1
        fresh, gone = (list(split[i]), 1) if kind == 0 else ([merge[i]], 2)
        texts[i : i + gone], owner[i : i + gone] = fresh, [owner[i]] * len(fresh)
        size[i : i + gone], split[i : i + gone] = [M.n_words(t) for t in fresh], [_split(t, lang, loose) for t in fresh]
        merge[i : i + gone] = [None] * len(fresh)
        near = range(max(0, i - 1), min(len(texts), i + len(fresh)))
        for j in near:
            merge[j] = both(j)
        delta = np.concatenate([delta[: near.start], rows(near), delta[i + gone :]])
    of: dict[int, list[str]] = {o: [] for o in (id(x) for x in lines)}
    for t, o in zip(texts, owner, strict=True):
        of[o].append(t)
    for x in lines:
        if not x.listed and x.sentences:
            x.sentences = of[id(x)]
    return done[0], done[1]


_LETTERS = regex.compile("\\p{L}+")
_HEAD = regex.compile("[\\p{L}\\p{N}][\\p{L}\\p{N}'’-]*")
_STOPS, _NAMED, _MARKED = regex.compile("[;:—–(«\"]"), regex.compile("[\\p{L}\\p{N}'’-]+"), regex.compile("[.!?…]")


def _opener(sentence: str) -> str:
    m = _HEAD.search(sentence)
    return m[0].lower() if m else ""


@lru_cache(maxsize=2)
def _adverbials(lang: str) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """An adverbial at a sentence's start before a comma, one there with a noun of time, and one at its end."""
    heads, nouns = "|".join(R.FRONT[lang]), "|".join(R.FRONT_NOUNS[lang])
    between = f"{R.ADVERBIAL_LEAST - 2},{R.ADVERBIAL_MOST - 2}"
    return (
        pattern(f"^(?:{heads})\\s+[^,;:—–]{{2,50}},\\s+(?=\\p{{L}})"),
        pattern(f"^(?:{heads})\\s+(?:[\\p{{L}}\\p{{N}}-]+\\s+){{0,2}}(?:{nouns}){RIGHT},?\\s+(?=\\p{{L}})"),
        pattern(f"{LEFT}({heads})\\s+((?:[\\p{{L}}\\p{{N}}-]+\\s+){{{between}}}[\\p{{L}}\\p{{N}}-]+)\\s*([.!?…][\"»”')\\]]?)$"),
    )


def _moved_back(sentence: str, lang: str) -> str | None:
    """A sentence with its leading adverbial at the end."""
    before_comma, with_noun, _ = _adverbials(lang)
    m = before_comma.match(sentence) or with_noun.match(sentence)
    if not m:
        return None
    phrase, rest = pattern("[\\s,]+$", "").sub("", m[0]), sentence[m.end() :]
    if M.n_words(rest) < R.REST_LEAST or _STOPS.search(phrase):
        return None
    tail = pattern("([.!?…][\"»”')\\]]?)\\s*$", "").sub("", rest)
    return f"{P.capital(tail)} {_small(phrase)}{rest[len(tail) :]}"


def _moved_front(sentence: str, lang: str, plain: Callable[[], set[str]]) -> str | None:
    """A sentence with its trailing adverbial in front, if its first word is no name; ``plain`` tells the words that stand in small letters somewhere."""
    if not _MARKED.search(sentence[-3:]):
        return None
    m = _adverbials(lang)[2].search(sentence)
    if not m or pattern("[,;:—–(«\"]", "").search(m[0]):
        return None
    head = pattern("[\\s,]+$", "").sub("", sentence[: m.start()])
    if M.n_words(head) < R.REST_LEAST or _opener(head) not in plain():
        return None
    return f"{P.capital(f'{m[1]} {m[2]}')}{'' if lang == 'ru' else ','} {_small(head)}{m[3]}"


def vary_openers(lines: list[Line], lang: str) -> int:
    """Where a sentence begins like the one before it, an adverbial changes ends; how many did. Left to right, so a change shows to the next."""
    place = [(x, k) for x in lines if not x.listed for k in range(len(x.sentences))]
    source = [x.sentences[k] for x, k in place]
    plain = cache(lambda: {w.lower() for s in source for w in _NAMED.findall(s) if w[0] == w[0].lower()})
    n, last = 0, None
    for (x, k), s in zip(place, source, strict=True):
        opener = _opener(s)
        if opener == last:
            moved = _moved_back(s, lang) or _moved_front(s, lang, plain)
            if moved:
                x.sentences[k], opener, n = moved, _opener(moved), n + 1
        last = opener
    return n


def random_source(seed: int) -> Callable[[int, int], int]:
    """A 32-bit xorshift generator: each call gives a number from least to most."""
    state = seed or 1

    def draw(least: int, most: int) -> int:
        nonlocal state
        state ^= (state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state ^= (state << 5) & 0xFFFFFFFF
        return least + state % (most - least + 1)

    return draw


def reflow(text: str, loose: bool = False) -> tuple[str, int]:
    """(a text with long paragraphs parted unevenly, how many came up); only where paragraphs are of much the same length."""
    found = [p.strip() for p in pattern("\n[ \t]*\n+", "").split(text) if p.strip()]
    even = M.spread([w for p in found if (w := M.n_words(p))])
    if not found or (inf if even is None else even) >= R.PARAGRAPH_CV:
        return text, 0
    draw, short, out, created = random_source(fnv1a(text)), False, [], 0
    for p in found:
        ss = [] if _LIST.match(p) or "\n" in p or M.n_words(p) <= R.PARAGRAPH_MOST else _parts(pattern("\\s+", "").sub(" ", p).strip())
        if len(ss) <= 1:
            out.append(p)
            continue
        blocks, own, n, target = [], [], 0, draw(R.PARAGRAPH_LEAST, R.PARAGRAPH_MOST)
        for s in ss:
            words = M.n_words(s)
            if own and n >= R.PARAGRAPH_LEAST and n + words > target:
                blocks.append(" ".join(own))
                own, n, target = [], 0, draw(R.PARAGRAPH_LEAST, R.PARAGRAPH_MOST)
            own.append(s)
            n += words
        tail = " ".join(own)
        if blocks and loose and not short and M.n_words(tail) >= R.SHORT_TAIL:
            short = True
            blocks.append(tail)
        elif blocks and n < R.PARAGRAPH_LEAST:
            blocks[-1] += f" {tail}"
        else:
            blocks.append(tail)
        created += len(blocks) - 1
        out += blocks
    return "\n\n".join(out), created


def loosen(text: str, lang: str) -> tuple[str, int]:
    """Bookish openers as plain ones; how many."""
    n = 0
    for opener, plain in R.BOOKISH[lang]:
        text, k = pattern(f"(?<=^|[.!?…][\"»”')\\]]?\\s){opener},?\\s", "").subn(plain, text)
        n += k
    return text, n


STEPS = ("dashes", "antithesis", "rhythm", "openers", "paragraphs")


def rewrite(text: str, steps: tuple[str, ...] = STEPS[:4], lang: str | None = None, loose: bool = False) -> tuple[str, dict[str, int]]:
    """(a text after structural steps, what each did); quotes, addresses, code and number ranges are out of reach."""
    done = dict.fromkeys(("dashes", "antithesis", "splits", "merges", "openers", "paragraphs", "loosened"), 0)
    if not text.strip():
        return text, done
    lang = lang or P.language(text)
    shelter = Shelter(text, ranges=True, marks=("\ue200", "\ue201"))
    lines = lines_of(shelter.text)
    if "dashes" in steps:
        done["dashes"] = undash(lines, lang)
    if "antithesis" in steps:
        done["antithesis"] = fold_contrasts(lines, lang)
    if "rhythm" in steps:
        done["splits"], done["merges"] = tune_rhythm(lines, lang, loose)
    if "openers" in steps:
        done["openers"] = vary_openers(lines, lang)
    out = shelter.back(joined(lines))
    if "paragraphs" in steps:
        out, done["paragraphs"] = reflow(out, loose)
    if loose:
        out, done["loosened"] = loosen(out, lang)
    return out, done


def layered(text: str, layers: Iterable[tuple[str, ...]], lang: str | None = None) -> Iterator[str]:
    """``text`` after each of ``layers``, as ``rewrite`` has it; a step that several have in common is done once, and what changed nothing isn't done again."""
    lang = lang or P.language(text)
    if not text.strip():
        yield from (text for _ in layers)
        return
    shelter = Shelter(text, ranges=True, marks=("\ue200", "\ue201"))
    work = {"dashes": undash, "antithesis": fold_contrasts, "rhythm": tune_rhythm, "openers": vary_openers}
    states, after, texts = [lines_of(shelter.text)], {}, {}
    for steps in layers:
        at = 0
        for step in (s for s in work if s in steps):
            if (at, step) not in after:
                lines = [Line([*x.sentences], x.listed, x.gap) for x in states[at]]
                work[step](lines, lang)
                if lines != states[at]:
                    states.append(lines)
                after[at, step] = at if lines == states[at] else len(states) - 1
            at = after[at, step]
        if at not in texts:
            texts[at] = shelter.back(joined(states[at]))
        yield texts[at]


# The loop.

# The score to reach, rounds, tries of an action, weights of components in the choice of an action.
TARGET, QUIET, ROUNDS, TRIES = {"ru": 0, "en": 5}, {"ru": 5, "en": 13}, 12, 3
ACTIONS = {
    "antithesis": ("antithesis", 0.0), "dash": ("em_dash", 0.26), "rhythm": ("burstiness", 0.22), "cliche": ("cliche", 0.16), "flatness": ("flatness", 0.14),
    "discourse": ("discourse", 0.11), "hedge": ("hedge", 0.06), "paragraphs": ("paragraphs", 0.06),
}
PASS_ACTIONS = {"discourse": ("connectives", "reduction"), "hedge": ("reduction",), "flatness": ("period", "punctuation")}
DELETING = ("cliche", "discourse", "hedge")
LEAST_ALL, LEAST_DELETING, LEAST_STEP, MOST_VOLUME, LOOSE_BELOW = 0.65, 0.6, 0.9, 1.25, 3


def volume_kept(source: str, result: str, least: float) -> bool:
    words = M.n_words(source)
    return not words or least <= M.n_words(result) / words <= MOST_VOLUME


def broken(source: str, result: str, least: float = 0.85, reflows: bool = False) -> list[str]:
    """What a step broke: ``empty`` text, ``anchors``, ``paragraphs``, ``volume``."""
    count = lambda t: len(pattern("\n{2,}", "").split(t))
    checks = {
        "empty": not result.strip(),
        "anchors": not P.intact(source, result),
        "paragraphs": not reflows and count(source) != count(result),
        "volume": not volume_kept(source, result, least),
    }
    return [k for k, bad in checks.items() if bad]


def next_action(score: dict[str, int], tries: dict[str, int]) -> str | None:
    """The action whose component weighs most; a contrast that sets the score comes first, a lesser one last."""
    mixed = sum(score[c] * (0.10 if a == "discourse" else w) for a, (c, w) in ACTIONS.items())
    weight = {a: w * score[c] for a, (c, w) in ACTIONS.items()}
    if score["antithesis"]:
        weight["antithesis"] = score["antithesis"] + 1000 if score["antithesis"] > mixed else 0.5
    able = [a for a, w in weight.items() if w > 0 and tries[a] > 0]
    return max(able, key=lambda a: weight[a], default=None)


def act(action: str, text: str, lang: str, loose: bool | Callable[[], bool] = False) -> str:
    """A text after one action; the text itself if there is nothing to do."""
    if action in PASS_ACTIONS:
        for kind in PASS_ACTIONS[action]:
            out, n = passes.apply_pass(text, kind, lang) if passes.may_apply(text, kind, lang) else (text, 0)
            if n:
                return out
        return text
    if action == "cliche":
        return paraphrased(text, lang)[0]
    return rewrite(text, ({"dash": "dashes"}.get(action, action),), lang, loose() if callable(loose) else loose)[0]


@dataclass(frozen=True)
class Humanized:
    text: str
    lang: str
    before: int
    after: int
    target: int
    #: (action, score afterwards, whether it was taken)
    rounds: tuple[tuple[str, int, bool], ...]


def humanized(text: str, lang: str | None = None, loose: bool | Callable[[], bool] = False, rounds: int = ROUNDS) -> Humanized:
    """The weightiest action, again and again, until the target is reached; only steps that keep the facts and better the score or their component.

    ``loose`` may be a function, which is asked when a step depends on it.
    """
    lang = lang or P.language(text)
    source, now = text, M.score(text, lang)
    before, tries, log = now["score"], dict.fromkeys(ACTIONS, TRIES) | {"paragraphs": 1}, []
    for _ in range(rounds):
        action = next_action(now, tries) if now["score"] > TARGET[lang] else None
        if not action:
            break
        tries[action] -= 1
        out = act(action, text, lang, loose)
        floor = LEAST_DELETING if action in DELETING else LEAST_STEP
        if out == text or broken(source, out, LEAST_ALL, action == "paragraphs") or not volume_kept(text, out, floor):
            tries[action] = 0
            log.append((action, now["score"], False))
            continue
        new, part = M.score(out, lang), ACTIONS[action][0]
        taken = new["score"] < now["score"] or new["score"] == now["score"] and new[part] < now[part]
        if taken:
            text, now = out, new
        elif new["score"] <= now["score"]:
            tries[action] = 0
        log.append((action, now["score"], taken))
    return Humanized(text, lang, before, now["score"], TARGET[lang], tuple(log))


def loose_needed(text: str) -> bool:
    """Whether a text has too few facts to sound bookish."""
    words = P.n_words(text)
    return bool(words) and len(P.anchors(text)) * 100 / words < LOOSE_BELOW


# Closed phrases.

# Inflected phrases, and clauses that must open a sentence.
GRAMMAR = [
    ("проводит анализ рынка", "анализирует рынок"), ("проводят анализ рынка", "анализируют рынок"), ("осуществляет анализ рынка", "анализирует рынок"),
    ("осуществляют анализ рынка", "анализируют рынок"), ("оказывает поддержку малому бизнесу", "поддерживает малый бизнес"),
    ("оказывают поддержку малому бизнесу", "поддерживают малый бизнес"), ("является причиной задержек", "вызывает задержки"), ("являются причиной задержек", "вызывают задержки"),
]
CLAUSES = [
    ("наблюдается рост выручки", "выручка растёт"), ("наблюдается снижение выручки", "выручка снижается"), ("наблюдается рост спроса", "спрос растёт"),
    ("наблюдается снижение спроса", "спрос снижается"),
]
QUOTED = "«[^»]*»|„[^“]*“|“[^”]*”|\"[^\"\\n]*\"|'[^'\\n]*'|‘[^’]*’|`[^`]*`"
HEDGED, NO_PROSE = "(?i)(?:не|возможно|вероятно|иногда|всегда)\\s*$", "\\s*(?:#|>|\\||[-*+] |[0-9]+[.)] )"


def grammar_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of closed phrases at a clause's end, outside quotes, references, lists and headings."""
    out: list[tuple[int, int, str]] = []
    places = [(m, to, opens) for pairs, opens in ((GRAMMAR, False), (CLAUSES, True)) for phrase, to in pairs for m in pattern(LEFT + phrase.replace(" ", "[ \\u00a0]+") + "(?=[ \\u00a0]*(?:[.!?;]|$))").finditer(text)]
    if not places:
        return out
    away = [(a, b) for a, b, _ in P.references(text)] + [m.span() for m in pattern(QUOTED, "").finditer(text)]
    for m, to, opens in places:
        start, end = m.span()
        line_at = text.rfind("\n", 0, start) + 1
        line, before = text[line_at:].split("\n", 1)[0], text[line_at:start]
        low = m[0].lower()
        if any(start < b and end > a for a, b in away) or m[0] not in (low, low[0].upper() + low[1:]):
            continue
        if pattern(NO_PROSE, "").match(line) or not pattern("[.!?;]\\s*$", "").search(line):
            continue
        if opens and (before.strip() and not pattern("[.!?]\\s*$", "").search(before) or pattern(HEDGED, "").search(before)):
            continue
        out.append((start, end, to[0].upper() + to[1:] if m[0][0] != low[0] else to))
    return sorted(out)


def grammatical(text: str) -> tuple[str, int]:
    edits = grammar_edits(text)
    for start, end, to in reversed(edits):
        text = text[:start] + to + text[end:]
    return text, len(edits)


@dataclass(frozen=True)
class Revised:
    text: str
    lang: str
    before: int
    after: int
    replaced: int
    #: why the cleaned or the given text was put back, or nothing
    reverted: str


def revised(source: str, cleaned: str, typeset: Callable[[str], str], terms: tuple[str, ...] = ()) -> Revised:
    """From a cleaned text: dictionary, verbs for nouns, closed phrases, typography, the loop; taken only if score, terms and references hold.

    A regression or a changed reference puts the cleaned text back, a changed term the source.
    """
    lang = P.language(cleaned)
    text, n = cleaned, 0

    def words(t: str) -> str:
        nonlocal n
        out, n = paraphrased(t, lang)
        return out

    text, _ = P.masked(text, words)
    text = passes.apply_pass(text, "denominalization", lang)[0]
    text, _ = grammatical(text)
    text = typeset(text)
    out = humanized(text, lang, cache(partial(loose_needed, text))).text
    before, after, why = M.score(cleaned, lang)["score"], M.score(out, lang)["score"], ""
    if after > before:
        out, why = cleaned, "score"
    if any(len(pattern(f"{LEFT}{regex.escape(t)}{RIGHT}").findall(source)) != len(pattern(f"{LEFT}{regex.escape(t)}{RIGHT}").findall(out)) for t in terms):
        out, why = source, "terms"
    if [v for *_, v in P.references(source)] != [v for *_, v in P.references(out)]:
        out, why = cleaned, "references"
    return Revised(out, lang, before, M.score(out, lang)["score"], n, why)


# Tables.


def paraphrased_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, replacements): every document through the phrase dictionary; null texts are empty."""
    return _mapped(docs, "doc_id long, text string, replacements long", lambda i, t: [(i, *paraphrased(t))])


def document_variants(docs: DataFrame, limit: int = 3) -> DataFrame:
    """(doc_id, variant, text): up to ``limit`` distinct paraphrases of each document, six at most."""
    return _mapped(docs, "doc_id long, variant int, text string", lambda i, t: [(i, k, v) for k, v in enumerate(variants(t, limit=limit))])


def option_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, place, phrase, option, text): a row for every option of every place that has a choice."""
    rows = lambda i, t: [(i, k, s, o, v) for k, (s, os_, vs) in enumerate(replacement_options(t)) for o, v in zip(os_, vs, strict=True)]
    return _mapped(docs, "doc_id long, place int, phrase string, option string, text string", rows)


def rewritten_documents(docs: DataFrame, steps: tuple[str, ...] = STEPS[:4], loose: bool = False) -> DataFrame:
    """(doc_id, text, dashes, antithesis, splits, merges, openers, paragraphs, loosened): every document after the structural steps."""
    names = ("dashes", "antithesis", "splits", "merges", "openers", "paragraphs", "loosened")

    def rows(i: int | None, t: str) -> list[tuple]:
        out, done = rewrite(t, steps, None, loose)
        return [(i, out, *(done[k] for k in names))]

    return _mapped(docs, "doc_id long, text string, " + ", ".join(f"{k} int" for k in names), rows)


def humanized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, language, before, after, reached, rounds, taken): every document after the loop; ``rounds`` lists actions tried, ``taken`` counts those kept."""

    def rows(i: int | None, t: str) -> list[tuple]:
        h = humanized(t, loose=cache(partial(loose_needed, t)))
        return [(i, h.text, h.lang, h.before, h.after, h.after <= h.target, ",".join(a for a, *_ in h.rounds), sum(x[2] for x in h.rounds))]

    return _mapped(docs, "doc_id long, text string, language string, before int, after int, reached boolean, rounds string, taken int", rows)


def revised_documents(docs: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, language, before, after, replacements, reverted): the whole revision of every document, cleaning and typography included."""
    from lexiflow.operators import cleaning

    def rows(i: int | None, t: str) -> list[tuple]:
        r = revised(t, cleaning.cleaned(t)[0], cleaning.typeset, terms)
        return [(i, r.text, r.lang, r.before, r.after, r.replaced, r.reverted)]

    return _mapped(docs, "doc_id long, text string, language string, before int, after int, replacements long, reverted string", rows)
