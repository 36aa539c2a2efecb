"""Edit passes: spans that could be shortened, joined, parted or put plainly, and their application.

A pass never changes a text. It proposes spans with what would stand there instead, how sure it
is, and which letter needs a capital then. Overlaps are settled, some proposals are accepted
beforehand, and ``applied`` splices accepted ones in: from the end, with blanks tidied, and only
if no number, date, address, unit or literal reference came or went; else the text stays.

Scale: each document is worked on by itself in Arrow batches, in narrow stages; proposals of a
document are as many as its places, without a cap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import edit_lexicon as E
from lexiflow.functions import prose as P
from lexiflow.functions.prose import LEFT, RIGHT, pattern

# The number of each pass, and which wins among edits of one span.
METHOD = {"reduction": 18, "connectives": 21, "denominalization": 22, "punctuation": 23, "period": 24, "rhythm": 19}
PRIORITY = {"reduction": 1, "connectives": 2, "denominalization": 3, "punctuation": 4, "period": 5, "rhythm": 6}
# Word limits of sentences that are parted, joined, or strung together.
SPLIT_FROM, SPLIT_PART, JOIN_PART, LONG, JOIN_SOFT, SERIES_MOST, REPEAT_FROM, CONNECTIVE_REST = 30, 5, 8, 35, 28, 90, 8, 4
REPEAT_SHARE, SUMMARY_SHARE, DISCOURSE_MOST, TRIADS_FROM = 0.6, 0.5, 0.15, 3


@dataclass(frozen=True)
class Edit:
    """``after`` for the span [start, end); ``capital``: which letter on from the start gets a capital."""

    kind: str
    start: int
    end: int
    after: str
    reason: str
    sure: bool
    capital: int | None = None
    long: bool = False
    accepted: bool = False
    kept: bool = False


class Draft:
    """A text with its language, its paragraphs' sentences and the spans that stay as they are."""

    def __init__(self, text: str, lang: str | None = None) -> None:
        self.text, self.lang = text, lang or P.language(text)
        self.paragraphs = P.paragraphs(text)
        self.all = [s for p in self.paragraphs for s in p]

    @cached_property
    def low(self) -> str | None:
        return P.lowered(self.text)

    @cached_property
    def _ends(self) -> list[int]:
        return [b for _, b, _ in self.frozen]

    @cached_property
    def frozen(self) -> list[tuple[int, int, str]]:
        return P.references(self.text)

    def free(self, edit: Edit) -> bool:
        at = bisect_right(self._ends, edit.start)  # references are in order and apart; the first that ends behind the edit's start
        return at == len(self.frozen) or edit.end <= self.frozen[at][0]


_FILLER = {k: "|".join(f"(?:{body})" for body, _ in v) for k, v in E.FILLERS.items()}
_LINK = {k: "^(?:" + "|".join(link for link, _ in v) + "),\\_+" for k, v in E.CONNECTIVES.items()}


class Told:
    """The stems of a paragraph's sentences so far, by stem: which sentences have it."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.having: dict[str, list[int]] = {}

    def repeated(self, own: set[str], share: float) -> bool:
        """Whether a sentence told before shares so many of its stems, or of ``own``, whichever are fewer."""
        n, sizes = len(own), self.sizes
        both = Counter(chain.from_iterable(self.having[w] for w in own if w in self.having))
        return any(c / min(n, sizes[k]) >= share for k, c in both.items())

    def add(self, own: set[str]) -> None:
        for w in own:
            self.having.setdefault(w, []).append(len(self.sizes))
        self.sizes.append(len(own))


def reduction(d: Draft, likely: bool = False) -> Iterator[Edit]:
    """Fillers, sentences about the text, empty intensifiers, repeated theses and summaries of a paragraph; ``likely``: only what can be sure."""
    drop = lambda a, b, why, sure, capital=None: Edit("reduction", a, b, "", why, sure, capital)
    strong = [(sure, [(w, pattern(f"{LEFT}{w}{RIGHT}\\_+")) for w in words if P.may_hold(d.low, w)]) for sure, words in E.INTENSIFIERS[d.lang]]
    strong = [x for x in strong if x[1]]
    meta, filler = pattern(E.META[d.lang]), pattern(_FILLER[d.lang])
    for group in d.paragraphs:
        told = Told()
        for s in group:
            if len(group) > 1 and meta.match(s.text.strip()):
                yield drop(s.start, s.gap, "about the text itself", True)
                repeats = False
            else:
                able = filler.match(s.text)
                lead = next(((m, sure) for body, sure in E.FILLERS[d.lang] if (m := pattern(body).match(s.text))), None) if able else None
                if lead:
                    yield drop(s.start, s.start + lead[0].end(), "opening without content", lead[1] == "high", 0)
                low = P.lowered(s.text) if strong else ""
                for sure, words in strong:
                    for m in (m for w, found in words if P.may_hold(low, w) for m in found.finditer(s.text) if m.start()):
                        yield drop(s.start + m.start(), s.start + m.end(), "intensifier without content", sure == "high")
                repeats = True
            own = P.stems(s.text) if s.words >= REPEAT_FROM and not likely else set()
            if own:
                if repeats and told.repeated(own, REPEAT_SHARE):
                    yield drop(s.start, s.gap, "repeats an earlier sentence of the paragraph", False)
                told.add(own)
        if not likely and len(group) >= 3 and pattern(E.SUMMARY[d.lang]).match(group[-1].text.strip()):
            rest = P.stems(" ".join(s.text for s in group[:-1]))
            if P.shared(P.stems(group[-1].text), rest) >= SUMMARY_SHARE:
                yield drop(group[-2].end, group[-1].end, "sums up the paragraph", False)


def connectives(d: Draft) -> Iterator[Edit]:
    """Links at a sentence's start, if enough words follow."""
    linked = pattern(_LINK[d.lang])
    for s in d.all:
        if not linked.match(s.text):
            continue
        found = ((m, sure) for link, sure in E.CONNECTIVES[d.lang] if (m := pattern(f"^{link},\\_+").match(s.text)))
        m, sure = next(found, (None, ""))
        if m and s.words - P.n_words(m[0]) >= CONNECTIVE_REST:
            yield Edit("connectives", s.start, s.start + m.end(), "", "link at the start", sure == "high", 0)


def rhythm(d: Draft) -> Iterator[Edit]:
    """Long sentences, parted where the halves are most alike; only ever proposed."""
    for s in (s for s in d.all if s.words >= SPLIT_FROM):
        best: tuple[int, int, int] | None = None
        spans: list[tuple[int, int]] = []
        for point in E.SPLITS[d.lang]:
            at = s.text.find(point)
            while at >= 0:
                if not spans:  # a part of a word counts as one, so words are counted by where they start or end
                    spans = P.word_spans(s.text)
                    starts, ends = ([x[k] for x in spans] for k in (0, 1))
                end = at + len(point)
                left, right = bisect_left(starts, at), len(ends) - bisect_right(ends, end)
                if min(left, right) >= SPLIT_PART and (best is None or abs(left - right) < best[0]):
                    best = abs(left - right), at, end
                at = s.text.find(point, at + 1)
        if best:
            yield Edit("rhythm", s.start + best[1], s.start + best[2], ". ", f"{s.words} words in one sentence", False, 2)


def denominal(d: Draft) -> Iterator[Edit]:
    """Nominal phrases of a closed dictionary as verbs, and English gerunds."""
    low = d.low
    rules = [(LEFT + phrase.replace(" ", "\\_+") + RIGHT, verb) for phrase, verb in E.DENOMINAL[d.lang] if all(P.may_hold(low, w) for w in phrase.split())]
    if d.lang == "en":
        rules += [(f"{E.NO_GERUND}{LEFT}the\\_+{noun}\\_+of{RIGHT}", gerund) for noun, gerund in E.GERUNDS if P.may_hold(low, noun)]
    for body, verb in rules:
        for m in pattern(body).finditer(d.text):
            big = m[0][0] != m[0][0].lower()
            yield Edit("denominalization", m.start(), m.end(), P.capital(verb) if big else verb, "verb instead of a noun", True)


_NAMELY = {"ru": "а именно", "en": "namely"}


def punctuation(d: Draft) -> Iterator[Edit]:
    """Explanations after a colon, and some of the asides in brackets."""
    for m in pattern(E.COLON[d.lang]).finditer(d.text) if P.may_hold(d.low, _NAMELY[d.lang]) else ():
        yield Edit("punctuation", m.start(), m.end(), ": ", "explanation after a colon", True)
    asides = []
    for lead in (x for x in E.ASIDES[d.lang] if P.may_hold(d.low, x.partition("[")[0])):
        for most, close in ((70, ",()"), (90, "([.!?])")):
            for m in pattern(f",\\_*({lead}),?\\_*([^,.;:()!?]{{3,{most}}}){close}").finditer(d.text):
                head, rest = m[1].strip(), m[2].strip()
                inner = f"{head}, {rest}" if pattern(E.ASIDE_COMMA).match(head) else f"{head} {rest}"
                follows = "," if pattern(E.SUBORDINATE).match(d.text[m.end() : m.end() + 14]) else ""
                asides.append(Edit("punctuation", m.start(), m.end(), f" ({inner}){m[3] or follows}", "aside in brackets", True))
    budget, last = max(1, P.half_up(len(asides) * E.ASIDE_SHARE)), -1
    for e in sorted(asides, key=lambda e: e.start):
        if budget and e.start >= last:
            yield e
            budget, last = budget - 1, e.end


def _joint(d: Draft, left: P.Sentence, right: P.Sentence, head: str, reason: str, words: int) -> Edit | None:
    """A semicolon for the full stop between two sentences, the second of which begins with ``head``."""
    dot, at = d.text.rfind(".", 0, right.start + 1), d.text.find(head, right.start)
    if dot < left.start or at < 0:
        return None
    return Edit("period", dot, at + len(head), f"; {head.lower()}", reason, True, None, words >= LONG)


def series(d: Draft) -> Iterator[Edit]:
    """Sentences that count up become one, as long as they stay short enough together."""
    ranks = E.SERIES[d.lang]
    for group in d.paragraphs if any(P.may_hold(d.low, w) for w in ranks) else ():
        heads = [(pattern("^\\_*([\\p{L}-]+)").match(s.text) or [None, ""])[1] for s in group]
        rank = [ranks.index(h.lower()) if h.lower() in ranks else -1 for h in heads]
        i = 0
        while i < len(group):
            j, words = i, group[i].words
            while rank[i] >= 0 and j + 1 < len(group) and rank[j + 1] > rank[j] and words + group[j + 1].words <= SERIES_MOST:
                j += 1
                words += group[j].words
            yield from filter(None, (_joint(d, group[k], group[k + 1], heads[k + 1], "series in one period", words) for k in range(i, j)))
            i = j + 1


def _lowers(d: Draft, word: str) -> bool:
    """Whether a sentence's first word may lose its capital: it is a plain opener or stands elsewhere without one."""
    low = word.lower()
    if low == word or word[1:] != low[1:] or any(c in "0123456789" for c in word):
        return False
    return low in E.PLAIN_OPENERS[d.lang] or low in d.text and regex.search(f"{LEFT}{regex.escape(low)}{RIGHT}", d.text) is not None


def periods(d: Draft) -> Iterator[Edit]:
    """The longest pair of neighbours in a paragraph as one period; a paragraph of two only if that makes a long one."""
    for group in d.paragraphs:
        pairs = [(a.words + b.words, a, b) for a, b in zip(group, group[1:], strict=False) if min(a.words, b.words) >= JOIN_PART]
        words, left, right = max(pairs, key=lambda p: p[0], default=(0, None, None))
        if words < (LONG if len(group) == 2 else JOIN_SOFT) or not pattern("\\.[\"»”']?$").search(left.text.strip()):
            continue
        m = pattern("^\\_*([\\p{L}\\p{N}][\\p{L}\\p{N}'’-]*)").match(right.text)
        if m and not P.anchors(m[1]) and _lowers(d, m[1]):
            if e := _joint(d, left, right, m[1], "two short sentences in one period", words):
                yield replace(e, sure=words >= LONG)


def within_long_share(d: Draft, edits: Iterable[Edit]) -> Iterator[Edit]:
    """No more sure joints into long sentences than the language's share of these leaves; the rest are less sure."""
    budget = max(1, P.half_up(E.LONG_SHARE[d.lang] * len(d.all)) - sum(s.words >= LONG for s in d.all))
    for e in edits:
        if e.sure and e.long:
            e, budget = replace(e, sure=budget > 0), budget - 1
        yield e


def settled(edits: Iterable[Edit]) -> list[Edit]:
    """In order; of edits that overlap the one that starts first, then the largest, then the weightiest pass stays."""
    out: list[Edit] = []
    for e in sorted(edits, key=lambda e: (e.start, -e.end, PRIORITY[e.kind])):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def recommended(edits: list[Edit], sentences: int, most: float) -> list[Edit]:
    """Sure edits are accepted, but splits never, and of links the first ones stay that the genre's zone allows."""
    spare, seen, out = max(1, P.half_up(sentences * most)), 0, []
    for e in edits:
        seen += e.kind == "connectives"
        kept = e.kind == "connectives" and e.sure and seen <= spare
        out.append(replace(e, kept=kept, accepted=e.sure and not kept and e.kind != "rhythm"))
    return out


def proposals(d: Draft, most: float = DISCOURSE_MOST) -> list[Edit]:
    """All passes over a draft, away from literal references, settled and recommended."""
    if not d.all:
        return []
    found = [e for run in (reduction, connectives, rhythm, denominal, punctuation) for e in run(d)]
    found += within_long_share(d, [*series(d), *periods(d)])
    return recommended(settled(e for e in found if d.free(e)), len(d.all), most)


def spliced(text: str, edits: Iterable[tuple[int, int, str, int | None]]) -> tuple[str, bool]:
    """(the text with edits (start, end, after, capital) put in and tidied, whether facts and references are unchanged)."""
    out = text
    for start, end, after, capital in sorted(edits, key=lambda e: -e[0]):
        out = out[:start] + after + out[end:]
        if capital is not None and start + capital < len(out):
            at = start + capital
            out = out[:at] + out[at].upper() + out[at + 1 :]
    out, _ = P.masked(out, P.tidy)
    return (out, True) if P.intact(text, out) else (text, False)


def apply(text: str, edits: list[Edit]) -> tuple[str, int, bool]:
    """(text, number of edits applied, whether the guard let them pass); all or none."""
    chosen = [(e.start, e.end, e.after, e.capital) for e in edits if e.accepted]
    out, ok = spliced(text, chosen)
    return out, len(chosen) if ok else 0, ok


@lru_cache(maxsize=2)
def _draft(text: str, lang: str | None) -> Draft:
    return Draft(text, lang)


@lru_cache(maxsize=2)
def _proposed(text: str, lang: str | None, most: float) -> list[Edit]:
    return proposals(_draft(text, lang), most)


#: What each pass finds by itself, before edits of others and literal references take places from it; splits are never sure.
_OWN = {
    "reduction": lambda d: reduction(d, likely=True), "connectives": connectives, "rhythm": lambda d: (), "denominalization": denominal,
    "punctuation": punctuation, "period": lambda d: (*series(d), *periods(d)),
}


def may_apply(text: str, kind: str, lang: str | None = None) -> bool:
    """Whether a pass alone could have a sure edit; one that has none by itself has none beside others."""
    return any(e.sure for e in _OWN[kind](_draft(text, lang)))


def apply_pass(text: str, kind: str, lang: str | None = None, most: float = DISCOURSE_MOST) -> tuple[str, int]:
    """One pass alone: its sure edits, but for links kept for the zone."""
    able = may_apply(text, kind, lang)
    edits = [replace(e, accepted=e.kind == kind and e.sure and not e.kept) for e in _proposed(text, lang, most)] if able else []
    out, n, _ = apply(text, edits)
    return out, n


def manual(d: Draft) -> list[tuple[int, int, str, str, int]]:
    """(start, end, fragment, advice, method): nominal style, and triads where they are many."""
    found = []
    for body, advice in E.MANUAL[d.lang]:
        found += [(m.start(), m.end(), m[0], advice, METHOD["denominalization"]) for m in pattern(LEFT + body.replace("\\>", RIGHT)).finditer(d.text)]
    if d.lang == "en":
        triads = [(m.start(), m.end(), m[0], "three of a kind: part or drop one", 40) for m in pattern(E.TRIAD).finditer(d.text)]
        found += triads if len(triads) >= TRIADS_FROM else []
    return sorted(found, key=lambda x: x[0])


def _mapped(docs: DataFrame, schema: str, rows, *extra: str) -> DataFrame:
    """``rows(doc_id, text, *extra)`` of each document as a table; null texts are empty."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.iloc[lo : lo + 64]
                out = [r for x in part.itertuples(index=False, name=None) for r in rows(*x)]
                frame = pd.DataFrame(out, columns=names)
                for c in schema.split(", "):
                    name, kind = c.split(" ")
                    if kind in ("int", "long"):
                        frame[name] = frame[name].astype("Int64")
                yield frame

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    return plain.mapInPandas(run, schema)


EDIT_ROWS = (
    "doc_id long, pass string, method int, start long, end long, before string, after string, reason string, confidence string, capitalize_at int, "
    "creates_long boolean, removed_words long, accepted boolean, kept_for_zone boolean"
)


def _row(doc_id: int | None, text: str, e: Edit) -> tuple:
    before = text[e.start : e.end]
    gone = max(0, P.n_words(before) - P.n_words(e.after))
    sure = "high" if e.sure else "medium"
    return doc_id, e.kind, METHOD[e.kind], e.start, e.end, before, e.after, e.reason, sure, e.capital, e.long, gone, e.accepted, e.kept


def edit_proposals(docs: DataFrame, most: float = DISCOURSE_MOST) -> DataFrame:
    """One row per proposed edit (``EDIT_ROWS``), none overlapping another of its document.

    ``before`` is cut from the text. Null and empty texts have no edits; repeated rows have theirs
    each; columns besides doc_id and text are left out.
    """
    return _mapped(docs, EDIT_ROWS, lambda i, t: [_row(i, t, e) for e in proposals(Draft(t), most)])


def edit_summary(docs: DataFrame, most: float = DISCOURSE_MOST) -> DataFrame:
    """(doc_id, language, sentences, words, n_edits, possible_share, recommended_share): what all edits, and the accepted ones, would take from a text."""

    def rows(i: int | None, t: str) -> list[tuple]:
        d = Draft(t)
        found = [_row(i, t, e) for e in proposals(d, most)]
        words = P.n_words(t)
        share = lambda rows: sum(r[11] for r in rows) / words if words else 0.0
        return [(i, d.lang, len(d.all), words, len(found), share(found), share([r for r in found if r[12]]))]

    return _mapped(docs, "doc_id long, language string, sentences long, words long, n_edits long, possible_share double, recommended_share double", rows)


def edited(docs: DataFrame, kind: str | None = None, most: float = DISCOURSE_MOST) -> DataFrame:
    """(doc_id, text, applied, ok, removed_words): every document with its accepted edits, or with the sure ones of one pass.

    ``ok`` is false where the guard rolled the edits back; the text is the source then.
    """

    def rows(i: int | None, t: str) -> list[tuple]:
        edits = proposals(Draft(t), most)
        if kind:
            edits = [replace(e, accepted=e.kind == kind and e.sure and not e.kept) for e in edits]
        out, n, ok = apply(t, edits)
        return [(i, out, n, ok, P.n_words(t) - P.n_words(out))]

    return _mapped(docs, "doc_id long, text string, applied long, ok boolean, removed_words long", rows)


def apply_rows(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, applied, ok): ``docs`` with the accepted rows of ``edits`` (as ``EDIT_ROWS``) spliced in.

    All of a document's rows go in, or none: where a row's ``before`` isn't what stands there, rows
    overlap, or the guard objects. Edits are gathered by document, so a document's own rows meet in
    one place and no others. Repeated ids share their edits; null ids get none.
    """
    order = F.struct("start", "end", "after", "capitalize_at", "before")
    listed = edits.where("accepted").groupBy("doc_id").agg(F.collect_list(order).alias("edits"))

    def rows(i: int | None, t: str, given) -> list[tuple]:
        chosen = sorted(tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in (given if given is not None else ()))
        fits = all(0 <= a <= b and t[a:b] == before for a, b, _, _, before in chosen) and all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:], strict=False))
        out, ok = spliced(t, [(a, b, after, None if c is None or c != c else int(c)) for a, b, after, c, _ in chosen]) if fits else (t, False)
        return [(i, out if chosen else t, len(chosen) if ok else 0, ok)]

    return _mapped(docs.select("doc_id", "text").join(listed, "doc_id", "left"), "doc_id long, text string, applied long, ok boolean", rows, "edits")


def manual_hints(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, fragment, advice, method): places that only the author can mend."""
    return _mapped(docs, "doc_id long, start long, end long, fragment string, advice string, method int", lambda i, t: [(i, *x) for x in manual(Draft(t))])


# What a metric below its zone asks of the author (method, metric), and what always holds.
LOW_HINTS = [(19, "shortPerParagraph", "short phrase"), (20, "paragraphCv", "uneven paragraphs"), (11, "anchorDensity", "facts to ask for")]
STANDING_HINTS = [(13, "gain and cost in pairs"), (23, "ellipsis"), (24, "digression and self-correction")]


def author_hints(report: DataFrame) -> DataFrame:
    """(doc_id, method, hint): for a report (doc_id, metric, status), what its low metrics ask for, and what every document gets."""
    spark = report.sparkSession
    low = F.broadcast(spark.createDataFrame(LOW_HINTS, "method int, metric string, hint string"))
    always = F.broadcast(spark.createDataFrame(STANDING_HINTS, "method int, hint string"))
    asked = report.where("status = 'low'").join(low, "metric").select("doc_id", "method", "hint")
    return asked.unionByName(report.select("doc_id").distinct().join(always, F.lit(True)).select("doc_id", "method", "hint"))
