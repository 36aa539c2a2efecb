"""Layout of documents: segments and their sections, media with their captions near where they are spoken of, and pieces of work.

Scale: one document at a time in Arrow batches, in narrow stages; sections are a short list that a
profile brings along.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import ceil

import regex
from pyspark.sql import DataFrame

from lexiflow.functions import prose as P
from lexiflow.operators.documents import BUSINESS_SECTIONS, CAPTION_STYLE, PROFILES, STUB, Block, Section, parsed, plain_key
from lexiflow.operators.passes import _mapped

# Titles that stand apart, captions, what refers to an object, and words that tell its place.
APART = "(?i)(?:contents|table\\s+of\\s+contents|individual\\s+contribution|личный\\s+вклад|conclusion|references|bibliography|appendix|содержание|оглавление|заключение|список\\s+(?:источников|литературы)|приложение)"
CAPTION = "(?i)(Table|Figure|Fig\\.|Таблица|Рисунок|Рис\\.)\\s+([0-9]+(?:\\.[0-9]+)*)(?:\\s*[.:–—-]\\s*(.*))?"
MENTION = "(?i)(?:^|[^\\p{L}\\p{N}_])(Table|Figure|Fig\\.|Таблиц[аеуы]?|Рисун(?:ок|ке|ка)|Рис\\.)\\s+([0-9]+(?:\\.[0-9]+)*)(?![\\p{L}\\p{N}_]|\\.[0-9])"
PLACED, SOURCE = f"(?i)(?:{P.EDGE}(?:above|below|preceding|following){P.EDGE}|выше|ниже|предыдущ|следующ)", "(?i)(?:Sources?|Источник(?:и)?)\\s*:"
# What a section's title, an alias and a word of either are worth, and how much it takes.
TITLE, ALIAS, KEYWORD, ENOUGH = 8, 5, 1, 2
# Sentences and letters of a piece of work.
PIECE_SENTENCES, PIECE_LETTERS = 10, 3500


@dataclass
class Segment:
    """A heading and the blocks below it up to the next; without a heading, what stands before the first."""

    heading: Block | None
    blocks: list[Block] = field(default_factory=list)


def section_of(title: str, sections: tuple[Section, ...]) -> Section | None:
    """The section whose title or alias a heading is."""
    return next((s for s in sections if plain_key(title) in s.keys), None)


def segmented(blocks: list[Block], sections: tuple[Section, ...] = BUSINESS_SECTIONS) -> list[Segment]:
    """Blocks by top headings: first level, structural, appendices, and a section's own title at any level."""
    out = [Segment(None)]
    for b in blocks:
        named = section_of(b.title, sections) if b.type == "heading" else None
        top = b.type == "heading" and (b.level == 1 or b.structural or b.kind == "appendix" or regex.match(APART, b.title) or named and plain_key(b.title) == plain_key(named.title))
        if top:
            out.append(Segment(b))
        else:
            out[-1].blocks.append(b)
    return out if out[0].blocks else out[1:]


def filled(segment: Segment) -> bool:
    return any(b.body is not None and b.body != STUB for b in segment.blocks)


def covers(segment: Segment, subsection: str) -> bool:
    """Whether at least half of a subsection's longer words stand in a segment."""
    words = plain_key(subsection).split(" ")
    keys = [w for w in words if len(w) > 3] or [w for w in words if len(w) >= 2]
    text = " ".join(b.title if b.type == "heading" else b.body or "" for b in segment.blocks).lower()
    return bool(keys) and sum(w in text for w in keys) >= ceil(len(keys) / 2)


def with_captions(blocks: list[Block], titles: list[str]) -> list[Block]:
    """Tables without a caption before them get the title of their number, and a note on the source."""
    out, n = [], 0
    for b in blocks:
        if b.type == "table":
            bare = not out or out[-1].type != "caption" or out[-1].kind != "table"
            if bare and n < len(titles):
                out += [Block("caption", "table", title=titles[n], prefix=CAPTION_STYLE["table"][0]), Block("paragraph", "source", text="designed by the authors")]
            n += 1
        out.append(b)
    return out


def inferred_section(text: str, sections: tuple[Section, ...]) -> str | None:
    """The section that a text speaks of most: its names by phrase, their words one by one; the first wins ties, too little is none."""
    padded, best = f" {text.strip().lower()} ", (0, None)
    for s in sections:
        names = [x.lower() for x in (s.title, *s.aliases)]
        words = {w for x in names for w in regex.sub("[^\\p{L}\\p{N}\\s-]+", " ", x).split() if len(w) >= 4}
        score = sum(TITLE if x == s.title.lower() else ALIAS for x in names if x in padded) + sum(KEYWORD for w in words if f" {w} " in padded)
        if score > best[0]:
            best = score, s.title
    return best[1] if best[0] >= ENOUGH else None


def filled_tables(text: str) -> int:
    """How many tab-separated tables have a value outside their first row and column."""
    n = 0
    for block in regex.split("\n{2,}", text.strip()):
        lines = [x for x in map(str.strip, block.split("\n")) if x]
        if len(lines) >= 2 and all("\t" in x for x in lines):
            n += any(c.strip() for x in lines[1:] for c in x.split("\t")[1:])
    return n


# Media.


def _media(b: Block) -> str:
    return "table" if b.type == "table" else "figure" if b.type in ("image", "imageMissing") else ""


def _kind(prefix: str) -> str:
    return "table" if regex.match("(?i)(?:table|табл)", prefix) else "figure"


def prepared(blocks: list[Block]) -> list[Block]:
    """Paragraphs that are captions beside a medium of their kind, and notes on the source below one, as such."""
    out = list(blocks)
    near = lambda i: [_media(out[j]) for j in (i - 1, i + 1) if 0 <= j < len(out)]
    for i, b in enumerate(out):
        m = regex.fullmatch(CAPTION, b.text.strip()) if b.type == "paragraph" else None
        if m and _kind(m[1]) in near(i):
            out[i] = Block("caption", _kind(m[1]), number=m[2], title=m[3] or "", raw=b.text, prefix=m[1])
    for i, b in enumerate(out):
        below = i and (_media(out[i - 1]) or out[i - 1].type == "caption" and i > 1 and _media(out[i - 2]))
        if b.type == "paragraph" and below and regex.match(SOURCE, b.text):
            out[i] = replace(b, kind="source")
    return out


@dataclass
class Unit:
    """Blocks that move together: a medium with its caption and source, or a block alone."""

    main: int
    members: list[int]
    kind: str = ""
    caption: int | None = None


def units(blocks: list[Block]) -> list[Unit]:
    """The units of prepared blocks, in order. A caption between two media goes where custom puts it: above a table, below a figure."""
    owner = {i: Unit(i, [i], _media(b)) for i, b in enumerate(blocks) if _media(b)}
    for i, b in enumerate(blocks):
        if b.type == "caption":
            free = [owner[j] for j in (i - 1, i + 1) if j in owner and owner[j].main == j and owner[j].kind == b.kind and owner[j].caption is None]
            best = next((u for u in free if (u.main > i) == (b.kind == "table")), free[0] if free else None)
            if best:
                best.caption, owner[i] = i, best
                best.members.append(i)
    for i, b in enumerate(blocks):
        if b.kind == "source" and i - 1 in owner:
            owner[i] = owner[i - 1]
            owner[i].members.append(i)
    out: list[Unit] = []
    for i in range(len(blocks)):
        unit = owner.get(i) or Unit(i, [i])
        if not any(unit is u for u in out[-3:]):
            unit.members.sort()
            out.append(unit)
    return out


def mentioned(text: str) -> list[tuple[str, str]]:
    """(kind, number) of the objects that a text refers to."""
    return [(_kind(m[1]), m[2]) for m in regex.finditer(MENTION, text)]


def arranged(blocks: list[Block]) -> tuple[list[Block], int, list[str]]:
    """(blocks with numbered media behind the paragraph of their section that speaks of them first, how many moved, warnings).

    Objects whose number stands twice, or that a text places by "above" or "below", stay where they are.
    """
    blocks = prepared(blocks)
    listed = units(blocks)
    labels = [(b.kind, b.number) for b in blocks if b.type == "caption" and b.number]
    warnings: list[str] = []
    behind: dict[int, list[Unit]] = {}
    moved: set[int] = set()
    section: list[Unit] = []
    for u in [*listed, None]:
        if u is not None and blocks[u.main].type != "heading":
            section.append(u)
            continue
        speaks = [(v, mentioned(blocks[v.main].text)) for v in section if not v.kind and blocks[v.main].type == "paragraph"]
        for v in section:
            label = (v.kind, blocks[v.caption].number) if v.kind and v.caption is not None else None
            if not label or not label[1]:
                continue
            about = [w for w, found in speaks if label in found]
            if labels.count(label) > 1:
                warnings.append("number twice")
            elif any(regex.search(PLACED, blocks[w.main].text) for w in about):
                warnings.append("placed by words")
            elif about:
                behind.setdefault(about[0].main, []).append(v)
                moved.add(v.main)
        section = []
    order = [x for u in listed if u.main not in moved for x in (u, *behind.get(u.main, ()))]
    return [blocks[i] for u in order for i in u.members], sum(bool(u.kind) and u is not v for u, v in zip(order, listed, strict=True)), sorted(set(warnings))


# Pieces of work.


def pieces(text: str, sentences: int = PIECE_SENTENCES, letters: int = PIECE_LETTERS) -> list[tuple[int, int]]:
    """(start, end) of runs of whole sentences, as many as fit the limits; none holds or goes over a list of sources."""
    frozen = [(m[0], m[1]) for m in P._finder().merged(text) if m[2]] if text else []
    spans = [s for p in P.paragraphs(text) for s in p if not any(s.start < b and s.end > a for a, b in frozen)]
    out: list[list[int]] = []
    n = 0
    for s in spans:
        over = out and any(out[-1][1] <= a and s.start >= b for a, b in frozen)
        if out and n < sentences and s.end - out[-1][0] <= letters and not over:
            out[-1][1], n = s.end, n + 1
        else:
            out.append([s.start, s.end])
            n = 1
    return [(a, b) for a, b in out]


# Tables.


def segment_rows(docs: DataFrame, sections: tuple[Section, ...] = BUSINESS_SECTIONS) -> DataFrame:
    """(doc_id, segment, title, section, blocks, filled, tables): the segments of each document with the section they are."""

    def rows(i: int | None, t: str) -> list[tuple]:
        out = []
        for k, s in enumerate(segmented(parsed(t), sections)):
            found = section_of(s.heading.title, sections) if s.heading else None
            out.append((i, k, s.heading.title if s.heading else None, found.title if found else None, len(s.blocks), filled(s), sum(b.type == "table" for b in s.blocks)))
        return out

    return _mapped(docs, "doc_id long, segment int, title string, section string, blocks int, filled boolean, tables int", rows)


def readiness(docs: DataFrame, profile: str = "business-plan") -> DataFrame:
    """(doc_id, section, present, filled): for each section of a profile, whether a document has it and says something in it."""
    sections = PROFILES[profile].sections

    def rows(i: int | None, t: str) -> list[tuple]:
        own = {x.title: s for s in reversed(segmented(parsed(t), sections)) if s.heading and (x := section_of(s.heading.title, sections))}
        return [(i, s.title, s.title in own, s.title in own and filled(own[s.title])) for s in sections]

    return _mapped(docs, "doc_id long, section string, present boolean, filled boolean", rows)


def inferred_sections(docs: DataFrame, sections: tuple[Section, ...] = BUSINESS_SECTIONS) -> DataFrame:
    """(doc_id, section, tables): the section each document speaks of, null if none, and its filled tables."""
    return _mapped(docs, "doc_id long, section string, tables int", lambda i, t: [(i, inferred_section(t, sections), filled_tables(t))])


def arranged_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, moved, warnings, order): each document's blocks after its media have moved, as types and numbers in order."""

    def rows(i: int | None, t: str) -> list[tuple]:
        blocks, moved, warnings = arranged(parsed(t))
        return [(i, moved, warnings, [f"{b.type} {b.number}".strip() for b in blocks])]

    return _mapped(docs, "doc_id long, moved int, warnings array<string>, order array<string>", rows)


def work_pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, end): every text in pieces of whole sentences that a model could take at once."""
    return _mapped(docs, "doc_id long, piece int, start long, end long", lambda i, t: [(i, k, a, b) for k, (a, b) in enumerate(pieces(t))])
