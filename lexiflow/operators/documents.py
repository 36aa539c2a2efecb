"""Documents as blocks: classification, numbering, stubs for what is missing, rendering and a compliance report.

A document is parted at blank lines. Each block is a heading, caption, list, table or paragraph.
Numbers that exist are targets of references, so they stay; new ones take the next free number.
Structuring never loses body text: if a block, number or address is gone afterwards, the source stays.

Scale: one document at a time, in Arrow batches and narrow stages; a document's blocks are its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import lexicon as L
from lexiflow.functions import prose as P
from lexiflow.operators.passes import _mapped
from lexiflow.operators.references import CLOSES, OPENS


@dataclass(frozen=True)
class Section:
    title: str
    aliases: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [plain_key(x) for x in (self.title, *self.aliases)]


@dataclass(frozen=True)
class Part:
    """A part every document needs: ``found`` matches it anywhere; a stub goes to the front or before headings that match ``before``."""

    title: str
    found: str
    before: str | None


@dataclass(frozen=True)
class Profile:
    sections: tuple[Section, ...]
    parts: tuple[Part, ...]
    uppercase: bool = True
    page: int = 2000


# Sections of a business plan, with the names they also go by.
BUSINESS_SECTIONS = (
    Section("Executive Summary", ("executive summary", "резюме проекта", "резюме")),
    Section("Business Outline and Market Analysis", ("business outline", "market analysis", "business outline and market analysis", "описание бизнеса", "анализ рынка")),
    Section("Marketing and Sales Plan", ("marketing and sales plan", "marketing plan", "sales plan", "план маркетинга", "маркетинговый план")),
    Section("Organization Plan", ("organization plan", "organizational structure", "организационный план", "организационная структура")),
    Section("Production Plan", ("production plan", "производственный план")),
    Section("Investment Plan", ("investment plan", "инвестиционный план")),
    Section("Financial Plan", ("financial plan", "финансовый план")),
    Section(
        "Project Performance Evaluation and Risk Analysis",
        ("project performance evaluation", "performance evaluation", "risk analysis", "оценка эффективности проекта", "анализ рисков"),
    ),
)
# Parts of any work; where a stub of each goes.
PARTS = (
    Part("Contents", "(?im)^(?:contents|table of contents|содержание)$", None),
    Part("Conclusion", "(?im)^(?:conclusion|заключение)$", "(?i)^(?:references|bibliography|appendix|список|приложение)"),
    Part("References", "(?im)^(?:references|bibliography|список (?:источников|литературы))$", "(?i)^(?:appendix|приложение)"),
)
PROFILES = {"business-plan": Profile(BUSINESS_SECTIONS, PARTS), "academic-report": Profile((), PARTS)}
# What tells a list, a heading, a caption; words of a heading at most; the mark of a stub.
LIST_LINE, BULLET = "(?:[-*•▪◦]|[0-9]+[.)])\\s+", "[-*•▪◦]\\s+"
STRUCTURAL = (
    "(?i)(?:contents|table\\s+of\\s+contents|individual\\s+contribution|личный\\s+вклад|conclusion|references|bibliography|appendix|содержание|оглавление|заключение|"
    "список\\s+(?:источников|литературы)|приложение)"
)
BACK_MATTER = "(?i)(?:conclusion|references|bibliography|appendix|заключение|список\\s+(?:источников|литературы)|приложение)"
NUMBERED = "([0-9]+(?:\\.[0-9]+)*)\\.?\\s+(\\S.*)"
APPENDIX = "(?i)(?:appendix|приложение)\\s+([A-Za-zА-Яа-я0-9]+)\\.?\\s*(.*)"
CAPTIONS = {
    "table": "(?i)(?:table|таблица|табл\\.)\\s*([0-9]+(?:\\.[0-9]+)*)?\\s*[.—–-]?\\s*(.*)",
    "figure": "(?i)(?:figure|fig\\.|рисунок|рис\\.)\\s*([0-9]+(?:\\.[0-9]+)*)?\\s*[.—–-]?\\s*(.*)",
}
CAPTION_STYLE = {"table": ("Table", "right", "above"), "figure": ("Figure", "center", "below")}
HEADING_WORDS, STUB = 14, "—"
ABBREVIATION = "(?<![\\p{L}\\p{N}])[A-ZА-ЯЁ]{2,6}(?![\\p{L}\\p{N}])"
AUTHOR_YEAR, BY_NUMBER = "\\([^()\\n]{2,80}?,\\s*[0-9]{4}[a-z]?(?:,\\s*[0-9]{4}[a-z]?)*\\)", "\\[\\s*[0-9]+(?:\\s*[,–-]\\s*[0-9]+)*\\s*\\]"


@dataclass
class Block:
    """``lines`` for lists and tables; ``fresh``: a stub that gets a number; ``structural``: a heading that never does."""

    type: str
    kind: str = ""
    level: int = 0
    number: str = ""
    title: str = ""
    text: str = ""
    lines: list[str] = field(default_factory=list)
    raw: str = ""
    structural: bool = False
    protected: bool = False
    placeholder: bool = False
    fresh: bool = False
    prefix: str = ""

    @property
    def body(self) -> str | None:
        """Text that structuring must keep, None for headings and captions."""
        if self.type in ("list", "table"):
            return "\n".join(self.lines)
        return self.text if self.type == "paragraph" else None


def plain_key(text: str) -> str:
    return regex.sub("[\\s\\p{P}]+", " ", text.lower()).strip()


def _title(text: str) -> str:
    return regex.sub("[.\\s]+$", "", text)


def _words(text: str) -> int:
    return len(P.WORD_.findall(text))


def _shouted(line: str) -> bool:
    letters = P.LETTER.findall(line)
    return len(letters) >= 3 and all(c == c.upper() for c in letters)


def classified(block: str) -> Block | None:
    """What a run of lines is; the first that fits of list, appendix, caption, numbered heading, short heading, table, paragraph."""
    lines = [x for x in map(str.strip, block.split("\n")) if x]
    if not lines:
        return None
    line = lines[0]
    if len(lines) > 1:
        if any(regex.match(LIST_LINE, x) for x in lines):
            return Block("list", lines=lines)
        return Block("table", lines=lines) if all("\t" in x for x in lines) else Block("paragraph", text=" ".join(lines))
    if regex.match(BULLET, line):
        return Block("list", lines=lines)
    if m := regex.fullmatch(APPENDIX, line):
        return Block("heading", "appendix", 1, m[1], _title(m[2]), raw=line)
    for kind, told in CAPTIONS.items():
        if (m := regex.fullmatch(told, line)) and (m[1] or m[2]):
            return Block("caption", kind, 0, m[1] or "", m[2], raw=line)
    if (m := regex.fullmatch(NUMBERED, line)) and _words(m[2]) <= HEADING_WORDS and m[2][-1] not in ".!?…":
        return Block("heading", "section", m[1].count(".") + 1, m[1], _title(m[2]), raw=line)
    if _words(line) <= HEADING_WORDS and (_shouted(line) or line[-1] not in ".!?…:"):
        structural = regex.match(STRUCTURAL, line) is not None
        return Block("heading", "section", 1 if structural or _shouted(line) else 2, "", _title(line), raw=line, structural=structural)
    return Block("paragraph", text=line)


def parsed(text: str) -> list[Block]:
    """The blocks of a document; what stands in a list of sources stays as it is, up to end matter."""
    out, listed = [], False
    for raw in filter(None, (x.strip() for x in regex.split("\n{2,}", text))):
        opens = regex.search(f"(?i){OPENS}", raw) is not None
        listed = opens or listed and not regex.search(f"(?i){CLOSES}", raw)
        block = Block("paragraph", text=raw, protected=True) if listed and not opens else classified(raw)
        if block:
            out.append(block)
    return out


def _stub(title: str, fresh: bool) -> list[Block]:
    return [Block("heading", "section", 1, "", title, structural=not fresh, placeholder=True, fresh=fresh), Block("paragraph", text=STUB, placeholder=True)]


def _first(blocks: list[Block], told) -> int:
    """Where the first heading stands that ``told`` holds for, or the end."""
    return next((i for i, b in enumerate(blocks) if b.type == "heading" and told(b)), len(blocks))


def with_stubs(blocks: list[Block], text: str, profile: Profile) -> tuple[list[Block], list[str]]:
    """(blocks with a stub for each missing section and part, their titles). A section's stub stands before the next section found, or before back matter."""
    places = [_first(blocks, lambda b, s=s: any(k in plain_key(b.title) for k in s.keys)) for s in profile.sections]
    found = [i < len(blocks) for i in places]
    tail = _first(blocks, lambda b: regex.match(BACK_MATTER, b.title))
    before: dict[int, list[Block]] = {}
    absent = [s.title for s, there in zip(profile.sections, found, strict=True) if not there]
    for k, s in enumerate(profile.sections):
        if not found[k]:
            at = next((places[j] for j in range(k + 1, len(places)) if found[j]), tail)
            before.setdefault(at, []).extend(_stub(s.title, True))
    out = [x for i in range(len(blocks) + 1) for x in (*before.get(i, ()), *blocks[i : i + 1])]
    for part in (p for p in profile.parts if not regex.search(p.found, text)):
        at = 0 if part.before is None else _first(out, lambda b, p=part: regex.match(p.before, b.title))
        out[at:at] = _stub(part.title, False)
        absent.append(part.title)
    return out, absent


def numbered_headings(blocks: list[Block]) -> tuple[list[Block], int]:
    """(blocks with numbers for new headings, how many): only where some heading has a number or a stub wants one."""
    wanted = lambda b: b.type == "heading" and b.kind == "section" and not b.structural and (b.number or b.fresh)
    used = {b.number for b in blocks if wanted(b) and b.number}
    counters: list[int] = []
    out, n = [], 0
    for b in blocks:
        if wanted(b) and b.number:
            counters = [int(x) for x in b.number.split(".")]
        elif wanted(b):
            level = max(1, min(b.level, 6))
            counters = [c or 1 for c in (counters + [0] * level)[: level - 1]] + [(counters + [0] * level)[level - 1]]
            while True:
                counters[-1] += 1
                number = ".".join(map(str, counters))
                if number not in used:
                    break
            used.add(number)
            b, n = replace(b, number=number), n + 1
        out.append(b)
    return out, n


def numbered_captions(blocks: list[Block]) -> tuple[list[Block], int]:
    """(captions with number and prefix, how many changed): tables and figures each count from 1 past the numbers that exist."""
    used = {k: {b.number for b in blocks if b.type == "caption" and b.kind == k and b.number} for k in CAPTIONS}
    last, out, changed = dict.fromkeys(CAPTIONS, 0), [], 0
    for b in blocks:
        if b.type == "caption":
            number = b.number
            while not number:
                last[b.kind] += 1
                number = "" if str(last[b.kind]) in used[b.kind] else str(last[b.kind])
            used[b.kind].add(number)
            prefix = CAPTION_STYLE[b.kind][0]
            changed += b.number != number or not b.raw.startswith(prefix)
            b = replace(b, number=number, prefix=prefix, title=_title(b.title))
        out.append(b)
    return out, changed


def block_text(b: Block, profile: Profile) -> str:
    """How a block reads."""
    if b.body is not None:
        return b.body
    if b.type == "caption":
        return f"{b.prefix} {b.number}" + (f". {b.title}" if b.title else "")
    title = b.title.upper() if profile.uppercase and b.level == 1 else b.title
    if b.kind == "appendix":
        return ". ".join(x for x in (f"Appendix {b.number}".strip(), title) if x)
    return f"{b.number}. {title}" if b.number else title


def rendered(blocks: list[Block], profile: Profile) -> str:
    return "\n\n".join(block_text(b, profile) for b in blocks)


def lost(source: list[Block], text: str) -> list[str]:
    """What of the source's body a text doesn't hold any more: blocks, addresses, numbers."""
    bodies = [b.body for b in source if b.body is not None]
    body, low = "\n".join(bodies), text.lower()
    checks = {
        "body": any(b not in text for b in bodies),
        "addresses": any(u.lower() not in low for u in regex.findall("(?i)https?://[^\\s<>()]+", body)),
        "numbers": any(n not in text for n in regex.findall("[0-9]+(?:[.,][0-9]+)?", body)),
    }
    return [k for k, gone in checks.items() if gone]


def unexplained(text: str) -> list[str]:
    """Abbreviations that aren't common and stand unexplained where they come first."""
    out, seen = [], set(L.COMMON_ABBREVIATIONS)
    for m in regex.finditer(ABBREVIATION, text):
        if m[0] in seen:
            continue
        seen.add(m[0])
        before, after = text[max(0, m.start() - 120) : m.start()], text[m.end() : m.end() + 120]
        if not regex.search("\\p{L}{3,}[^()\\n]{0,80}\\(\\s*$", before) and not regex.match("\\s*\\([^)\\n]{6,}\\)", after):
            out.append(m[0])
    return out


def problems(blocks: list[Block], text: str, profile: Profile, inserted: list[str]) -> list[tuple[str, list[str]]]:
    """(problem, items): stubs to fill, unexplained abbreviations, appendices and captions that nobody refers to, and counts of citations and pages."""
    body = "\n\n".join(b.body for b in blocks if b.body is not None)
    declared = {b.number.upper() for b in blocks if b.type == "heading" and b.kind == "appendix" and b.number}
    mentioned = dict.fromkeys(x.upper() for x in regex.findall("(?i)(?:see\\s+)?appendix\\s+([A-Za-z0-9]+)", body))
    named = [(b.prefix, b.number) for b in blocks if b.type == "caption"]
    orphans = [f"{p} {n}" for p, n in named if not regex.search(f"(?i){regex.escape(p)}\\s*{regex.escape(n)}(?![A-Za-z0-9_])", body)]
    found = {
        "placeholders": inserted,
        "abbreviations": unexplained(body),
        "appendix-unreferenced": [f"Appendix {x}" for x in dict.fromkeys(b.number.upper() for b in blocks if b.type == "heading" and b.kind == "appendix" and b.number) if x not in mentioned],
        "appendix-missing": [f"Appendix {x}" for x in mentioned if x not in declared],
        "captions": orphans,
        "citations-by-number": [str(n)] if (n := len(regex.findall(BY_NUMBER, body))) else [],
        "citations": [str(n)] if (n := len(regex.findall(AUTHOR_YEAR, body))) else [],
        "pages": [str(max(1, P.half_up(len(text) / profile.page)))],
    }
    return [(k, v) for k, v in found.items() if v]


@dataclass(frozen=True)
class Structured:
    text: str
    blocks: list[Block]
    renumbered: int
    captions: int
    inserted: list[str]
    lost: list[str]
    problems: list[tuple[str, list[str]]]


def structured(text: str, profile: Profile, stubs: bool = True) -> Structured:
    """A document by its profile; where body text would be lost, the source with its captions as found and no stubs."""
    source = text.strip()
    if not source:
        return Structured("", [], 0, 0, [], [], [])
    blocks = parsed(source)
    made, inserted = with_stubs(blocks, source, profile) if stubs else (blocks, [])
    made, captions = numbered_captions(made)
    made, renumbered = numbered_headings(made)
    out = rendered(made, profile)
    gone = lost(blocks, out)
    if gone:
        kept = numbered_captions(blocks)[0]
        return Structured(source, kept, 0, 0, [], gone, problems(kept, source, profile, []))
    return Structured(out, made, renumbered, captions, inserted, [], problems(made, out, profile, inserted))


BLOCK_ROWS = "doc_id long, pos int, type string, kind string, level int, number string, title string, text string, raw string, structural boolean, protected boolean"


def _block_row(i: int | None, pos: int, b: Block) -> tuple:
    return i, pos, b.type, b.kind, b.level, b.number, b.title, b.body or "", b.raw, b.structural, b.protected


def document_blocks(docs: DataFrame) -> DataFrame:
    """One row per block (``BLOCK_ROWS``), in order; null and empty texts have none, repeated rows theirs each."""
    return _mapped(docs, BLOCK_ROWS, lambda i, t: [_block_row(i, k, b) for k, b in enumerate(parsed(t))])


def structured_blocks(docs: DataFrame, profile: Profile = PROFILES["business-plan"]) -> DataFrame:
    """The blocks of each document after structuring, stubs and numbers included."""
    return _mapped(docs, BLOCK_ROWS, lambda i, t: [_block_row(i, k, b) for k, b in enumerate(structured(t, profile).blocks)])


def structured_documents(docs: DataFrame, profile: Profile = PROFILES["business-plan"]) -> DataFrame:
    """(doc_id, text, renumbered, captions, placeholders, lost): every document by its profile; an empty text stays empty."""

    def rows(i: int | None, t: str) -> Iterator[tuple]:
        s = structured(t, profile)
        yield i, s.text, s.renumbered, s.captions, len(s.inserted), ",".join(s.lost)

    return _mapped(docs, "doc_id long, text string, renumbered int, captions int, placeholders int, lost string", rows)


def compliance_report(docs: DataFrame, profile: Profile = PROFILES["business-plan"]) -> DataFrame:
    """(doc_id, problem, item): what a structured document still lacks, one row per item."""
    rows = lambda i, t: [(i, k, x) for k, items in structured(t, profile).problems for x in items]
    return _mapped(docs, "doc_id long, problem string, item string", rows)


def missing_parts(docs: DataFrame, profile: Profile = PROFILES["business-plan"]) -> DataFrame:
    """(doc_id, part): required parts whose heading a text doesn't have."""
    text = F.coalesce("text", F.lit(""))
    told = F.array_compact(F.array(*(F.when(~text.rlike(f"(?u){p.found}"), F.lit(p.title)) for p in profile.parts)))
    return docs.select("doc_id", F.explode(told).alias("part"))
