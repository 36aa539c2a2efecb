"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its containers, told apart by their path of tags and classes, and its text
by the container it stands in: the words of short blocks, longer blocks as a whole. Over the
pages of a host each token has an occurrence vector: how often it stands on each page. Tokens
with the same vector form a class. A class is valid if enough pages hold it, it has several
tokens, and these stand in one order on all its pages. Valid classes, nested, are the host's
template; blocks all of whose tokens belong to it are template text, and what is left are its
slots. The main slot is the template's article or main element if that holds most of the slots'
text, or else the smallest container of the template that holds all of it; extraction returns the
blocks in it. Last, elements whose role is menu, header, notice, advert or the like are left out.

Scale: pages are parsed three times (vectors; order and slots; extraction), in narrow stages.
Vectors are folded into one number by an order-free hash, so a host's tokens are aggregated on
the map side, whichever share of all pages it has; only (host, token) rows move. What is
gathered for a host is its template. The joins of templates to pages are Spark's choice by
their size. Parsing takes time and memory in proportion to a page, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stash


@dataclass(frozen=True)
class Deduction:
    """``support``: share of a host's pages that hold a class, of ``pages`` pages at least, which is also
    what a host needs for a template. ``size``: tokens of a class. ``slots``: share of the text that must be
    left to slots, or else text does not count as template (pages that are copies but for a line).
    ``words``: a block of more words is one token. ``article``: share of the slots' text that an article or main
    element must hold to be the main slot."""

    support: float = 0.5
    pages: int = 3
    size: int = 2
    slots: float = 0.3
    words: int = 12
    article: float = 0.5


#: Fixed values of HTML: elements without content, inline ones, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements and roles that are never main text.
OUTSIDE = frozenset("head nav header footer aside form button select option datalist dialog menu object svg math canvas audio video map fieldset".split()) | RAW
ROLE = re.compile(
    "(?:^|[\\s_-])(?:ads?|advert\\w*|adsense|sponsor\\w*|banner|promo\\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|menu|nav|navbar|navigation|breadcrumbs?|"
    "sidebar|side|footer|foot|header|masthead|toolbar|comments?|commentlist|disqus|replies|respond|reviews|share|sharing|social|newsletter|subscribe|signup|login|search|related|"
    "recommended|trending|widget|tags|pagination|pager|skip|hidden)(?:$|[\\s_-])",
    re.I,
)
#: Classes that tell a state, not a role: no-sidebar, has-menu, comments-open.
STATE = re.compile("(?:no|not|has|have|with|without)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)", re.I)
#: Elements whose class and id tell nothing about the role of all they hold.
ROLELESS = frozenset("html body main article".split())
#: Excluded elements that may wrap a whole page, and those that tell that one does.
WRAPS = frozenset("form fieldset".split())
CHIEF = frozenset("h1 main".split())
ROLE_ATTR = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TOKEN = re.compile("<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile("\\b(class|id|role|hidden|aria-hidden)\\b(?:\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+)))?", re.I)
#: Starting one of these ends an open paragraph; starting an element of a group ends an open one of its group.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An implied end tag looks no further up than these.
SCOPES = frozenset("ul ol dl table tbody thead tfoot tr td th div section article main body html".split())
CONTENT = ("article", "main")


@dataclass
class Block:
    """A run of text between block tags in the container ``node``; ``outside``: some container's role is not main text."""

    node: int
    text: str
    outside: bool


def _attributes(tag: str, raw: str) -> tuple[str, bool, bool]:
    """(class and id as part of a path, is the element hidden, is its role not main text)."""
    if not raw or not raw.strip(" /"):
        return "", False, False
    got = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)}
    name = " ".join(x for x in (got.get("class", ""), got.get("id", "")) if x)
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true"
    told = () if tag in ROLELESS else (x for x in name.split() if not STATE.fullmatch(x))
    role = got.get("role", "").lower() in ROLE_ATTR or any(map(ROLE.search, told))
    return re.sub("\\d+", "0", ".".join(name.split())), hidden, role


class Page:
    """A parsed page: its distinct container paths as nodes of a tree, and its blocks in order.

    Of node k: ``up`` its parent, ``part`` its last tag and classes, ``name`` a hash of the whole path,
    ``count`` how often it was opened, ``at`` where first (blocks and openings are counted through).
    Node 0 is the page.
    """

    def __init__(self, page: str) -> None:
        self.up, self.part, self.name, self.count, self.at = [0], [""], [0], [1], [0]
        self.blocks: list[Block] = []
        self.places: list[int] = []  # of the blocks, in the same count as ``at``
        self._number: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, int]] = []  # tag, node, innermost excluded element
        self._where: dict[str, list[int]] = defaultdict(list)  # where each tag stands in the stack
        self._around = [0]  # the excluded element around each excluded element
        self._within: list[int] = []  # the innermost excluded element of each block
        self._loose: dict[int, bool] = {}  # those that could be a wrapper, not menu or hidden; is it by their tag alone?
        self._chief: set[int] = set()  # the innermost around the first heading or main element
        self._text: list[str] = []
        self._place = 0
        self._parse(page)
        self._unwrap()

    def _parse(self, page: str) -> None:
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text.append(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag in INLINE:
                if tag == "br":
                    self._text.append(" ")
                continue
            if closing:
                self._pop_to(self._where[tag][-1] if self._where.get(tag) else len(self._stack))
                continue
            if tag in ENDS_P and (k := self._open({"p"})) >= 0:
                self._pop_to(k)
            elif tag in SIBLINGS and (k := self._open(SIBLINGS[tag])) >= 0:
                self._pop_to(k)
            self._flush()
            if tag in VOID:
                continue
            if tag in RAW:  # its text runs to its own end tag
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if m[3].rstrip().endswith("/") and tag in ("svg", "math", "path"):
                continue
            self._push(tag, m[3])
        if at < len(page):
            self._text.append(page[at:])
        self._flush()

    def _push(self, tag: str, raw: str) -> None:
        name, hidden, role = _attributes(tag, raw)
        node, around = self._stack[-1][1:] if self._stack else (0, 0)
        if tag in CHIEF:
            self._chief.add(around)
        if hidden or role or tag in OUTSIDE:
            number = len(self._around)
            self._around.append(around)
            if not hidden and (tag in WRAPS or tag not in OUTSIDE):
                self._loose[number] = not role
            around = number
        part = f"{tag}.{name}" if name else tag
        k = self._number.setdefault((node, part), len(self.up))
        if k == len(self.up):
            self.up.append(node)
            self.part.append(part)
            self.name.append(hashed(self.name[node], part))
            self.count.append(0)
            self.at.append(self._place)
        self.count[k] += 1
        self._place += 1
        self._where[tag].append(len(self._stack))
        self._stack.append((tag, k, around))

    def _flush(self) -> None:
        joined = " ".join(html.unescape("".join(self._text)).split())
        self._text.clear()
        if joined:
            node, around = self._stack[-1][1:] if self._stack else (0, 0)
            self._within.append(around)
            self.blocks.append(Block(node, joined, bool(around)))
            self.places.append(self._place)
            self._place += 1

    def _pop_to(self, k: int) -> None:
        self._flush()
        while len(self._stack) > k:
            self._where[self._stack.pop()[0]].pop()

    def _open(self, tags: set[str]) -> int:
        """Where one of ``tags`` is open that a new sibling would end, or -1."""
        last = lambda names: max((self._where[t][-1] for t in names if self._where.get(t)), default=-1)
        k = last(tags)
        return k if k >= last(SCOPES - tags) else -1

    def _unwrap(self) -> None:
        """Where roles exclude most of a page's text, an element with most of it is a wrapper and its own role
        doesn't count, if its tag is all that speaks for it, the first heading or main element is in it, or no
        text is left without it. Elements in it keep theirs."""
        whole = sum(len(b.text) for b in self.blocks)
        left = sum(len(b.text) for b in self.blocks if not b.outside)
        if 2 * left >= whole:
            return
        held, chief = [0] * len(self._around), [k in self._chief for k in range(len(self._around))]
        for b, k in zip(self.blocks, self._within, strict=True):
            held[k] += len(b.text)
        for k in range(len(held) - 1, 0, -1):  # an element comes after those around it
            held[self._around[k]] += held[k]
            chief[self._around[k]] |= chief[k]
        free = [True]  # no role of this element or one around it counts
        for k in range(1, len(held)):
            lifted = k in self._loose and 2 * held[k] > whole and (self._loose[k] or chief[k] or not left)
            free.append(lifted and free[self._around[k]])
        for b, k in zip(self.blocks, self._within, strict=True):
            b.outside = not free[k]

    def tokens(self, block: Block, most: int) -> list[int]:
        """The tokens of a block: its words, or if they are more than ``most`` all of it."""
        found = block.text.split(" ")
        return [hashed(self.name[block.node], f" {w}") for w in (found if len(found) <= most else [block.text])]

    def inside(self, chars: list[int]) -> list[int]:
        """Sums over each node and all below it."""
        out = list(chars)
        for k in range(len(out) - 1, 0, -1):
            out[self.up[k]] += out[k]
        return out

    def below(self, name: int) -> list[bool]:
        """Which nodes are the container of that name or stand in it."""
        out: list[bool] = []
        for k, own in enumerate(self.name):
            out.append(own == name or k > 0 and out[self.up[k]])
        return out


def hashed(name: int, part: str) -> int:
    return xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed=name & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def main_text(page: str, slot: int | None) -> str:
    """The blocks of the main slot, one a line; a page without the slot falls back to its own article or body."""
    parsed = Page(page)
    kept = [b for b in parsed.blocks if not b.outside]
    choices = [] if slot is None else [parsed.below(slot)]
    for tag in CONTENT:
        inside: list[bool] = []
        for k, part in enumerate(parsed.part):
            inside.append(part.split(".", 1)[0] == tag or k > 0 and inside[parsed.up[k]])
        choices.append(inside)
    for inside in choices:
        if found := [b.text for b in kept if inside[b.node]]:
            return "\n".join(found)
    return "\n".join(b.text for b in kept)


def host_of(url: Column) -> Column:
    """The host of a URL; an empty one for null or without."""
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _rows(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


TOKENS = {"host": pa.string(), "token": pa.int64(), "up": pa.int64(), "part": pa.string(), "rid": pa.int64(), "n": pa.int64()}


def _candidates(pages: DataFrame, rule: Deduction) -> DataFrame:
    """(host, pages, tokens): tokens (token, up, part, vector, once) of classes that enough pages and tokens form, written down.

    ``part`` is null for text; ``up`` is the container around.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, rid, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                page = Page(raw)
                rows += [(host, page.name[k], page.name[page.up[k]], page.part[k], rid, page.count[k]) for k in range(1, len(page.up))]
                text: dict[tuple[int, int], int] = {}
                for b in page.blocks:
                    for t in page.tokens(b, rule.words):
                        text[t, page.name[b.node]] = text.get((t, page.name[b.node]), 0) + 1
                rows += [(host, t, up, None, rid, n) for (t, up), n in text.items()]
            yield _rows(TOKENS, rows)

    found = pages.select("host", "rid", "html").mapInArrow(run, "host string, token long, up long, part string, rid long, n long")
    stats = found.groupBy("host", "token", "up", "part").agg(F.count("*").alias("support"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("rid", "n")).alias("vector"))
    n_pages = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= rule.pages)
    common = stash(stats.join(n_pages, "host").where((F.col("support") >= rule.support * F.col("pages")) & (F.col("support") >= rule.pages)))
    classes = common.groupBy("host", "vector").agg(F.count("*").alias("size")).where(F.col("size") >= rule.size).drop("size")
    tokens = F.struct("token", "up", "part", "vector", (F.col("total") == F.col("support")).alias("once"))
    return stash(common.join(classes, ["host", "vector"]).groupBy("host", "pages").agg(F.collect_list(tokens).alias("tokens")))


FACTS = {"host": pa.string(), "kind": pa.string(), "a": pa.int64(), "b": pa.int64(), "mark": pa.int64(), "chars": pa.int64()}


def _facts(pages: DataFrame, candidates: DataFrame, rule: Deduction) -> DataFrame:
    """(host, kind, a, b, lo, hi, chars), summed over a host's pages: ``order`` of class a, as the ends of its
    hash; ``slot`` text in container a; ``text`` in container a of which all tokens belong to class b or others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, str, int, int, int], int] = {}

            def add(*key, chars: int = 0) -> None:
                rows[key] = rows.get(key, 0) + chars

            for host, raw, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                page, known = Page(raw), {t["token"]: t for t in tokens}
                places: dict[int, int] = {}
                slot, text = [0] * len(page.up), defaultdict(lambda: [0] * len(page.up))
                for b, at in zip(page.blocks, page.places, strict=True):
                    own = [known.get(t) for t in page.tokens(b, rule.words)]
                    for k, t in enumerate(own):
                        if t and t["once"]:
                            places[t["token"]] = at * (rule.words + 1) + k
                    if b.outside:
                        continue
                    if all(own):
                        text[own[0]["vector"]][b.node] += len(b.text)
                    else:
                        slot[b.node] += len(b.text)
                for k in range(1, len(page.up)):
                    if (t := known.get(page.name[k])) and t["once"]:
                        places[t["token"]] = page.at[k] * (rule.words + 1)
                order = defaultdict(list)
                for token in sorted(places, key=lambda t: (places[t], t)):
                    order[known[token]["vector"]].append(token)
                for c, members in order.items():
                    add(host, "order", c, 0, xxhash.xxh3_64_intdigest(repr(members)) - (1 << 63))
                for kind, c, sums in [("slot", 0, slot), *(("text", c, x) for c, x in text.items())]:
                    for k, chars in enumerate(page.inside(sums)):
                        if chars and (k == 0 or page.name[k] in known):
                            add(host, kind, page.name[k], c, 0, chars=chars)
            yield _rows(FACTS, [(*k, v) for k, v in rows.items()])

    joined = pages.join(candidates.select("host", "tokens"), "host").select("host", "html", "tokens")
    found = joined.mapInArrow(run, "host string, kind string, a long, b long, mark long, chars long")
    return found.groupBy("host", "kind", "a", "b").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.sum("chars").alias("chars"))


def deduce(tokens: list[dict], facts: list[dict], rule: Deduction) -> tuple[int, str] | None:
    """The main slot of a host, as name and path of its container, or None.

    ``tokens``: candidates as ``_candidates`` has them; ``facts``: as ``_facts`` has them.
    """
    ordered = {f["a"] for f in facts if f["kind"] == "order" and f["lo"] == f["hi"]}
    valid = {t["token"]: t for t in tokens if t["once"] and t["vector"] in ordered}
    template: dict[int, str] = {0: ""}  # path of each container that stands once, below others of the template only

    def path(token: int) -> str | None:
        chain = []
        while token not in template:
            if token not in valid or valid[token]["part"] is None:
                for k in chain:
                    valid.pop(k, None)
                return None
            chain.append(token)
            token = valid[token]["up"]
        for k in reversed(chain):
            template[k] = f"{template[token]}/{valid[k]['part']}".lstrip("/")
            token = k
        return template[token]

    for t in list(valid):
        if t in valid and valid[t]["part"] is not None:
            path(t)
    # text of classes that turned out invalid is slot text after all
    inside, fixed = defaultdict(int), defaultdict(int)
    repeated = {t["vector"] for t in tokens if t["part"] is None} - {t["vector"] for t in valid.values() if t["part"] is None}
    for f in facts:
        if f["kind"] == "slot" or f["kind"] == "text" and f["b"] in repeated:
            inside[f["a"]] += f["chars"]
        elif f["kind"] == "text":
            fixed[f["a"]] += f["chars"]
    if inside[0] < rule.slots * (inside[0] + fixed[0]):
        inside = {k: inside[k] + fixed[k] for k in {*inside, *fixed}}
    need = inside.get(0, 0)
    able = [k for k, p in template.items() if k and need and not _is_text(p)]
    chief = [k for k in able if template[k].rsplit("/", 1)[-1].split(".", 1)[0] in CONTENT and inside.get(k, 0) > rule.article * need]
    best = chief or [k for k in able if inside.get(k, 0) == need]
    slot = max(best, key=lambda k: (template[k].count("/"), template[k]), default=None)
    return None if slot is None else (slot, template[slot])


def _is_text(path: str) -> bool:
    """Blocks of running text are data, however regular; containers are template."""
    return path.rsplit("/", 1)[-1].split(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "td", "th", "tr")


def templates(pages: DataFrame, rule: Deduction = Deduction()) -> DataFrame:
    """(host, slot, path): the main slot of each host that has a template; ``pages`` has host, rid and html."""
    candidates = _candidates(pages, rule)
    facts = _facts(pages, candidates, rule).groupBy("host").agg(F.collect_list(F.struct("kind", "a", "b", "lo", "hi", "chars")).alias("facts"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [deduce(t, f, rule) or (None, None) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string())], names=["host", "slot", "path"])

    joined = candidates.join(facts, "host").select("host", "tokens", "facts")
    return joined.mapInArrow(settle, "host string, slot long, path string").where("slot is not null")


def html_text(pages: DataFrame, rule: Deduction = Deduction()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, slot.

    ``text`` has the blocks of the host's main slot in page order, one a line, without containers
    whose role is menu, header, footer, sidebar, notice, advert, form or comments; character
    references are decoded and white space within a block is one space. ``slot`` is the path of the
    main slot's container. Pages of hosts with fewer than ``rule.pages`` pages, without a template or
    without its slot use their own article or main element, or else all that no role excludes; so do
    pages without a host (null url or one without). Null or empty html gives an empty text; repeated rows
    come out alike; an empty table gives no rows; other columns are left out.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("host", host_of(F.col("url")))
    slots = stash(templates(rows.where("host != ''"), rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h, s) for h, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            cols = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()), batch.column(4)]
            yield pa.record_batch(cols, names=["page_id", "url", "text", "n_chars", "slot"])

    joined = rows.join(slots, "host", "left").select("page_id", "url", "html", "slot", "path")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, slot string")
