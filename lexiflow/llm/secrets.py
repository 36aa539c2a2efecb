"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: what every match must
contain. A batch of documents is indexed once (postings of the trigrams that some rule
needs), each query intersects and unites postings, and only the documents left are given to
the regex. A rule without mandatory trigrams scans every document.

Scale: a narrow stage without shuffle; a task holds one Arrow batch and its postings.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


#: Fixed by the task: the base kinds, in their order.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24),
)
#: Publicly documented formats of credentials.
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", "bearer\\x20+[A-Za-z0-9._~+/-]{20,}=*", any_case=True),
    Rule("login", "://[^\\s/:@]{1,64}:[^\\s/:@]{3,64}@"),
)
RULES = BASE + ADDED
#: Alternatives of a literal run that are told apart before it counts as unknown.
MOST_RUNS = 64


def query_of(pattern: str) -> tuple:
    """What each match of ``pattern`` must contain, over lower-case text.

    ("all", q...) and ("any", q...) nest; a leaf is a trigram; ("all",) holds for every text.
    """
    return _query(list(_parser.parse(pattern)))


def _query(items: list) -> tuple:
    parts: list = []
    runs: set[str] = {""}

    def flush() -> None:
        nonlocal runs
        if all(len(s) >= 3 for s in runs):
            parts.append(("any", *(("all", *sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(runs))))
        runs = {""}

    for item in items:
        known = _strings(item)
        if known is not None and len(runs) * len(known) <= MOST_RUNS:
            runs = {a + b for a in runs for b in known}
            continue
        flush()
        if known is not None:
            runs = known
            continue
        parts.extend(q for q in _inner(item) if q != ("all",))
    flush()
    return ("all", *parts)


def _inner(item: tuple) -> list[tuple]:
    """Queries of an item that stands for no small set of strings."""
    op, arg = item
    if op is C.SUBPATTERN:
        return [_query(list(arg[3]))]
    if op is C.BRANCH:
        return [("any", *(_query(list(b)) for b in arg[1]))]
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
        return [_query(list(arg[2]))]
    return []


def _strings(item: tuple) -> set[str] | None:
    """The lower-case strings that an item stands for, where they are few; else None."""
    op, arg = item
    if op is C.LITERAL:
        c = chr(arg).lower()
        return {c} if c.isascii() else None
    if op is C.IN and all(o is C.LITERAL and arg_ < 128 for o, arg_ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is C.SUBPATTERN:
        return _product(list(arg[3]))
    if op is C.BRANCH:
        each = [_product(list(b)) for b in arg[1]]
        return None if None in each else _few(set().union(*each))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 8:
        one = _product(list(arg[2]))
        out: set[str] | None = set()
        for n in range(arg[0], arg[1] + 1):
            grown = {""}
            for _ in range(n):
                grown = _few({a + b for a in grown for b in one}) if one and grown else None
            out = _few(out | grown) if out is not None and grown is not None else None
        return out
    return None


def _few(found: set[str]) -> set[str] | None:
    return found if len(found) <= MOST_RUNS else None


def _product(items: list) -> set[str] | None:
    runs: set[str] | None = {""}
    for item in items:
        known = _strings(item)
        runs = _few({a + b for a in runs for b in known}) if known is not None and runs is not None else None
    return runs


def trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:])) if len(query) > 1 else set()


class Scanner:
    """The rules compiled, with their queries and the trigrams that these need."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern, (re.A | re.I) if r.any_case else re.A), query_of(r.pattern)) for r in rules]
        names = sorted(set().union(*(trigrams(q) for *_, q in self.rules)))
        self.number = {t: i for i, t in enumerate(names)}
        self.wanted = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.wanted[a << 16 | b << 8 | c] = i
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, texts: list[str]) -> list[np.ndarray]:
        """For each wanted trigram the sorted numbers of the documents that hold it."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        hits: list[np.ndarray] = []
        at, n = 0, len(raw)
        while at < n:  # slices of a few MB keep the arrays small
            end, size = at, 0
            while end < n and (end == at or size < 4 << 20):
                size += len(raw[end]) + 1
                end += 1
            b = self.fold[np.frombuffer(b"\n".join(raw[at:end]) + b"\n", np.uint8)].astype(np.uint32)
            code = self.wanted[(b[:-2] << 16 | b[1:-1] << 8 | b[2:])] if len(b) > 2 else np.empty(0, np.int16)
            pos = np.flatnonzero(code >= 0)
            starts = np.cumsum([0, *(len(r) + 1 for r in raw[at:end])])
            doc = np.searchsorted(starts, pos, side="right") - 1 + at
            hits.append(np.unique(code[pos].astype(np.int64) * n + doc))
            at = end
        pairs = np.concatenate(hits) if hits else np.empty(0, np.int64)
        pairs.sort()
        edges = np.searchsorted(pairs, np.arange(len(self.number) + 1) * n)
        return [pairs[a:b] - i * n for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]

    def candidates(self, query, postings: list[np.ndarray], n: int) -> np.ndarray | None:
        """Documents that satisfy ``query``; None stands for all."""
        if isinstance(query, str):
            return postings[self.number[query]]
        each = [self.candidates(q, postings, n) for q in query[1:]]
        if query[0] == "any":
            return None if any(e is None for e in each) else functools.reduce(np.union1d, each)
        some = [e for e in each if e is not None]
        return functools.reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), some) if some else None

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of all secrets of each text, sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = self.postings(texts)
        for k, (rule, pattern, query) in enumerate(self.rules):
            docs = self.candidates(query, index, len(texts))
            for i in range(len(texts)) if docs is None else docs.tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(f) for f in found]


@functools.lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): the secrets of each text as structs (kind, start, end), by start, then rule order.

    Positions count code points, end exclusive; per kind matches are leftmost and do not
    overlap. Null and empty texts have none. Rows come out as they went in, repeated ones too;
    other columns are left out.
    """
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            found = scanner.scan(batch.column(1).to_pylist())
            spans = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in f] for f in found]
            yield pa.record_batch([batch.column(0), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")
