"""License scans: fuzzy search for short notices.

Words are lower-cased and joined by one space. A notice that may have k errors is cut into
k + 1 pieces; by the pigeonhole principle one of them stands unchanged wherever the notice
matches, so an automaton over all pieces locates the candidates. Around each, the regex
library's bounded-error matching verifies the notice and gives the span and the errors; of
spans of one notice that overlap the one with the fewest errors stays.

Scale: a narrow stage without shuffle; the notices are parameters of fixed size.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Notice:
    """A phrase of plain lower-case words, its label, and how many letters may differ."""

    phrase: str
    label: str
    errors: int


#: Fixed by the task.
BASE = (
    Notice("under the mit license", "mit", 2),
    Notice("apache license version 2", "apache-2", 2),
    Notice("cc by nc", "cc-by-nc", 0),
)
#: Opening phrases of widely used public licences.
ADDED = (
    Notice("permission is hereby granted free of charge to any person", "mit", 4),
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("released into the public domain", "public-domain", 3),
    Notice("all rights reserved", "proprietary", 1),
)


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """(offset, text) of errors + 1 pieces of about equal size."""
    cut = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Finder:
    """The notices compiled: one automaton over all pieces, one bounded-error regex each."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for off, piece in pieces(n.phrase, n.errors):
                seeds.setdefault(piece, []).append((k, off))
        self.seeds = ahocorasick.Automaton()
        for piece, users in seeds.items():
            self.seeds.add_word(piece, (len(piece), users))
        self.seeds.make_automaton()
        self.fuzzy = [regex.compile("(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(n.phrase), n.errors)) for n in notices]

    def find(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of the matches in text whose words one space parts."""
        windows: dict[int, set[tuple[int, int, int]]] = {}
        padded = " " + norm  # a search takes no insertion at the place where it starts, so it starts a space before
        for end, (size, users) in self.seeds.iter(norm):
            for k, off in users:
                n = self.notices[k]
                at = end + 1 - size - off
                lo, hi = max(0, at - n.errors), min(len(norm), at + len(n.phrase) + n.errors)
                after = norm.find(" ", hi)
                windows.setdefault(k, set()).add((norm.rfind(" ", 0, lo + 1) + 1, after if after >= 0 else len(norm), at))
        out = []
        for k, found in windows.items():
            phrase, matches = self.notices[k].phrase, set()
            for lo, hi, at in found:
                end = at + len(phrase)
                if at >= 0 and norm.startswith(phrase, at) and (not at or norm[at - 1] == " ") and (end == len(norm) or norm[end] == " "):
                    matches.add((0, at, end))
                    continue
                rest = [(lo, hi)]
                while rest:  # the best match of a window first, then what stands before and after it
                    lo, hi = rest.pop()
                    if lo < hi and (m := self.fuzzy[k].search(padded, lo, hi + 1)):
                        a, b = m.start() - 1, m.end() - 1
                        matches.add((sum(m.fuzzy_counts), a, b))
                        rest += [(lo, a - 1), (max(b, lo + 1), hi)]
            starts: list[int] = []
            ends: list[int] = []
            for errors, a, b in sorted(matches):  # those with the fewest errors first; of what overlaps one stays
                i = bisect.bisect_left(starts, b)
                if i == 0 or ends[i - 1] <= a:
                    starts.insert(i, a)
                    ends.insert(i, b)
                    out.append((k, a, b, errors))
        return sorted(out)


@functools.lru_cache(maxsize=4)
def _finder(notices: tuple[Notice, ...]) -> Finder:
    return Finder(notices)


def exact_places(norm: str, phrase: str) -> list[int]:
    """Offsets where the phrase's words stand consecutively; places may overlap."""
    out, at = [], norm.find(phrase)
    while at >= 0:
        after = at + len(phrase)
        if (at == 0 or norm[at - 1] == " ") and (after == len(norm) or norm[after] == " "):
            out.append(at)
        at = norm.find(phrase, at + 1)
    return out


def scan_text(text: str, base: tuple[Notice, ...], notices: tuple[Notice, ...]) -> dict:
    found = WORD.findall(text.translate(LOWER))
    norm = " ".join(found)
    exact = [(at, n.label) for n in base for at in exact_places(norm, n.phrase)]
    matches = _finder(notices).find(norm)
    starts = list(itertools.accumulate((len(w) + 1 for w in found), initial=0)) if exact or matches else []
    word = lambda at: bisect.bisect_right(starts, at) - 1
    exact = [(word(at), label) for at, label in exact]
    spans = [
        {"label": notices[k].label, "first_word": word(a), "last_word": word(b - 1), "errors": e, "score": 1 - e / len(notices[k].phrase)} for k, a, b, e in matches
    ]
    at = [w for w, _ in exact]
    labels = {x for _, x in exact}
    return {
        "n_words": len(found),
        "n_base": len(exact),
        "first_word": min(at, default=None),
        "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
        "score": 1.0 if exact else max((s["score"] for s in spans), default=0.0),
        "spans": spans,
    }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:int,last_word:int,errors:int,score:double>>"
)


def license_scan(docs: DataFrame, base: tuple[Notice, ...] = BASE, added: tuple[Notice, ...] = ADDED) -> DataFrame:
    """One row per document: counts and places of the base phrases, labels, score and fuzzy spans.

    ``n_base`` counts all places of all base phrases, which must match word for word; spans come
    from the fuzzy search over base and added notices (word numbers from 0, both ends
    inclusive). ``score`` is 1 with a base place, else the best span's share of unchanged
    letters, 0 without one. Null and empty texts have no words and no labels; repeated rows are
    scanned alike; other columns are left out.
    """
    notices = base + added
    kinds = {
        "long": pa.int64(), "string": pa.string(), "double": pa.float64(),
        "spans": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("errors", pa.int32()), ("score", pa.float64())])),
    }
    cols = [c.split(" ") for c in SCHEMA.split(", ", 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t, base, notices) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array([r[name] for r in rows], kinds.get(name) or kinds[kind]) for name, kind in cols[1:])],
                names=[name for name, _ in cols],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, SCHEMA)
