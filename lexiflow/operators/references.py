"""Spans that edits must leave as they are: addresses, citations, cross-references, bibliographies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.functions.prose import lowered, may_hold

# Lines that open and close a bibliography, and literal references; the first two are addresses.
OPENS = (
    r"^(?:#{1,6}\s*)?(?:[0-9]+(?:\.[0-9]+)*[.)]?\s+)?(?:references|bibliography|works cited|список (?:использованных )?(?:источников|литературы)|библиография)\s*[:.]?$"
)
CLOSES = r"^(?:#{1,6}\s*)?(?:[0-9]+(?:\.[0-9]+)*[.)]?\s+)?(?:appendix|appendices|приложени[ея])(?:\s|$)"
LITERAL = [
    r"(?:https?://|www\.)[^\s<>\"“”]+",
    r"(?<![A-Za-z0-9_])10\.[0-9]{4,9}/[^\s<>\"“”]+",
    r"\[(?:\^?[0-9][^\]\n]*|\^[A-Za-z0-9_-]+)\]",
    r"\([^()\n]*\p{L}[^()\n]*,\s*(?:18|19|20)[0-9]{2}[a-z]?[^()\n]*\)",
    r"\[[^\]\n]+\]\((?:https?://|www\.)[^\s<>]+\)",
    r"\((?:accessed|access date|дата обращения)\s*:[^()\n]+\)",
    r"(?<![A-Za-z0-9_])(?:Table|Figure|Fig\.|Appendix|Section|Equation)\s+(?:[0-9]+(?:\.[0-9]+)*\p{L}?|[A-Z])(?!(?:[\p{L}\p{N}]|\.[0-9]))",
    r"(?<!\p{L})(?:таблиц[аыуе]|табл\.|рисунок|рисунке|рис\.|приложени[еяи]|раздел[ае]?)\s+(?:[0-9]+(?:\.[0-9]+)*\p{L}?|[А-ЯA-Z])(?!(?:[\p{L}\p{N}]|\.[0-9]))",
]
#: In small letters, what a text holds that has a bibliography's heading, and of each literal reference one of these.
OPENING = ("references", "bibliography", "works cited", "список ", "библиография")
SIGNS = [
    ("://", "www."), ("10.",), ("[",), ("(",), ("](",), ("(",), ("table", "figure", "fig.", "appendix", "section", "equation"),
    ("таблиц", "табл.", "рисун", "рис.", "приложени", "раздел"),
]
BRACKETS = {")": "(", "]": "[", "}": "{"}


def _address(value: str) -> str:
    """An address without the marks that end a sentence and the brackets that others opened.

    Each kind of bracket is looked at once, in the order listed.
    """
    value = value.rstrip(".,;:!?")
    for close, start in BRACKETS.items():
        spare = value.count(close) - value.count(start)
        tail = len(value) - len(value.rstrip(close))
        value = value[: len(value) - max(0, min(spare, tail))]
    return value


class _Finder:
    """Compiled patterns of one task."""

    def __init__(self) -> None:
        flags = regex.IGNORECASE | regex.UNICODE
        self.opens, self.closes = regex.compile(OPENS, flags), regex.compile(CLOSES, flags)
        self.literal = [regex.compile(p, flags) for p in LITERAL]

    def raw(self, text: str) -> Iterator[tuple[int, int, bool]]:
        low = lowered(text)
        inside = False
        for line in regex.finditer(r"[^\n]+", text) if any(may_hold(low, w) for w in OPENING) else ():
            bare = line.group().strip()
            inside = inside and not self.closes.search(bare)
            if self.opens.search(bare):
                inside = True
            elif inside:
                yield line.start(), line.end(), True
        for k, pattern in enumerate(self.literal):
            if not any(may_hold(low, w) for w in SIGNS[k]):
                continue
            for m in pattern.finditer(text):
                end = m.start() + len(_address(m.group())) if k < 2 else m.end()
                yield m.start(), end, False

    def merged(self, text: str) -> list[list]:
        """[start, end, bibliography]: overlapping spans as one; the first decides what it is."""
        out: list[list] = []
        for start, end, listed in sorted(self.raw(text), key=lambda s: (s[0], -s[1])):
            if out and start < out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end, listed])
        return out


def reference_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, value, bibliography): literal spans of each text, offsets in code points; null has none."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _Finder()
        for batch in batches:
            for k, t in zip(batch["k"], batch["t"], strict=True):
                rows = [(k, a, b, t[a:b], listed) for a, b, listed in finder.merged(t)]
                if rows:
                    yield pd.DataFrame(rows, columns=["k", "start", "end", "value", "bibliography"])

    kind = dict(docs.dtypes)[key]
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("t <> ''")
    found = source.mapInPandas(find, f"k {kind}, start long, end long, value string, bibliography boolean")
    return found.withColumnRenamed("k", key)


def references_kept(pairs: DataFrame, key: str = "doc_id", source: str = "source", candidate: str = "candidate") -> DataFrame:
    """(key, kept): whether both texts hold the same sequence of literal spans."""

    def sequence(column: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("start", "value")))
        return reference_ranges(pairs, key, column).groupBy(key).agg(ordered.alias(f"_{column}"))

    both = pairs.select(key).join(sequence(source), key, "left").join(sequence(candidate), key, "left")
    values = lambda c: F.coalesce(F.transform(F.col(f"_{c}"), lambda x: x["value"]), F.array().cast("array<string>"))
    return both.select(key, (values(source) == values(candidate)).alias("kept"))


def bibliography_blocks(blocks: DataFrame, key: str = "doc_id", order: str = "pos", text: str = "text") -> DataFrame:
    """``blocks`` with ``in_bibliography``: from a heading of sources on, up to end matter; the heading counts in."""
    bare = T.strip(F.coalesce(F.col(text), F.lit("")))
    event = F.when(bare.rlike(f"(?iu){OPENS}"), True).when(bare.rlike(f"(?iu){CLOSES}"), False)
    so_far = Window.partitionBy(key).orderBy(order)
    return blocks.withColumn("in_bibliography", F.coalesce(F.last(event, ignorenulls=True).over(so_far), F.lit(False)))


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text): one row per line that isn't blank."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("(?U)\\S"))
    return docs.select("doc_id", F.posexplode(lines).alias("pos", "text"))


def term_counts(text: Column, term: Column) -> Column:
    """How often a term stands in a text as whole words, in either case."""
    quoted = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}_-])\\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit("\\E(?![\\p{L}\\p{N}_-])"))
    return F.regexp_count(text, quoted)
