"""Column functions over text: language, words, sentences, phrase counts, statistics of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_-]+"
WORD_B = "[\\p{L}\\p{N}-]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def language(text: Column) -> Column:
    """ru where Cyrillic letters outnumber Latin ones, else en."""
    return F.when(letters(text, "\\p{IsCyrillic}") > letters(text, "\\p{IsLatin}"), "ru").otherwise("en")


def letters(text: Column, kind: str) -> Column:
    """How many letters of a kind there are, found a run at a time."""
    return F.length(text) - F.length(F.regexp_replace(text, kind + "+", ""))


def once(frame: DataFrame, key: str, **columns: Column) -> DataFrame:
    """``key`` and ``columns``, each evaluated once a row: a plain projection would be merged into those above it."""
    row = F.struct(*(c.alias(k) for k, c in columns.items()))
    return frame.select(key, F.explode(F.array(row)).alias("_row")).select(key, "_row.*")


def by_language(lang: Column, values: dict) -> Column:
    ru, en = (v if isinstance(v, Column) else F.lit(v) for v in (values["ru"], values["en"]))
    return F.when(lang == "ru", ru).otherwise(en)


def n_words(text: Column) -> Column:
    return count(text, WORD)


def sentences(text: Column) -> Column:
    """Split after terminal marks; newlines stay inside."""
    return F.filter(F.split(text, "(?U)(?<=[.!?…])\\s+"), lambda s: s.rlike("(?U)\\S"))


def flat_sentences(text: Column) -> Column:
    """Split after terminal marks with newlines as spaces, trimmed."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "\n+", " "), "(?U)(?<=[.!?…])\\s+"), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda s: s != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Non-overlapping places of each phrase, summed."""
    one = lambda p: (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
    total = one(phrases[0])
    for p in phrases[1:]:
        total = total + one(p)
    return total


def starts_with_any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.startswith(text, p))


def head(sentence: Column) -> Column:
    """The first 40 letters on from the first letter, lower-cased."""
    return F.left(F.regexp_replace(F.lower(sentence), "^[^\\p{L}]+", ""), F.lit(40))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def variation(values: Column, least: int = 3) -> Column:
    """Population standard deviation over mean; null below ``least`` values or at mean 0."""
    mean = lambda v: total(v) / F.size(v)
    spread = lambda v, m: F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)) / m
    return let(values, lambda v: F.when(F.size(v) >= least, let(mean(v), lambda m: F.when(m != 0, spread(v, m)))))


def whole(x: Column) -> Column:
    """Round half up to an integer."""
    return F.floor(x + F.lit(0.5)).cast("long")


def capped(x: Column) -> Column:
    return F.least(F.lit(100).cast("long"), F.greatest(F.lit(0).cast("long"), x))


def repeats(keys: Column) -> Column:
    """How many entries have a twin among the non-empty ``keys``."""
    return let(
        F.array_sort(F.filter(keys, lambda k: k != "")),
        lambda s: F.size(F.filter(F.transform(s, lambda k, i: (F.get(s, i - 1) == k) | (F.get(s, i + 1) == k)), lambda x: x)),
    )
