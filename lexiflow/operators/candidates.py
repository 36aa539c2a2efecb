"""Checks of a rewritten sentence against its source: form, terms, vocabulary, length, opening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import edits, spans
from lexiflow.operators.references import term_counts

# Words whose number an edit must keep, endings of inflected words and of finite verbs, and bounds.
CERTAINTY = [
    ["не", "ни", "нет", "без", "нельзя", "not", "no", "never", "without", "cannot"],
    ["может", "могут", "возможно", "вероятно", "may", "might", "could", "possibly"],
    ["должен", "должна", "должны", "необходимо", "must", "shall", "required"],
]
ENDING_RU = (
    "(?:иями|ями|ами|ого|ему|ому|ыми|ими|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею|ают|яют|уют|ет|ёт|ит|ут|ют|ат|ят|ла|ли|ло|ть|ться|ся|"
    "ов|ев|ах|ях|ам|ям|ы|и|а|я|у|ю|е|о)$"
)
FINITE_RU = "(?:ает|яет|ует|ирует|ывает|ивает|ет|ёт|ит|ут|ют|ат|ят|лся|лась|лись)$"
FORBIDDEN = "[\\n\\r\\t|<>\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2069}\\x{feff}]"
STOP = {
    "ru": [
        "также", "который", "которая", "которое", "которые", "которого", "которой", "которым", "которыми", "которых",
        "этот", "эта", "это", "эти", "того", "тому", "тем", "тех", "данный", "данная", "данное", "данные",
    ],
    "en": ["also", "which", "that", "these", "those", "this", "whose", "where"],
}
LENGTH = (0.68, 1.38)
NOVELTY = (0.24, 0.74)
LEXICAL = (0.85, 1.15)


def stem(token: Column, lang: Column) -> Column:
    """A lower-case word without its ending."""
    english = F.regexp_replace(F.regexp_replace(token, "ied$", "y"), "(?:ing|ed|es|s)$", "")
    return T.by_language(lang, {"ru": F.regexp_replace(token, ENDING_RU, ""), "en": english})


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(T.WORD), F.lit(0))


def vocabulary(text: Column, lang: Column) -> Column:
    """The multiset of stems of words of five letters or more, in order. The language is told once a text, not once for each of its words."""
    kept = lambda g: F.filter(tokens(text), lambda w: (F.length(w) >= 5) & ~T.by_language(g, {k: w.isin(v) for k, v in STOP.items()}))
    return T.let(lang, lambda g: F.array_sort(F.transform(kept(g), lambda w: stem(w, g))))


def terms_kept(source: Column, candidate: Column, terms: Column) -> Column:
    return F.forall(F.coalesce(terms, F.array().cast("array<string>")), lambda t: term_counts(source, t) == term_counts(candidate, t))


def _capitals(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![\\p{L}\\p{N}])\\p{Lu}[\\p{L}\\p{N}-]+"), F.lit(0)))


def problems(source: Column, candidate: Column, terms: Column) -> Column:
    """Names of the checks a candidate fails; an empty candidate fails ``unfinished``."""
    a, b = source, candidate
    quotes = lambda t: F.array_sort(F.regexp_extract_all(t, F.lit("«[^»]+»|“[^”]+”|\"[^\"\\n]+\""), F.lit(0)))
    word = lambda ws: "(?iu)(?<![\\p{L}\\p{N}_-])(?:" + "|".join(ws) + ")(?![\\p{L}\\p{N}_-])"
    certainty = [T.count(a, word(ws)) != T.count(b, word(ws)) for ws in CERTAINTY]
    unpaired = [T.count(b, p) != T.count(b, q) for p, q in (("\\(", "\\)"), ("«", "»"), ("“", "”"))]
    either = lambda tests: F.exists(F.array(*tests), lambda x: x)
    checks = {
        "marks": (F.length(b) > 1800) | b.rlike(FORBIDDEN),
        "unfinished": ~T.strip(b).rlike("[.!?…][»”\"]?$") | b.rlike("(?i)[,;:]\\s*[.!?]|(?<![A-Za-z0-9_])([A-Za-z0-9_]+)\\s+\\1(?![A-Za-z0-9_])"),
        "quotes": quotes(a) != quotes(b),
        "terms": ~terms_kept(a, b, terms),
        "certainty": either(certainty),
        "lost_name": ~F.forall(_capitals(a), lambda w: term_counts(a, w) == term_counts(b, w)),
        "new_name": ~F.forall(_capitals(b), lambda w: term_counts(a, w) > 0),
        "brackets": either(unpaired),
    }
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())))


def check(pairs: DataFrame, source: str = "source", candidate: str = "candidate", terms: str | None = None) -> DataFrame:
    """``pairs`` with ``reasons``, those of qualifiers among them, and ``ok``; a null text counts as empty."""
    fixed = pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in (source, candidate)})
    listed = F.col(terms) if terms else F.array().cast("array<string>")
    found = spans.qualifiers_kept(fixed, source, candidate).withColumn("_p", problems(F.col(source), F.col(candidate), listed))
    found = found.withColumn("reasons", F.concat(F.transform("changed", lambda g: F.concat(F.lit("qualifier:"), g)), "_p"))
    return found.drop("changed", "_p").withColumn("ok", F.size("reasons") == 0)


def profile(pairs: DataFrame, source: str = "source", candidate: str = "candidate", verified: str | None = None) -> DataFrame:
    """``pairs`` with length_ratio, novelty, same_language, stable_vocabulary, natural_opening, n_sentences and ``safe``.

    ``verified``: a column that tells whether a candidate's meaning is checked; its vocabulary may differ then,
    if it has about as many words as the source.
    """
    fixed = pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in (source, candidate)})
    a, b = F.col(source), F.col(candidate)
    lang, n = T.language(a), F.size(tokens(a))
    first = lambda t: F.coalesce(F.get(tokens(t), F.lit(0)), F.lit(""))
    new_verb = (lang == "ru") & (first(a) != first(b)) & first(b).rlike(FINITE_RU)
    out = fixed.withColumns(
        {
            "length_ratio": F.when(n > 0, F.size(tokens(b)) / n).otherwise(0.0),
            "novelty": edits.lexical_novelty(source, candidate),
            "same_language": (F.size(tokens(b)) < 4) | (T.language(b) == lang),
            "stable_vocabulary": vocabulary(a, lang) == vocabulary(b, lang),
            "natural_opening": ~new_verb,
            "n_sentences": F.size(T.flat_sentences(b)).cast("long"),
        }
    )
    near = F.coalesce(F.col(verified), F.lit(False)) & F.col("length_ratio").between(*LEXICAL) if verified else F.lit(False)
    safe = F.col("length_ratio").between(*LENGTH) & F.col("novelty").between(*NOVELTY) & F.col("n_sentences").between(1, 2)
    return out.withColumn("safe", safe & F.col("same_language") & (F.col("stable_vocabulary") | near) & F.col("natural_opening"))


def volume(source: Column, candidate: Column, least: float = 0.85, most: float = 1.25) -> Column:
    """shrunk, grown or null: words of a candidate against its source's."""
    ratio = T.n_words(candidate) / T.n_words(source)
    return F.when(T.n_words(source) > 0, F.when(ratio < least, "shrunk").when(ratio > most, "grown"))


# The similarity in meaning that a freer wording needs, and bounds of an author's profile and terms.
SIMILAR = 0.86
PROFILE = {"sentence_words": (1, 1000), "sentence_spread": (0, 20), "short_share": (0, 1), "paragraph_words": (1, 60_000)}
PROFILE_WORDS, PROFILE_SENTENCES, TERM_LENGTH, TERMS = 200, 8, 80, 40


def gated(pairs: DataFrame, a: str = "source_vector", b: str = "candidate_vector", terms: str | None = None) -> DataFrame:
    """``pairs`` (source, candidate, and a vector of each) that pass the checks, with ``similarity`` and ``verified``.

    ``verified`` tells that a candidate whose vocabulary differs means much the same; where it is false such a
    candidate must keep the vocabulary. Null or unfit vectors verify nothing.
    """
    fine = check(pairs, terms=terms).where("ok").drop("ok", "reasons")
    lang = T.language(F.col("source"))
    moved = vocabulary(F.col("source"), lang) != vocabulary(F.col("candidate"), lang)
    near = spans.cosine(F.col(a), F.col(b))
    sure = near.isNotNull() & ~F.isnan(near) & (near >= SIMILAR) & (near <= 1)
    return fine.withColumns({"similarity": near, "verified": F.coalesce(moved & sure, F.lit(False))})


def valid_profiles(profiles: DataFrame) -> DataFrame:
    """The rows of ``profiles`` (language, words, sentences and the measures of ``PROFILE``) that are fit to use; nulls and NaN are not."""
    fit = F.col("language").isin("ru", "en") & (F.col("words") >= PROFILE_WORDS) & (F.col("sentences") >= PROFILE_SENTENCES)
    for name, (low, high) in PROFILE.items():
        fit = fit & ~F.isnan(F.col(name).cast("double")) & F.col(name).between(low, high)
    return profiles.where(F.coalesce(fit, F.lit(False)))


def plain_terms(terms: Column) -> Column:
    """An array of terms trimmed, distinct, without marks of control or markup, of a bounded length and number."""
    found = F.array_distinct(F.filter(F.transform(terms, T.strip), lambda t: t != ""))
    return F.slice(F.filter(found, lambda t: (F.length(t) <= TERM_LENGTH) & ~t.rlike("[<>\\x00-\\x1f]")), 1, TERMS)
