"""Evidence in text: dates, versions, units and names as anchors, empty claims, weak sentences, style, compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import lexicon as L
from lexiflow.functions import text as T
from lexiflow.operators import spans
from lexiflow.operators.spans import dated, units


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def hard_anchors(text: Column) -> Column:
    """How many anchors but names a text holds."""
    plain = [T.count(text, p) for p in spans.ANCHORS.values()]
    found = sum((F.size(x) for x in (dated(text, "date"), dated(text, "version"), units(text))), sum(plain, F.lit(0)))
    return F.when(text.rlike("(?i)[0-9]|://|www\\."), found).otherwise(0)  # what every anchor has one of


def proper_nouns(docs: DataFrame) -> DataFrame:
    """(doc_id, value, n): acronyms, and words with a capital inside a sentence that stand nowhere in small letters.

    Words are counted by document and form, so that one long text isn't compared word by word; a null text has none.
    """
    text = _text(docs)
    words = F.regexp_extract_all(text, F.lit(T.WORD), F.lit(0))
    acronym = F.transform(F.filter(words, lambda w: w.rlike("^\\p{Lu}{2,}(?:-\\p{Lu}\\p{N}*)?$")), lambda w: F.struct(F.lower(w).alias("value"), F.lit("a").alias("kind")))
    low = F.filter(words, lambda w: (F.length(w) > 1) & (F.left(w, F.lit(1)) == F.lower(F.left(w, F.lit(1)))))
    small = F.transform(F.array_distinct(low), lambda w: F.struct(F.lower(w).alias("value"), F.lit("s").alias("kind")))
    inner = F.flatten(F.transform(T.sentences(text), lambda s: T.let(F.regexp_extract_all(s, F.lit("\\p{L}[\\p{L}\\p{N}'’-]+"), F.lit(0)), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))))))
    raised = F.filter(inner, lambda w: (F.left(w, F.lit(1)) == F.upper(F.left(w, F.lit(1)))) & (w != F.upper(w)))
    raised = F.transform(raised, lambda w: F.struct(F.lower(w).alias("value"), F.lit("c").alias("kind")))
    seen = docs.select("doc_id", F.explode(F.concat(acronym, small, raised)).alias("x")).groupBy("doc_id", "x.value")
    n = {k: F.count_if(F.col("x.kind") == k) for k in "asc"}
    named = F.when((n["s"] == 0) & ~F.col("value").isin(L.OPENER_STOP), n["c"]).otherwise(0)
    return seen.agg((n["a"] + named).alias("n")).where("n > 0")


def anchor_density(docs: DataFrame) -> DataFrame:
    """(doc_id, value): anchors, names included, on 100 words; null without words."""
    text = _text(docs)
    own = docs.select("doc_id", hard_anchors(text).alias("hard"), T.n_words(text).alias("words"))
    names = proper_nouns(docs).groupBy("doc_id").agg(F.sum("n").alias("names"))
    n = F.col("hard") + F.coalesce("names", F.lit(0))
    return own.join(names, "doc_id", "left").select("doc_id", F.when(F.col("words") > 0, n * 100.0 / F.col("words")).alias("value"))


def empty_claims(docs: DataFrame) -> DataFrame:
    """(doc_id, value): the share of sentences that promise something and give no number, date or source."""
    base = T.once(docs.select("doc_id", _text(docs).alias("t")), "doc_id", lang=T.language(F.col("t")), ss=T.flat_sentences(F.col("t")))
    claim = lambda s: T.by_language(F.col("lang"), {k: s.rlike(word_pattern(v)) for k, v in L.CLAIMS.items()})
    empty = F.size(F.filter("ss", lambda s: claim(s) & (hard_anchors(s) == 0)))
    return base.select("doc_id", F.when(F.size("ss") > 0, empty / F.size("ss")).otherwise(0.0).alias("value"))


def word_pattern(pattern: str) -> str:
    return "(?iu)(?<![\\p{L}\\p{N}_-])(?:" + pattern + ")(?![\\p{L}\\p{N}_-])"


def weak_spots(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence, words, score, reasons): every sentence with what weighs it down, 0 to 100.

    Sentences end after a closing quote or bracket too; a text without any gives no rows.
    """
    flat = F.regexp_replace(_text(docs), "\n+", " ")
    cut = F.filter(F.transform(F.split(flat, "(?<=[.!?…][\"»”')\\]]?)[\\s\\x{00A0}]+"), T.strip), lambda s: s != "")
    # beside ``posexplode`` the language would be told from the whole text again for each of its sentences
    rows = T.once(docs, "doc_id", lang=T.language(flat), cut=cut).select("doc_id", "lang", F.posexplode("cut").alias("pos", "sentence"))
    s, lang, lower = F.col("sentence"), F.col("lang"), F.lower("sentence")
    rows = rows.withColumns({"words": T.count(s, T.WORD_B).cast("long"), "opener": F.lower(F.regexp_extract(s, T.WORD_B, 0)), "hard": hard_anchors(s)})
    any_of = lambda phrases: F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(lower, p)))
    head = F.regexp_replace(lower, "^[^\\p{L}]+", "")
    doc = Window.partitionBy("doc_id")
    mean, n = F.avg("words").over(doc), F.count("*").over(doc)
    even = (mean > 0) & (F.abs(F.col("words") - mean) / mean < 0.15) & (n >= 4)
    twin = (F.col("opener") != "") & (F.count("*").over(Window.partitionBy("doc_id", "opener")) > 1)
    cliches = T.by_language(lang, {"ru": any_of(L.CLICHE_RU), "en": any_of(L.CLICHE_EN)})
    claim = T.by_language(lang, {k: s.rlike(word_pattern(v)) for k, v in L.SENTENCE_CLAIMS.items()})
    found = {
        "discourse": T.by_language(lang, {"ru": T.starts_with_any(head, L.DISCOURSE_RU), "en": T.starts_with_any(head, L.DISCOURSE_EN)}).cast("int"),
        "cliche": F.least(F.lit(2), cliches),
        "hedge": T.by_language(lang, {"ru": any_of(L.HEDGE_RU) > 0, "en": any_of(L.HEDGE_EN) > 0}).cast("int"),
        "empty_claim": (claim & (F.col("hard") == 0)).cast("int"),
        "concrete": (F.col("hard") >= 2).cast("int"),
        "repeated_opener": twin.cast("int"),
        "average_length": even.cast("int"),
    }
    rows = rows.withColumns({f"_{k}": v for k, v in found.items()})
    score = sum((F.col(f"_{k}") * F.lit(L.WEAK_WEIGHTS[k]) for k in found), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(F.col(f"_{k}") > 0, F.lit(k)) for k in found)))
    return rows.select("doc_id", "pos", "sentence", "words", T.capped(score.cast("long")).alias("score"), reasons.alias("reasons"))


def style(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_words, sentence_spread, short_share, paragraph_words) of an author's texts; zeros without words."""
    word = "[\\p{L}\\p{N}]+"
    lengths = lambda parts: F.filter(F.transform(parts, lambda x: T.count(x, word)), lambda k: k > 0)
    cut = F.regexp_extract_all(F.col("t"), F.lit("[^.!?…]+[.!?…]+|[^.!?…]+$"), F.lit(0))
    base = T.once(docs.select("doc_id", _text(docs).alias("t")), "doc_id", s=lengths(cut), p=lengths(F.split("t", "(?U)\n\\s*\n")))
    mean = lambda v: T.total(v) / F.greatest(F.lit(1), F.size(v))
    short = F.size(F.filter("s", lambda k: k <= 12)) / F.greatest(F.lit(1), F.size("s"))
    return base.select(
        "doc_id",
        mean(F.col("s")).alias("sentence_words"),
        F.coalesce(T.variation(F.col("s"), 1), F.lit(0.0)).alias("sentence_spread"),
        short.alias("short_share"),
        mean(F.col("p")).alias("paragraph_words"),
    )


def style_distance(measured: DataFrame, profile: float) -> DataFrame:
    """(doc_id, distance): how far sentence length stands from an author's, 0 to 1."""
    gap = F.abs(F.col("sentence_words") - F.lit(profile)) / F.greatest(F.lit(8.0), F.lit(profile))
    return measured.select("doc_id", F.least(F.lit(1.0), gap).alias("distance"))


def compliance(docs: DataFrame, page: int = 2000) -> DataFrame:
    """(doc_id, cited, foreign, pages): citations by style and a page estimate, one page at least."""
    text = _text(docs)
    return docs.select(
        "doc_id",
        T.count(text, "\\([^()\\n]{2,80}?,[\\s\\x{00A0}]*[0-9]{4}[a-z]?(?:,[\\s\\x{00A0}]*[0-9]{4}[a-z]?)*\\)").cast("long").alias("cited"),
        T.count(text, "\\[\\s*[0-9]+(?:\\s*[,–-]\\s*[0-9]+)*\\s*\\]").cast("long").alias("foreign"),
        F.greatest(F.lit(1).cast("long"), T.whole(F.length(text) / F.lit(float(page)))).alias("pages"),
    )


def abbreviations(docs: DataFrame) -> DataFrame:
    """(doc_id, token, pos): abbreviations without an expansion beside their first use; ``pos`` counts from 0."""
    text = F.col("t")
    token = "(?<![\\p{L}\\p{N}])[A-ZА-ЯЁ]{2,6}(?![\\p{L}\\p{N}])"
    base = T.once(docs.select("doc_id", _text(docs).alias("t")), "doc_id", t=text, tokens=F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(token), F.lit(0))), F.array(*map(F.lit, L.COMMON_ABBREVIATIONS))))
    rows = base.select("doc_id", "t", F.explode("tokens").alias("token"))
    whole = F.concat(F.lit("(?<![\\p{L}\\p{N}])"), F.col("token"), F.lit("(?![\\p{L}\\p{N}])"))
    rows = rows.withColumn("pos", F.length(F.get(F.split("t", whole, 2), F.lit(0))))
    start = F.greatest(F.col("pos") - 120, F.lit(0))
    before = F.substr("t", start + 1, F.col("pos") - start)
    after = F.substr("t", F.col("pos") + F.length("token") + 1, F.lit(120))
    told = before.rlike("(?U)\\p{L}{3,}[^()\\n]{0,80}\\(\\s*$") | after.rlike("(?U)^\\s*\\([^)\\n]{6,}\\)")
    return rows.where(~told).select("doc_id", "token", "pos")


def heading_schemas(docs: DataFrame) -> DataFrame:
    """(doc_id, headings, dominant, share, parallel) where a text has three heading-like lines: short, without a closing mark.

    Of equally frequent schemas the one met first dominates.
    """
    lines = F.transform(F.split(_text(docs), "\n"), T.strip)
    heads = F.filter(lines, lambda x: (x != "") & (F.length(x) < 90) & ~x.rlike("[.!?…]$") & (T.n_words(x) <= 12))
    first = lambda h: F.lower(F.regexp_extract(h, T.WORD_B, 0))
    kind = lambda w: F.when(w.rlike("(?:ание|ение|ация|ость|ство)$"), "nominal").when(w.rlike("(?:ть|ing)$"), "action").otherwise("name")
    schema = lambda h: F.concat_ws(":", kind(first(h)), F.when(T.count(h, T.WORD_B) <= 2, "short").otherwise("long"))
    base = T.once(docs.select("doc_id", heads.alias("h")), "doc_id", all=F.transform("h", schema)).where(F.size("all") >= 3)
    tally = F.transform(F.array_distinct("all"), lambda k: F.struct(F.size(F.filter("all", lambda x: x == k)).alias("n"), k.alias("k")))
    best = F.aggregate(tally, F.struct(F.lit(0).alias("n"), F.lit("").alias("k")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    out = T.once(base, "doc_id", n=F.size("all"), best=best)
    share = F.col("best.n") / F.col("n")
    return out.select("doc_id", F.col("n").cast("long").alias("headings"), F.col("best.k").alias("dominant"), share.alias("share"), (share >= 0.8).alias("parallel"))


def notes(scored: DataFrame) -> DataFrame:
    """(doc_id, notes): the components of a score that reach 30."""
    return scored.select("doc_id", F.array_compact(F.array(*(F.when(F.col(k) >= 30, F.lit(k)) for k in ("em_dash", "burstiness", "cliche", "antithesis")))).alias("notes"))


def highlights(ranked: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The ``n`` rows a key whose share of its history is furthest from a half, if at most 0.2 or at least 0.8."""
    far = F.abs(F.col("share") - 0.5)
    return spans.keep_last(ranked.where("share <= 0.2 or share >= 0.8"), key, [F.desc(far), F.asc("id")], n)
