"""Anchors, guards, intervals and the small relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import lexicon as L
from lexiflow.functions import text as T
from lexiflow.session import stash

# What counts as a verifiable anchor.
ANCHORS = {
    "url": "(?i)https?://[^\\s<>()]+|www\\.[^\\s<>()]+",
    "citation": "\\([^()\\n]{2,80}?,\\s*[0-9]{4}[a-z]?\\)|\\[\\s*[0-9]+(?:\\s*[,–-]\\s*[0-9]+)*\\s*\\]",
    "number": "[0-9]+(?:[.,][0-9]+)?(?:\\s*%)?",
}


#: Bounds of words by ASCII letters, whatever the regex engine takes \\b for.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
GUARDED = ["url", "citation", "date", "version", "number", "unit"]


def dated(text: Column, kind: str) -> Column:
    """All dates or versions of a text."""
    # both begin with a digit or letter, so their first bound is that none stands before
    body = "(?<![A-Za-z0-9_])" + L.EVIDENCE[kind].removeprefix("\\b")
    return F.regexp_extract_all(text, F.lit("(?iu)" + body.replace("\\b", EDGE).replace("\\s", "[\\s\\x{00A0}]")), F.lit(0))


def units(text: Column) -> Column:
    """Units and currencies that follow a digit."""
    return F.regexp_extract_all(text, F.lit("(?iu)(?<=[0-9][\\s\\x{00A0}]?)(?:" + L.UNITS.replace("\\b", EDGE) + ")"), F.lit(0))


def anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, type, value, n): how often each anchor stands in a text, values normalised; a null text has none.

    Types: url, citation, date, version, number, unit, and proper for names.
    """
    from lexiflow.operators.evidence import proper_nouns

    t = F.coalesce(F.col(text), F.lit(""))
    found = {k: F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in ANCHORS.items()} | {"date": dated(t, "date"), "version": dated(t, "version"), "unit": units(t)}
    typed = lambda kind: lambda x: F.struct(F.lit(kind).alias("type"), anchor_value(x).alias("value"))
    listed = F.concat(*(F.transform(v, typed(k)) for k, v in found.items()))
    facts = docs.select("doc_id", F.explode(listed).alias("a")).groupBy("doc_id", "a.type", "a.value").agg(F.count("*").alias("n"))
    names = proper_nouns(docs.select("doc_id", F.col(text).alias("text"))).select("doc_id", F.lit("proper").alias("type"), "value", F.col("n").cast("long").alias("n"))
    return facts.where("value <> ''").unionByName(names)


def anchor_value(value: Column) -> Column:
    return F.lower(T.strip(F.regexp_replace(F.regexp_replace(value, "(?U)\\s+", " "), "[«»\"'“”]", "")))


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, type, n): how many anchors of each type a text has; null and empty texts have no rows."""
    return anchors(docs).groupBy("doc_id", "type").agg(F.sum("n").alias("n"))


def anchor_diff(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """(doc_id, type, value, lost, added, guarded): multiset difference of anchors; equal ones are left out.

    ``guarded``: an edit may not change it; names are only noted.
    """
    return facts_diff(anchors(source), anchors(candidate))


def facts_diff(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """``anchor_diff`` of two tables of anchors."""
    key = ["doc_id", "type", "value"]
    a, b = (x.withColumnRenamed("n", n) for x, n in ((source, "a"), (candidate, "b")))
    n = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    both = a.join(b, key, "full").select(*key, F.greatest(n, F.lit(0)).cast("long").alias("lost"), F.greatest(-n, F.lit(0)).cast("long").alias("added"))
    return both.where("lost > 0 or added > 0").withColumn("guarded", F.col("type").isin(*GUARDED))


def qualifiers_kept(pairs: DataFrame, source: str = "source", candidate: str = "candidate") -> DataFrame:
    """``pairs`` with ``changed``: the groups of qualifiers whose counts differ."""
    counted = pairs.withColumns({"_a": qualifier_counts(F.col(source)), "_b": qualifier_counts(F.col(candidate))})
    return counted.withColumn("changed", groups_changed("_a", "_b")).drop("_a", "_b")


#: Letters that a search in either case takes for others, though their small letters differ.
ODD = "[\\x{130}\\x{131}\\x{17f}\\x{1c80}-\\x{1c8a}\\x{212a}\\x{a64a}\\x{a64b}]"


def qualifier_counts(text: Column) -> Column:
    """How often each qualifier stands in a text, group by group; only those are searched whose letters it has."""

    def counts(x: Column) -> Column:
        one = lambda w: F.when(x["odd"] | F.contains(x["low"], F.lit(w)), T.count(x["text"], "(?iu)(?<![\\p{L}\\p{N}_-])\\Q" + w + "\\E(?![\\p{L}\\p{N}_-])")).otherwise(0)
        return F.array(*(F.array(*map(one, ws)) for ws in L.QUALIFIERS.values()))

    return F.when(text.isNotNull(), T.let(F.struct(text.alias("text"), F.lower(text).alias("low"), text.rlike(ODD).alias("odd")), counts))


def groups_changed(source: str, candidate: str) -> Column:
    """The groups of qualifiers whose counts (``qualifier_counts``) differ."""
    return F.array_compact(F.array(*(F.when(F.get(source, F.lit(i)) != F.get(candidate, F.lit(i)), F.lit(k)) for i, k in enumerate(L.QUALIFIERS))))


def merge_ranges(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end): overlapping ranges become one; those that only touch stay apart."""
    w = Window.partitionBy(key).orderBy("start", F.desc("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = ranges.withColumn("new", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0))
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return new.withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def outside_ranges(edits: DataFrame, frozen: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edits that overlap no frozen range of their document."""
    e, f = edits.alias("e"), frozen.alias("f")
    return e.join(f, (F.col(f"e.{key}") == F.col(f"f.{key}")) & (F.col("e.start") < F.col("f.end")) & (F.col("e.end") > F.col("f.start")), "left_anti")


def worst(scored: DataFrame, share: float = 0.35, limit: int = 8) -> DataFrame:
    """The top ``share`` of each document's sentences by score, one at least and ``limit`` at most."""
    per = Window.partitionBy("doc_id")
    rank = F.row_number().over(per.orderBy(F.desc("score"), "pos"))
    n = F.count("*").over(per)
    keep = F.greatest(F.lit(1), F.least(T.whole(F.col("n") * F.lit(share)), F.lit(limit)))
    return scored.withColumns({"rank": rank, "n": n}).where(F.col("rank") <= keep).drop("n")


def sentence_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence, words): one row per sentence."""
    s = docs.select("doc_id", F.posexplode(T.flat_sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))
    return s.withColumn("words", T.n_words(F.col("sentence")).cast("long"))


def ranked_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, n, all, below): each distinct value of ``rows`` (keys, value, n), how many rows its key has, and how many of a smaller value.

    Values are counted first, then ranked in ranges of the sort order, so that a key with most rows is
    never in one task: only totals per range and key meet.
    """
    counts = rows.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    parts = stash(counts.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy(*keys, "part").agg(F.sum("n").alias("in_part"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("base"), F.sum("in_part").over(by_key).alias("all"))
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, [*keys, "part"])
    return stash(ranked.select(*keys, "value", "n", "all", (F.col("base") + F.col("inside")).alias("below")))


def mid_rank(history: DataFrame, now: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """(keys, id, value, median, share): where a value stands among its key's history; silent below ``least`` samples.

    Null values are left out on both sides.
    """
    mine = now.where("value is not null").select(*keys, "id", "value")
    seen = history.where("value is not null").select(*keys, "value", F.lit(1).alias("n")).unionByName(mine.select(*keys, "value", F.lit(0).alias("n")))
    ranked = ranked_values(seen, keys)
    holds = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("n"))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = ranked.where(holds(low) | holds(high)).groupBy(*keys).agg(F.avg("value").alias("median"))
    out = mine.join(ranked, [*keys, "value"]).join(middle, keys).where(F.col("all") >= least)
    return out.select(*keys, "id", "value", "median", ((F.col("below") + F.col("n") / 2) / F.col("all")).alias("share"))


def keep_last(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [-1, 1]; NaN for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(float("nan")))
