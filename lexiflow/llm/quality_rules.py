"""Quality rules with cross-document line frequency (DataFrame functions only).

Each text gets word, symbol, line and repetition counts in one narrow pass of array
functions. Beside them, every line is normalised and hashed, and the distinct documents
that hold it are counted per host; lines above the limit are boilerplate, and a document
that has too little left without them is rejected.

Scale: one row (host, line hash, text hash) per distinct line of a document moves, never
text. Counting is pre-aggregated on the map side, so a line that a third of all documents
share costs each task one row; the flags travel back by the same key, which adaptive
execution may split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import SPACES, identified, let, words
from lexiflow.session import stash


@dataclass(frozen=True)
class LineRules:
    """A line may stand in ``max_docs`` distinct texts of a host, or in ``max_pct`` percent of them if
    that is more. ``min_left``: share of its words that a document must keep once such lines are gone.
    ``min_words`` and ``max_repeat_pct`` are the base rule's limits on words and repeated words."""

    max_docs: int = 10
    max_pct: int = 1
    min_left: float = 0.3
    min_words: int = 20
    max_repeat_pct: int = 30


SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8
#: What a line with a word has.
WORDED = "[^\\x09-\\x0D ]"


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORDED))


def _line_name(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACES + "+", " "))))


def _covered(starts: Column, width: int) -> Column:
    """How many positions windows at the sorted ``starts`` cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(width), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )


def _repeated(hashes: Column, width: int) -> Column:
    """Words inside windows whose hash occurs twice or more; ``hashes`` has one per window."""

    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        twin = lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["i"])
        return F.array_sort(F.filter(F.transform(s, twin), lambda i: i.isNotNull()))

    pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    slow = lambda h: _covered(let(pairs(h), places), width)
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h)))


def text_rules(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null texts have no words. Windows are compared by 64-bit hash within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = lambda h: F.transform(
        F.when(F.size(h) >= WINDOW, F.sequence(F.lit(1), F.size(h) - WINDOW + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.slice(h, i, WINDOW)),
    )
    ws = words(text)
    facts = let(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda h: F.struct(F.size(h).alias("n"), _repeated(spans(h), WINDOW).alias("r")),
    )
    out = docs.withColumn("__facts", facts).withColumn(
        "n_dup_lines", let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    )
    n, r = F.col("__facts.n").cast("long"), F.col("__facts.r").cast("long")
    return out.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.regexp_replace(text, SPACES + "+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_repeat_words": r,
            "base_failed": (n < rules.min_words) | (100 * r > rules.max_repeat_pct * n),
        }
    ).drop("__facts")


def line_flags(docs: DataFrame, rules: LineRules = LineRules()) -> tuple[DataFrame, DataFrame]:
    """(rid, boiler_words, boiler_lines): what frequent lines take from each document that has any; and (host, line): these lines by hash.

    ``docs`` has rid, text and host. A host that is null is a host of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = _line_name
    own = [F.xxhash64(F.col("host")).alias("host"), F.xxhash64(text).alias("body")]
    # the most texts of each host that may hold a line
    hosts = docs.select(*own).distinct().groupBy("host").agg(F.greatest(F.lit(rules.max_docs), F.floor(F.count("*") * rules.max_pct / 100)).alias("most"))
    hosts = stash(hosts)
    line = docs.select(*own, F.explode(F.transform(_lines(text), name)).alias("line"))
    #: A line of one text only has equal ends here and never needs an exact count.
    wide = stash(
        line.groupBy("host", "line")
        .agg(F.count("*").alias("n"), F.min("body").alias("lo"), F.max("body").alias("hi"))
        .where((F.col("n") > rules.max_docs) & (F.col("lo") != F.col("hi")))
        .join(hosts, "host")
        .where("n > most")
        .select("host", "line", "most")
    )
    counted = docs.select("rid", *own, F.explode(F.transform(_lines(text), lambda x: F.struct(name(x).alias("line"), x.alias("x")))).alias("l"))
    frequent = stash(
        counted.select("rid", "host", "body", "l.line", "l.x")
        .join(wide, ["host", "line"])
        .select("rid", "host", "body", "line", "most", F.size(words(F.col("x"))).alias("w"))
    )
    limit = stash(
        frequent.groupBy("host", "line", "body")
        .agg(F.first("most").alias("most"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_docs"), F.first("most").alias("most"))
        .where("n_docs > most")
        .select("host", "line")
    )
    flags = (
        frequent.join(limit, ["host", "line"], "left_semi")
        .groupBy("rid")
        .agg(F.sum("w").cast("long").alias("boiler_words"), F.count("*").alias("boiler_lines"))
    )
    return flags, limit


def quality_rules(docs: DataFrame, host: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """Every row of ``docs`` with its counts, ``boiler_words``, ``boiler_lines``, ``clean_text`` and ``kept``.

    ``clean_text`` is the text without the frequent lines; its other lines stay as they are.

    ``kept`` is false where ``base_failed`` is, or where the lines that more distinct texts of the
    host share than ``rules`` let leave less than ``min_left`` of its words;
    a short text that merely has such a line stays. Exact copies count as one document. Empty and null texts
    have zero counts and fail; repeated rows are judged alike; an empty table stays empty.
    Columns of ours are overwritten.
    """
    ours = ["rid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "boiler_words", "boiler_lines", "clean_text", "kept"]
    rows = identified(docs.drop(*ours))
    flags, limit = line_flags(rows.select("rid", "text", F.col(host).alias("host")), rules)
    return _judged(without_lines(rows, limit, host), flags, rules)


def clean_rows(docs: DataFrame, host: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with rid and ``clean_text``. Only the numbers of the others are joined, so text stays where it is."""
    rows = identified(docs)
    flags, limit = line_flags(rows.select("rid", "text", F.col(host).alias("host")), rules)
    rejected = stash(_judged(rows.select("rid", "text"), flags, rules).where("not kept").select("rid"))
    return without_lines(rows.join(rejected, "rid", "left_anti"), limit, host)


def _judged(rows: DataFrame, flags: DataFrame, rules: LineRules) -> DataFrame:
    out = text_rules(rows, rules).join(flags, "rid", "left").fillna(0, ["boiler_words", "boiler_lines"])
    left = F.col("n_words") - F.col("boiler_words")
    depleted = (F.col("boiler_words") > 0) & (left < rules.min_left * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(docs: DataFrame, limit: DataFrame, host: str) -> DataFrame:
    """``docs`` with ``clean_text``: the text without its host's lines in ``limit``.

    Text stays where it is while Spark finds the lists small enough to broadcast. A host's lines are a list of at most a ``max_docs``-th of its lines; each text meets it once.
    """
    lists = stash(limit.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__lines")))
    named = F.transform(F.split("text", "\n"), lambda x: F.struct(F.when(x.rlike(WORDED), _line_name(x)).alias("h"), x.alias("x")))

    def cut(lines: Column) -> Column:
        hit = F.array_intersect(F.col("__lines"), F.transform(lines, lambda x: x["h"]))
        kept = lambda h: F.filter(lines, lambda x: x["h"].isNull() | ~F.array_contains(h, x["h"]))
        return let(hit, lambda h: F.when(F.size(h) > 0, F.array_join(F.transform(kept(h), lambda x: x["x"]), "\n")).otherwise(F.col("text")))

    clean = F.when(F.col("__lines").isNull() | F.col("text").isNull(), F.col("text")).otherwise(let(named, cut))
    joined = docs.withColumn("__host", F.xxhash64(F.col(host))).join(lists, "__host", "left")
    return joined.withColumn("clean_text", clean).drop("__host", "__lines")
