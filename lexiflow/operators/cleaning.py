"""Cleaning, typography and removal of adjacent repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import prose as P
from lexiflow.functions import text as T

#: Blanks as the steps mean them.
_S = " \\t\\n\\x0b\\f\\r"
# The order and form of the cleaning steps: pattern, replacement, counter, and what a text must hold for the pattern to match (None: it is always tried).
STEPS = [
    ("\r\n?", "\n", None, ("\r",)),
    ("[\u200b-\u200f\u2060-\u2064\ufeff\u00ad]+", "", "artifacts", None),
    ("(?:\\\\[rR]\\\\[nN]|\\\\[rR][nN]|/[rR][nN])", "\n\n", "artifacts", ("\\", "/")),
    (f"(?<![A-Za-z0-9_])[nN][{_S}\u00a0]+[nN](?=[{_S}\u00a0]|\\p{{L}})", "\n\n", "artifacts", ("n", "N")),
    (f"\\.[{_S}]+\\.[{_S}]+\\.(?:[{_S}]+\\.)*", "…", "punctuation", (".",)),
    (f"\\.[{_S}]+\\.(?=[{_S}]*[а-яё])", ",", "punctuation", (".",)),
    (f"\\.[{_S}]+\\.", ".", "punctuation", (".",)),
    (f"([!?])(?:[{_S}]*\\1)+", "\\1", "punctuation", ("!", "?")),
    ("[ \t]+([,.;:!?])", "\\1", "spacing", (" ,", " .", " ;", " :", " !", " ?", "\t")),
    ("([,;:!?])(?=[А-ЯЁа-яёA-Za-z])", "\\1 ", "spacing", None),
    ("([.!?…])(?=[А-ЯЁ])", "\\1 ", "spacing", None),
    ("[ \t]{2,}", " ", "spacing", ("  ", "\t")),
    ("[ \t]+\n", "\n", "spacing", (" \n", "\t\n")),
    ("\n[ \t]+", "\n", "spacing", ("\n ", "\n\t")),
    ("\n{3,}", "\n\n", "spacing", ("\n\n\n",)),
    ("-\n{1,2}(?=[а-яё])", "-", "joined_breaks", ("-\n",)),
    (f"([^{_S}.!?…:])\n{{2,}}(?=[а-яё])", "\\1 ", "joined_breaks", ("\n\n",)),
    (f"([^{_S}.!?…:])\n(?=[а-яё])", "\\1 ", "joined_breaks", ("\n",)),
]
URL = "(?i)https?://[^\\s<>()]+"
_URL = regex.compile("(?i)https?://[^ \\t\\n\\x0b\\f\\r<>()]*[^ \\t\\n\\x0b\\f\\r<>().,!?;:]")
#: Private-use letters; one that a text doesn't hold stands for its URLs while their surroundings are cleaned.
MARKS = [chr(c) for c in range(0xE000, 0xF900)]
COUNTERS = ("artifacts", "punctuation", "spacing", "joined_breaks")
_STEPS = [(regex.compile(p), to, counter, needs) for p, to, counter, needs in STEPS]


def cleaned(text: str) -> tuple[str, dict[str, int]]:
    """(a text after all steps, changes by kind); a private-use letter stands for each URL during the steps.

    A text with URLs that holds every such letter itself is left as it is.
    """
    urls = _URL.findall(text) if "://" in text else []
    counts = dict.fromkeys(COUNTERS, 0)
    mark = next((m for m in MARKS if m not in text), None) if urls else None
    if urls:
        if mark is None:
            return text, counts
        text = _URL.sub(mark, text)
    for k, (pattern, to, counter, needs) in enumerate(_STEPS):
        if needs is None or any(x in text for x in needs):
            # zero-width letters are dropped a run at a time but counted one by one
            before = len(text)
            text, n = pattern.subn(to, text)
            if counter:
                counts[counter] += before - len(text) if k == 1 else n
    if text[:1].isspace() or text[-1:].isspace():
        text = regex.sub("^\\s+|\\s+$", "", text)
    if urls:
        parts = text.split(mark)
        text = "".join(p + (urls[k] if k < len(urls) else "") for k, p in enumerate(parts))
    return text, counts


def clean(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, text and a counter per kind of change, with columns to ``carry``; a null text is empty.

    One narrow pass in Arrow batches: each step replaces and counts at once, which columns can't.
    """
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cleaned(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([c[k] for _, c in found], pa.int64()) for k in COUNTERS]
            yield pa.record_batch([batch.column(0), pa.array([t for t, _ in found], pa.string()), *counts, *batch.columns[2:]], names=["doc_id", "text", *COUNTERS, *carry])

    schema = f"doc_id {kinds['doc_id']}, text string, " + ", ".join(f"{k} long" for k in COUNTERS) + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry).mapInArrow(run, schema)


def typeset(text: str) -> str:
    """Typographic marks by language, as ``typography`` and ``nonbreaking`` set them in columns."""
    ru = P.language(text) == "ru"
    text = text.replace("...", "…")
    if '"' in text:
        text = regex.sub("\"([^\"\n]{1,400})\"", "«\\1»" if ru else "“\\1”", text)
    if not ru and "'" in text:
        text = regex.sub("(\\p{L})'(\\p{L})", "\\1’\\2", text)
    if not re.search("[0-9]", text):
        return text
    text = regex.sub("([0-9])\\s*[-—]\\s*([0-9])", "\\1–\\2", text)
    for body in (UNIT_AFTER, NUMBER_SIGN):
        text = regex.sub(body.replace("\\x{00A0}", "\u00a0"), "\\1\u00a0\\2", text)
    return text


def dedup_key(text: Column) -> Column:
    """Lower case, runs of blanks and punctuation as one space."""
    return T.strip(F.regexp_replace(F.lower(text), "(?U)[\\s\\p{P}]+", " "))


def _unrepeated(text: Column, separator: str, least: int) -> Column:
    """(kept, n): blocks whose key isn't that of the block before, and how many blocks there were."""
    blocks = F.filter(F.transform(F.split(text, separator), T.strip), lambda b: b != "")
    pairs = F.transform(blocks, lambda b: F.struct(b.alias("b"), dedup_key(b).alias("k")))
    fresh = lambda s: F.filter(s, lambda x, i: ~F.coalesce((F.length(x["k"]) > least) & (F.get(s, i - 1)["k"] == x["k"]), F.lit(False)))
    return T.let(pairs, lambda s: F.struct(F.transform(fresh(s), lambda x: x["b"]).alias("kept"), F.size(s).alias("n")))


def drop_adjacent(docs: DataFrame, separator: str = "\n\n", least: int = 24) -> DataFrame:
    """doc_id, text, duplicates: a block goes where the block kept before it has the same key of over ``least`` letters.

    A narrow fold within each text: no rows move.
    """
    out = docs.select("doc_id", _unrepeated(F.coalesce("text", F.lit("")), separator, least).alias("f"))
    return out.select("doc_id", F.array_join("f.kept", separator).alias("text"), (F.col("f.n") - F.size("f.kept")).cast("long").alias("duplicates"))


def adjacent_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, duplicates at line grain, by a window over exploded lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).select("doc_id", "pos", dedup_key(F.col("line")).alias("k"))
    before = F.lag("k").over(Window.partitionBy("doc_id").orderBy("pos"))
    same = F.coalesce((F.length("k") > 24) & (before == F.col("k")), F.lit(False))
    return lines.withColumn("same", same).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("same").alias("duplicates"))


def typography(docs: DataFrame) -> DataFrame:
    """doc_id, text and counts of ellipsis, quotes, ranges: typographic marks by language."""
    text = F.coalesce("text", F.lit(""))
    now = docs.select("doc_id", text.alias("t"), T.language(text).alias("lang"))
    now = now.withColumns({"ellipsis": T.count(F.col("t"), "\\.{3}").cast("long"), "t": F.regexp_replace("t", "\\.{3}", "…")})
    pair, apostrophe = "\"([^\"\n]{1,400})\"", "(\\p{L})'(\\p{L})"
    quoted = T.by_language(F.col("lang"), {"ru": F.regexp_replace("t", pair, "«$1»"), "en": F.regexp_replace("t", pair, "“$1”")})
    now = now.withColumns({"quotes": T.count(F.col("t"), pair).cast("long"), "t": quoted})
    curly = F.col("lang") != "ru"
    now = now.withColumns({"quotes": F.col("quotes") + F.when(curly, T.count(F.col("t"), apostrophe)).otherwise(0), "t": F.when(curly, F.regexp_replace("t", apostrophe, "$1’$2")).otherwise(F.col("t"))})
    span = "([0-9])\\s*[-—]\\s*([0-9])"
    return now.select("doc_id", F.regexp_replace("t", span, "$1–$2").alias("text"), "ellipsis", "quotes", T.count(F.col("t"), span).cast("long").alias("ranges"))


# List lines, sentence openings that may start a paragraph, sizes of paragraphs in words, and
# units and abbreviations that stay with their number.
LIST_LINE = "^(?:[-*•▪◦]|[0-9]+[.)])\\s+"
TRANSITION = (
    "(?iu)^(?:однако|при этом|кроме того|вместе с тем|следовательно|таким образом|итак|например|так(?:,|\\s+как)|важно|особ(?:ое|ую|ая)|следующ|"
    "перв(?:ая|ое|ый)|наряду|с другой стороны|в то же время|наконец|несмотря|поскольку|благодаря|отдельно)"
)
REFLOW = {"from": 190, "soft": 55, "hard": 80, "most": 170, "tail": 35}
UNIT_AFTER = (
    "([0-9])[\\s\\x{00A0}]+(млн|млрд|тыс|руб|коп|шт|ед|чел|кг|км|см|мм|га|мин|сек|м|ч|mln|bn|RUB|USD|EUR|CNY|km|kg|ha|pp|units|years|%|₽|\\$|€|"
    "руб\\.|коп\\.|тыс\\.|млн\\.|млрд\\.)(?!\\p{L})"
)
NUMBER_SIGN = "((?<=[A-Za-z0-9_])(?:с|стр|рис|табл|п|гл)\\.|№|§)[\\s\\x{00A0}]+([0-9])"


def nonbreaking(text: Column) -> Column:
    """Blanks between a number and its unit, and after a number sign, as no-break spaces."""
    return F.regexp_replace(F.regexp_replace(text, UNIT_AFTER, "$1\u00a0$2"), NUMBER_SIGN, "$1\u00a0$2")


def nonbreaking_count(text: Column) -> Column:
    return T.count(text, UNIT_AFTER) + T.count(text, NUMBER_SIGN)


def is_structural(block: Column) -> Column:
    """Lists, tab-separated rows and heading-like single lines."""
    lines = F.filter(F.transform(F.split(block, "\n"), T.strip), lambda x: x != "")
    alone = lambda x: (T.n_words(x) <= 12) & (F.startswith(x, F.lit("#")) | ~x.rlike("[.!?…]$"))
    listed = lambda v: F.exists(v, lambda x: x.rlike(LIST_LINE))
    tabbed = lambda v: (F.size(v) > 1) & F.forall(v, lambda x: F.contains(x, F.lit("\t")))
    return T.let(lines, lambda v: listed(v) | tabbed(v) | ((F.size(v) == 1) & F.coalesce(alone(F.get(v, F.lit(0))), F.lit(False))))


def block_sentences(block: Column) -> Column:
    """Sentences of a block read as one line; a mark inside a word ends none."""
    flat = T.strip(F.regexp_replace(block, "(?U)\\s+", " "))
    found = F.regexp_extract_all(flat, F.lit("(?s).+?(?:[.!?…]+[\"»”')\\]]*|$)(?=\\s|$)"), F.lit(0))
    return F.filter(F.transform(found, T.strip), lambda x: x != "")


def _thin_sentences(block: Column) -> Column:
    """(text, dropped): a block without sentences that repeat the one before; structural blocks stay."""
    keyed = F.transform(block_sentences(block), lambda x: F.struct(x.alias("s"), dedup_key(x).alias("k")))
    twin = lambda v, x, i: F.coalesce((F.length(x["k"]) > 24) & (F.get(v, i - 1)["k"] == x["k"]), F.lit(False))
    kept = lambda v: F.transform(F.filter(v, lambda x, i: ~twin(v, x, i)), lambda x: x["s"])
    thin = T.let(keyed, lambda v: T.let(kept(v), lambda k: F.struct(F.array_join(k, " ").alias("text"), (F.size(v) - F.size(k)).alias("dropped"))))
    return F.when(is_structural(block), F.struct(T.strip(block).alias("text"), F.lit(0).alias("dropped"))).otherwise(thin)


def _reflow(block: Column) -> Column:
    """A block's paragraphs: over 190 words it is cut where a transition opens a sentence, or where it grows too long."""
    sized = F.transform(block_sentences(block), lambda x: F.struct(x.alias("s"), T.n_words(x).cast("int").alias("n")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        soft = (a["n"] >= REFLOW["soft"]) & x["s"].rlike(TRANSITION)
        hard = (a["n"] >= REFLOW["hard"]) & (a["n"] + x["n"] > REFLOW["most"])
        cut = F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), x["s"].alias("open"), x["n"].alias("n"))
        on = F.struct(a["done"].alias("done"), F.concat(a["open"], F.when(a["open"] == "", "").otherwise(" "), x["s"]).alias("open"), (a["n"] + x["n"]).alias("n"))
        return F.when((a["open"] != "") & (soft | hard), cut).otherwise(on)

    def close(a: Column) -> Column:
        k = F.size(a["done"])
        joined = F.concat(F.slice(a["done"], F.lit(1), F.greatest(k - 1, F.lit(0))), F.array(F.concat(F.get(a["done"], k - 1), F.lit(" "), a["open"])))
        return F.when((k > 0) & (a["n"] < REFLOW["tail"]), joined).otherwise(F.concat(a["done"], F.array(a["open"])))

    flat = T.strip(F.regexp_replace(block, "(?U)\\s+", " "))
    cut = T.let(sized, lambda v: F.when(F.size(v) > 1, F.aggregate(v, empty, step, close)).otherwise(F.array(flat)))
    return F.when(is_structural(block), F.array(block)).when(T.n_words(flat) <= REFLOW["from"], F.array(flat)).otherwise(cut)


def facts(text: Column, pattern: str) -> Column:
    """The set of a pattern's matches, in small letters and in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)))


def integrity(source: Column, result: Column) -> Column:
    """What an edit broke: nothing left, other numbers, other URLs."""
    number = "[0-9]+(?:[.,][0-9]+)?"
    return F.array_compact(
        F.array(
            F.when(T.strip(result) == "", F.lit("empty")),
            F.when(facts(source, number) != facts(result, number), F.lit("numbers")),
            F.when(facts(source, URL) != facts(result, URL), F.lit("urls")),
        )
    )


def process(docs: DataFrame) -> DataFrame:
    """The whole cleaning stage: doc_id, text, counters, duplicates, paragraphs_created, issues.

    Steps: clean, drop repeated paragraphs, drop repeated sentences, cut long paragraphs, clean again. Where
    numbers or URLs would change, the text after the first step stays and ``issues`` says why. All of it works
    within a row; a null or empty text stays empty without issues.
    """
    first = clean(docs).withColumnsRenamed({"text": "normal"} | {c: f"first_{c}" for c in COUNTERS})
    keep = ["normal", *(f"first_{c}" for c in COUNTERS)]
    row = first.select("doc_id", *keep, _unrepeated(F.col("normal"), "\n{2,}", 24).alias("p"))
    row = row.select("doc_id", *keep, (F.col("p.n") - F.size("p.kept")).alias("gone"), F.transform("p.kept", _thin_sentences).alias("thin"))
    blocks = F.filter(F.transform("thin", lambda x: x["text"]), lambda x: x != "")
    dropped = F.aggregate("thin", F.lit(0), lambda a, x: a + x["dropped"])
    row = row.select("doc_id", *keep, (F.col("gone") + dropped).cast("long").alias("duplicates"), F.transform(blocks, _reflow).alias("flow"))
    created = F.aggregate("flow", F.lit(0), lambda a, x: a + F.size(x) - 1).cast("long")
    row = row.select("doc_id", *keep, "duplicates", created.alias("paragraphs_created"), F.array_join(F.flatten("flow"), "\n\n").alias("text"))
    carry = [*keep, "duplicates", "paragraphs_created"]
    last = clean(row, *carry)
    issues = F.when(F.col("normal") == "", F.array().cast("array<string>")).otherwise(integrity(F.col("normal"), F.col("text")))
    last = last.withColumn("issues", issues)
    text = F.when(F.size("issues") > 0, F.col("normal")).otherwise(F.col("text"))
    return last.select("doc_id", text.alias("text"), *((F.col(c) + F.col(f"first_{c}")).alias(c) for c in COUNTERS), "duplicates", "paragraphs_created", "issues")


def redact(message: Column, most: int = 1200) -> Column:
    """An error message fit to show: URLs without user, query and fragment, credentials hidden, no control marks; at most ``most`` long."""
    url = F.regexp_replace(F.regexp_replace(message, "(?i)(https?://)[^\\s<>\"'/@]*@", "$1"), "(?i)(https?://[^\\s<>\"'?#]+)[?#][^\\s<>\"']*", "$1")
    hidden = F.regexp_replace(url, "(?iu)(?:bearer\\s+|(?:token|api[_-]?key|password|secret)\\s*[:=]\\s*)[^\\s,;]+", "[hidden]")
    return F.left(F.regexp_replace(hidden, "[\\x00-\\x1F\\x7F]", " "), F.lit(most))
