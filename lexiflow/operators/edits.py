"""Edits and candidates: proposals as spans, greedy resolution, splicing, budgets and selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from lexiflow.functions import lexicon as L
from lexiflow.functions import text as T


def resolve(edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, priority, after): edits kept greedily by start, then size, then priority; none overlaps one kept before.

    A document's own edits are sorted once and the last end is carried along.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("size", pc.subtract(table["start"], table["end"]))
        table = table.sort_by([("start", "ascending"), ("size", "ascending"), ("priority", "ascending")]).drop_columns("size")
        keep, last = [], None
        for start, end in zip(table["start"].to_pylist(), table["end"].to_pylist(), strict=True):
            keep.append(last is None or start >= last)
            last = end if keep[-1] else last
        return table.filter(pa.array(keep, pa.bool_()))

    plain = edits.select(key, *(F.col(c).cast("long") for c in ("start", "end")), F.col("priority").cast("int"), "after")
    return plain.groupBy(key).applyInArrow(run, plain.schema)


def apply_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``edited``: non-overlapping edits spliced into the text (offsets in code points)."""
    order = F.struct("start", "end", "after")
    listed = edits.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("_e"))

    def splice(t: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
        step = lambda a, x: F.struct(F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), x["after"]).alias("out"), x["end"].alias("at"))
        return F.aggregate("_e", start, step, lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))

    text = F.coalesce("text", F.lit(""))
    return docs.join(listed, key, "left").withColumn("edited", F.when(F.col("_e").isNotNull(), splice(text)).otherwise(text)).drop("_e")


def within_budget(rows: DataFrame, share: float, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """``rows`` with ``kept_for_zone``: the first max(1, round(n * share)) of each document's rows."""
    per = Window.partitionBy(key)
    return rows.withColumns({"_k": F.row_number().over(per.orderBy(order)), "_n": F.count("*").over(per)}).withColumn(
        "kept_for_zone", F.col("_k") <= F.greatest(F.lit(1), T.whole(F.col("_n") * F.lit(share)))
    ).drop("_k", "_n")


def select_best(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """The candidate with the lowest score; NaN and null drop out, the source (cand_no 0) wins ties. Candidates may come without ``text``."""
    fine = candidates.where(F.col("score").isNotNull() & ~F.isnan("score"))
    text = [c for c in candidates.columns if c == "text"]
    return fine.groupBy(key).agg(F.min(F.struct("score", "cand_no", *text)).alias("b")).select(key, "b.cand_no", *(f"b.{c}" for c in text), "b.score")


#: Words of the edit passes; unlike ``T.WORD`` without the underscore.
EDIT_WORD = "[\\p{L}\\p{N}-]+"
#: The gap after a sentence; a closing quote or bracket belongs to it.
BOUNDARY = "(?<=[.!?…][\"»”')\\]]?)[\\s\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def content_words(text: Column) -> Column:
    """Distinct five-letter stems of words of four letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(EDIT_WORD), F.lit(0))
    told = F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*sorted(L.STOP_WORDS)))
    return F.array_distinct(F.transform(told, lambda w: F.left(w, F.lit(5))))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets; 0 with an empty one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def repeated_thesis(docs: DataFrame, least: float = 0.6, words: int = 8) -> DataFrame:
    """(doc_id, earlier, later): sentences of ``words`` or more that repeat an earlier one's content words.

    Only sentences of one paragraph are compared; the numbers count a document's sentences. The
    pairs come from shared stems within a paragraph, not from all pairs of its sentences.
    """
    split = lambda p, i: F.transform(F.filter(F.split(p, BOUNDARY), lambda s: s.rlike("(?U)\\S")), lambda s: F.struct(i.alias("para"), s.alias("sentence")))
    told = F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n{2,}"), split))
    s = docs.select("doc_id", F.posexplode(told).alias("pos", "x")).where(T.count(F.col("x.sentence"), EDIT_WORD) >= words)
    s = s.select("doc_id", "pos", "x.para", content_words(F.col("x.sentence")).alias("c"))
    sized = s.select("doc_id", "para", "pos", F.size("c").alias("n"), F.explode("c").alias("w"))
    a, b = sized.alias("a"), sized.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("doc_id", "para", "w")]
    both = a.join(b, [*same, F.col("a.pos") < F.col("b.pos")])
    n = both.groupBy("a.doc_id", F.col("a.pos").alias("earlier"), F.col("b.pos").alias("later")).agg(F.count("*").alias("both"), F.min(F.least("a.n", "b.n")).alias("least"))
    return n.where(F.col("both") >= least * F.col("least")).select("doc_id", "earlier", "later")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at once: a zero bit of ``row`` is a step up at that place of ``b``."""
    at: dict[str, int] = {}
    for i, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << i
    every = row = (1 << len(b)) - 1
    for w in a:
        met = row & at.get(w, 0)
        row = (row + met | row - met) & every
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def lexical_novelty(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """1 - 2 LCS / (n + m) over lower-case words; 0 if either text has none."""
    import regex

    word = regex.compile(T.WORD)
    for left, right in pairs:
        out = []
        for x, y in zip(left.fillna(""), right.fillna(""), strict=True):
            a, b = word.findall(x.lower()), word.findall(y.lower())
            out.append(1 - 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)
        yield pd.Series(out, dtype="float64")


def fnv1a(texts: list[str]) -> np.ndarray:
    """32-bit FNV-1a over UTF-16 code units of each text: one step takes a unit of every text that is long enough."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    size = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-size, kind="stable")
    start = np.concatenate([[0], np.cumsum(size)])[:-1][order]
    flat = np.concatenate(units) if units else np.empty(0, np.uint16)
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")  # texts with more than i units
    h = np.full(len(texts), 2166136261, np.uint64)
    for i, n in enumerate(live.tolist()):
        h[:n] = ((h[:n] ^ flat[start[:n] + i]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(texts), np.int64)
    out[order] = h.astype(np.int64)
    return out


@F.pandas_udf(LongType())
def stable_hash(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a over UTF-16 code units; a null text is empty."""
    return pd.Series(fnv1a([t or "" for t in text]), dtype="int64")


def perplexity(logits: np.ndarray, ids: np.ndarray) -> float:
    """exp of the mean negative log-likelihood of ids 1.. under rows 0.. of ``logits``; NaN without a target."""
    if len(ids) < 2:
        return float("nan")
    rows = logits[: len(ids) - 1].astype(float)
    top = rows.max(axis=1, keepdims=True)
    norm = top[:, 0] + np.log(np.exp(rows - top).sum(axis=1))
    return float(np.exp((norm - rows[np.arange(len(rows)), ids[1:]]).mean()))
