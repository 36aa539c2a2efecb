"""Structure over blocks: segments, numbering, references, summaries, and text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(blocks: DataFrame, boundary: Column, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """``blocks`` with ``segment``: how many boundaries stand up to each, in order."""
    return blocks.withColumn("segment", F.sum(F.when(boundary, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order)))


def number_captions(blocks: DataFrame, key: str = "doc_id", kind: str = "kind", order: str = "pos", number: str = "number") -> DataFrame:
    """``blocks`` with every ``number`` filled in per document and kind.

    Numbers that are there stay, as texts refer to them; the others take the free ones in order. Numbers are
    strings; one that is no plain integer, like 2.1, stays and takes no integer away.
    """
    per = Window.partitionBy(key, kind)
    bare = F.coalesce(F.col(number).cast("string"), F.lit("")) == ""
    used = F.collect_set(F.when(F.col(number).cast("string").rlike("^[0-9]{1,9}$"), F.col(number).cast("int"))).over(per)
    nth = F.sum(F.when(bare, 1).otherwise(0)).over(per.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    free = F.array_except(F.sequence(F.lit(1), F.col("_nth") + F.size("_used") + 1), F.col("_used"))
    filled = F.when(bare, F.element_at(free, F.greatest(F.col("_nth"), F.lit(1))).cast("string")).otherwise(F.col(number).cast("string"))
    return blocks.withColumns({"_used": used, "_nth": nth}).withColumn(number, filled).drop("_used", "_nth")


def missing(required: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Required parts without a counterpart."""
    return required.join(found.select(*on), on, "left_anti")


def reference_gaps(docs: DataFrame, declared: str, mentioned: str) -> DataFrame:
    """``docs`` with ``unmentioned`` and ``undeclared``: two arrays' differences both ways."""
    return docs.withColumns({"unmentioned": F.array_except(declared, mentioned), "undeclared": F.array_except(mentioned, declared)})


def block_counts(blocks: DataFrame, kinds: list[str], key: str = "doc_id") -> DataFrame:
    """(key, n_<kind>...): how many blocks of each kind a document has; null types count as none of them, a null key is a group."""
    return blocks.groupBy(key).agg(*(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds))


def table_rows(lines: Column) -> Column:
    """Tab-separated lines as rows of trimmed cells, short rows padded to the widest."""
    rows = F.transform(lines, lambda x: F.transform(F.split(x, "\t"), lambda c: F.trim(c)))
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))


def file_name(title: Column, most: int = 70) -> Column:
    """A title as a file's base name."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(title, "[\\\\/:*?\"<>|\\x00-\\x1F]+", " "), " {2,}", " "))
    return F.coalesce(F.nullif(F.left(clean, F.lit(most)), F.lit("")), F.lit("document"))


def write_text(docs: DataFrame, path: str) -> None:
    """One text file per partition of ``docs`` (text), each text led by a byte-order mark."""
    docs.select(F.concat(F.lit("﻿"), F.coalesce("text", F.lit(""))).alias("value")).write.text(path)
