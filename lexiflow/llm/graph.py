"""Connected components over an edge table, and joins with lists that go to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stash


#: Tables of up to so many short rows may go to all tasks; longer ones are shuffled.
LISTED = 1_000_000


def listed(rows: DataFrame) -> DataFrame:
    """``rows``, a table that is written down, for a join that sends it to all tasks if it is short."""
    return rows.hint("broadcast") if rows.count() <= LISTED else rows


def among(rows: DataFrame, rids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``rid`` is one of ``rids`` (rid), or those whose isn't (``left_anti``).

    Row numbers lie close together, so they go to all tasks as bits, 64 neighbours a number, and rows stay where
    they are, whatever their texts weigh.
    """
    bits = F.bit_or(F.expr("shiftleft(1L, cast(rid & 63 AS int))")).alias("_bits")
    words = stash(rids.groupBy(F.shiftright("rid", 6).alias("_word")).agg(bits))
    own = F.getbit("_bits", F.col("rid").bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.join(listed(words), (F.shiftright("rid", 6) == F.col("_word")) & own, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node that links reach.

    Large-star and small-star steps in turn: each hangs neighbours on the least one around
    and at least keeps components whole, until all edges point to a root. Each step is two
    aggregations by node and its result is written down, so a lost executor costs one step. ``few``: the
    edges are so few that a step sends the least nodes to all tasks.
    Self-loops keep a node without links; nulls are left out.
    """
    edges = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stash(edges.distinct())
    mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while True:
        few = 2 * mark[0] <= LISTED
        now = stash(_small(_large(now, few), few))
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def _large(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of a node goes to the least of its neighbourhood; some edges may be there twice."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b >= a").join(least.hint("broadcast") if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its smaller neighbours go to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.hint("broadcast") if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).unionByName(least.select(F.col("m").alias("a"), F.col("m").alias("b"))).distinct()
