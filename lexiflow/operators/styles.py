"""Styles that are based on other styles: chains, and the properties that result.

A style set is a table (set columns, ``style_id``, ``based_on``); chains never leave their set. A chain starts at
the style itself and goes on to the style it is based on. It ends where there is none, where the set lacks it, or where a
style would come twice. Chains come by pointer doubling: after step k every style knows its ancestors up to
2^k away, so the number of joins is the logarithm of the longest chain, and cycles need no watching: of two ways to
an ancestor the shorter one stays.

Scale: a step is one join by ancestor and one aggregation, both by key; the result has a row for
each style and ancestor. A root that all styles share has no ancestors of its own, so its key meets few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stash

#: A style set's own columns.
STYLE = ("style_id", "based_on", "type", "is_default")


def style_chains(styles: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, style_id, ancestor, distance): every style of each style's chain; itself at distance 0.

    ``styles`` has ``within`` (the set), ``style_id``, ``based_on``. Of rows that repeat a style the one with the least ``based_on`` counts
    (null last). Rows without a style or a set are left out; an empty table gives no rows.
    """
    on = [*within, "style_id"]
    own = styles.where(" and ".join(f"{c} is not null" for c in on)).groupBy(*on).agg(F.min("based_on").alias("based_on"))
    own = stash(own)
    known = own.select(*within, F.col("style_id").alias("based_on"))
    first = own.join(known, [*within, "based_on"], "left_semi").where("based_on != style_id")
    self_ = own.select(*on, F.col("style_id").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    chains = stash(self_.unionByName(first.select(*on, F.col("based_on").alias("ancestor"), F.lit(1).cast("long").alias("distance"))))
    reach, count = 1, chains.count()
    while True:
        # from the ancestors that are as far as is known, their own chains lead on
        far = chains.where(F.col("distance") == reach).select(*on, F.col("ancestor").alias("via"))
        near = chains.where("distance > 0").select(*within, F.col("style_id").alias("via"), "ancestor", "distance")
        further = far.join(near, [*within, "via"]).select(*on, "ancestor", (F.col("distance") + reach).alias("distance"))
        chains = stash(chains.unionByName(further).groupBy(*on, "ancestor").agg(F.min("distance").alias("distance")))
        reach, before, count = 2 * reach, count, chains.count()
        if count == before:
            return chains


def style_cycles(styles: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, style_id, length): the styles that are based on themselves over others, and how many stand in their cycle."""
    on = [*within, "style_id"]
    own = styles.where(" and ".join(f"{c} is not null" for c in on)).groupBy(*on).agg(F.min("based_on").alias("based_on"))
    chains = style_chains(styles, within)
    # a style stands in a cycle if some style of its chain is based on it; that one closes the cycle
    closing = own.select(*within, F.col("style_id").alias("ancestor"), F.col("based_on").alias("back"))
    found = chains.join(closing, [*within, "ancestor"]).where("back = style_id")
    return found.groupBy(*on).agg((F.min("distance") + 1).alias("length"))


def inherited(chains: DataFrame, properties: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, style_id, name, value, origin): what each style's properties come to.

    ``properties`` (*within, style_id, name, value) has what styles say themselves. The nearest style of the chain that says
    something of a property decides; a null or empty value says nothing. Of repeated rows the least value counts.
    """
    said = properties.where("value is not null and value != ''").groupBy(*within, F.col("style_id").alias("ancestor"), "name").agg(F.min("value").alias("value"))
    near = chains.join(said, [*within, "ancestor"]).groupBy(*within, "style_id", "name").agg(F.min(F.struct("distance", "value", "ancestor")).alias("near"))
    return near.select(*within, "style_id", "name", F.col("near.value").alias("value"), F.col("near.ancestor").alias("origin"))


def applied(elements: DataFrame, styles: DataFrame, properties: DataFrame, defaults: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, element, name, value, origin): the properties of elements that name a style or none.

    ``elements``: *within, element, type, style_id, direct (map of properties that the element says itself). Without a style
    that its set has, an element takes the default style of its type (``styles`` with ``type``, ``is_default``; of several the least id).
    Direct properties come first, then the chain, then the set's ``defaults`` (*within, type, name, value). ``origin`` is ``direct``, a
    style, or ``defaults``.
    """
    on = list(within)
    first = styles.where("is_default").groupBy(*on, "type").agg(F.min("style_id").alias("default_id"))
    asked = elements.withColumn("_style", F.col("style_id")).join(first, [*on, "type"], "left")
    asked = asked.withColumn("style_id", F.coalesce(F.nullif("_style", F.lit("").cast(elements.schema["style_id"].dataType)), F.col("default_id")))
    levels = [
        elements.select(*on, "element", F.lit(0).alias("level"), F.explode("direct").alias("name", "value"), F.lit("direct").alias("origin")),
        asked.join(inherited(style_chains(styles, within), properties, within), [*on, "style_id"]).select(*on, "element", F.lit(1).alias("level"), "name", "value", F.col("origin").cast("string").alias("origin")),
        elements.join(defaults, [*on, "type"]).select(*on, "element", F.lit(2).alias("level"), "name", "value", F.lit("defaults").alias("origin")),
    ]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2]).where("value is not null and value != ''")
    best = every.groupBy(*on, "element", "name").agg(F.min(F.struct("level", "value", "origin")).alias("best"))
    return best.select(*on, "element", "name", F.col("best.value").alias("value"), F.col("best.origin").alias("origin"))
