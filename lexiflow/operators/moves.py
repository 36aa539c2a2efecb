"""Manual layout: objects moved past their neighbours and captions changed by hand, as a log of operations on a document's units.

A unit is what stands together: an object with its caption and note, or any other block. The order of a document is the list of its
units, and an operation is a step over that list, so a log gives the same order however it is cut into batches (see
``streaming.stores``, which keeps such lists and applies batches once).

Scale: a document's list has its units' numbers and kinds, no texts; documents are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A unit in a document's list; ``title``: a caption given by hand, else null.
UNIT = "unit: bigint, kind: string, title: string"
#: What a log holds, besides the document and ``seq``.
OPERATION = "op string, unit long, direction int, title string, units array<struct<unit: long, kind: string, title: string>>"
MEDIA = ("table", "docTable", "image")


def with_units(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``blocks`` (key, pos, type, kind, ...) with ``unit``, the position of the block that leads its unit.

    A caption of a table directly before one, a caption of a figure directly after an image, and a note directly after an object or its caption go with
    the object. A caption between two objects that could take it goes with the one its place is fixed for: tables have theirs above, figures below.
    """
    w = Window.partitionBy(key).orderBy("pos")
    table, image = F.col("type").isin("table", "docTable"), F.col("type") == "image"
    caption = lambda kind: (F.col("type") == "caption") & (F.col("kind") == kind)
    after, before = lambda c: F.coalesce(F.lead(c).over(w), F.lit(False)), lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    joins = caption("figure") & before(image)
    own = blocks.withColumns({"_above": caption("table") & after(table), "_below": joins, "_note": (F.col("type") == "sourceNote")})
    led = F.coalesce(F.lag("_above").over(w), F.lit(False)) & table
    noted = F.col("_note") & (before(table) | before(image) | F.coalesce(F.lag("_below").over(w), F.lit(False)))
    starts = ~(led | F.coalesce(F.col("_below"), F.lit(False)) | F.coalesce(noted, F.lit(False)))
    first = F.last(F.when(F.coalesce(starts, F.lit(True)), F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return own.withColumn("unit", first.cast("long")).drop("_above", "_below", "_note")


def unit_lists(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, units): each document's units in order, with the kind of object they hold, ``heading``, or null."""
    kinds = F.max(F.when(F.col("type").isin(*MEDIA), F.when(F.col("type") == "image", "figure").otherwise("table")))
    lead = F.max(F.when((F.col("pos") == F.col("unit")) & (F.col("type") == "heading"), "heading"))
    units = with_units(blocks, key).groupBy(key, "unit").agg(F.coalesce(kinds, lead).alias("kind"))
    entry = F.struct("unit", "kind", F.lit(None).cast("string").alias("title"))
    return units.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("units"))


def layout_step(so_far: Column, e: Column) -> Column:
    """One operation on a document's units: ``set`` (all of them anew), ``move`` (an object's unit by ``direction``, -1 or 1), ``caption`` (its ``title``).

    A move changes places with the neighbour. It changes nothing for a unit that isn't there or holds no object, at the document's end, past
    a heading, or for any other direction. An empty title is one; null takes a given title back.
    """
    at = F.array_position(F.transform(so_far, lambda u: u["unit"]), e["unit"]).cast("int")
    to = at + e["direction"]
    own, other = F.try_element_at(so_far, F.when(at > 0, at)), F.try_element_at(so_far, F.when(to > 0, to))
    media = F.coalesce(own["kind"].isin("table", "figure"), F.lit(False))
    may = media & e["direction"].isin(-1, 1) & other.isNotNull() & ~other["kind"].eqNullSafe("heading")
    swapped = F.transform(so_far, lambda u, i: F.when(i == at - 1, other).when(i == to - 1, own).otherwise(u))
    titled = F.transform(so_far, lambda u: F.when((u["unit"] == e["unit"]) & u["kind"].isin("table", "figure"), u.withField("title", e["title"])).otherwise(u))
    return F.when((e["op"] == "set") & e["units"].isNotNull(), e["units"]).when((e["op"] == "move") & may, swapped).when(e["op"] == "caption", titled).otherwise(so_far)


def replayed(lists: DataFrame, log: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, units): ``lists`` (key, units) after a whole ``log`` (key, seq, op, unit, direction, title) by ``seq``. Documents without a log stay as they are."""
    events = log.where("seq is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "unit", "direction", "title"))).alias("_log"))
    both = lists.join(events, key, "left")
    none = F.lit(None).cast("array<struct<unit: long, kind: string, title: string>>")
    done = F.aggregate("_log", F.col("units"), lambda so_far, e: layout_step(so_far, F.struct(e["op"].alias("op"), e["unit"].alias("unit"), e["direction"].alias("direction"), e["title"].alias("title"), none.alias("units"))))
    return both.select(key, F.when(F.col("_log").isNull(), F.col("units")).otherwise(done).alias("units"))


def arranged(blocks: DataFrame, lists: DataFrame, key: str = "doc_id") -> DataFrame:
    """``blocks`` in the order of ``lists`` (key, units): ``pos`` from 1, captions with titles given by hand.

    Objects without a caption whose title was given get a caption block, above a table and below a figure.
    """
    places = lists.select(key, F.posexplode("units").alias("_place", "_u")).select(key, "_place", F.col("_u.unit").alias("unit"), F.col("_u.kind").alias("_kind"), F.col("_u.title").alias("_given"))
    own = with_units(blocks, key).join(places, [key, "unit"])
    unit = Window.partitionBy(key, "unit")
    bare = F.col("_given").isNotNull() & ~F.max(F.col("type") == "caption").over(unit)
    own = own.withColumns({"_bare": F.coalesce(bare, F.lit(False)), "title": F.when(F.col("type") == "caption", F.coalesce("_given", "title")).otherwise(F.col("title"))})
    new = own.where(F.col("_bare") & F.col("type").isin(*MEDIA)).withColumns(
        {"_sub": F.when(F.col("_kind") == "table", -1).otherwise(1), "type": F.lit("caption"), "kind": F.col("_kind"), "title": F.col("_given"), "text": F.lit(None).cast("string"), "number": F.lit(None).cast("string")}
    )
    every = own.withColumn("_sub", F.lit(0)).unionByName(new)
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_place", "pos", "_sub")).cast("long")
    return every.withColumn("pos", pos).select(*blocks.columns)
