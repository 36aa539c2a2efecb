"""One document from the forms that a clipboard brings: rich blocks, plain blocks, and photos.

All forms are tables of many pastes, so the merge is joins and counts by paste. A paste's photos are few: more than ``MOST_PHOTOS`` are refused before they are
looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: photos of a paste at most.
MOST_PHOTOS = 50


def _judged(pastes: DataFrame, rich: DataFrame, plain: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the chosen blocks, whole photos, what is known of each paste)."""
    known = pastes.groupBy("paste_id").agg(F.max(F.coalesce("has_html", F.lit(False))).alias("has_html"))
    blocks = rich.join(known.where("has_html"), "paste_id", "left_semi").unionByName(plain.join(known.where("not has_html"), "paste_id", "left_semi"))
    shots = photos.where("data_url is not null").join(known, "paste_id", "left_semi").select("paste_id", "nth", "data_url", F.coalesce("alt", F.lit("")).alias("alt"))
    counts = blocks.groupBy("paste_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "imageMissing").alias("n_missing"), F.max(F.when(F.col("type") == "imageMissing", F.col("pos"))).alias("slot"))
    shown = blocks.where("type = 'image'").select("paste_id", "data_url").distinct().withColumn("shown", F.lit(1))
    given = shots.join(shown, ["paste_id", "data_url"], "left").groupBy("paste_id").agg(F.count("*").alias("n_photos"), F.count_if(F.col("shown").isNull()).alias("n_unplaced"))
    none = {c: 0 for c in ("n_blocks", "n_missing", "n_photos", "n_unplaced")}
    facts = known.join(counts, "paste_id", "left").join(given, "paste_id", "left").fillna(none)
    fills = (F.col("n_missing") == 1) & (F.col("n_photos") == 1)
    problem = (
        F.when(F.col("n_photos") > MOST_PHOTOS, "too many photos")
        .when((F.col("n_blocks") == 0) & (F.col("n_photos") == 0), "nothing to read")
        .when(~fills & (F.col("n_blocks") > 0) & (F.col("n_unplaced") > 0), "photos without a place")
    )
    return blocks, shots, facts.withColumns({"fills": fills, "problem": problem})


def merged_pastes(pastes: DataFrame, rich: DataFrame, plain: DataFrame, photos: DataFrame) -> DataFrame:
    """(paste_id, pos, type, text, data_url, alt): the blocks of each paste that can be read.

    ``pastes``: paste_id, has_html. A paste with HTML is read from ``rich``, others from ``plain`` (both: paste_id, pos, type, text, data_url, alt). The only photo of a paste goes
    to the only place where a picture is missing; photos alone are blocks; other photos must be among the pictures already, else the paste is refused
    (see ``paste_problems``). ``photos``: paste_id, nth, data_url, alt; those without data are left out, as are rows of pastes that aren't in ``pastes``.
    """
    blocks, shots, facts = _judged(pastes, rich, plain, photos)
    good = facts.where("problem is null")
    one = shots.join(good.where("fills").select("paste_id", "slot"), "paste_id").select("paste_id", F.col("slot").alias("pos"), F.col("data_url").alias("_url"), F.col("alt").alias("_alt"))
    own = blocks.join(good.select("paste_id"), "paste_id").join(one, ["paste_id", "pos"], "left")
    filled = F.col("_url").isNotNull()
    own = own.select(
        "paste_id", F.col("pos").cast("long").alias("pos"), F.when(filled, "image").otherwise(F.col("type")).alias("type"), "text", F.coalesce("_url", "data_url").alias("data_url"), F.when(filled, F.col("_alt")).otherwise(F.col("alt")).alias("alt")
    )
    alone = shots.join(good.where("n_blocks = 0").select("paste_id"), "paste_id")
    pos = F.row_number().over(Window.partitionBy("paste_id").orderBy("nth")).cast("long")
    return own.unionByName(alone.select("paste_id", pos.alias("pos"), F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), "data_url", "alt"))


def paste_problems(pastes: DataFrame, rich: DataFrame, plain: DataFrame, photos: DataFrame) -> DataFrame:
    """(paste_id, problem): the pastes that are refused, and why."""
    return _judged(pastes, rich, plain, photos)[2].where("problem is not null").select("paste_id", "problem")
