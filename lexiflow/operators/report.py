"""The metric report: per-document metrics, their zones and statuses, and changes between two reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import lexicon as L
from lexiflow.functions import measure as M
from lexiflow.operators import spans
from lexiflow.operators.scores import FACTS, per_text

def metrics_wide(docs: DataFrame) -> DataFrame:
    """doc_id, language, n_words, n_sentences, longest, list_cv, even_list and a column for each metric; null where it can't be measured."""
    return per_text(docs, M.measured, FACTS | {"longest": pa.int64(), "list_cv": pa.float64(), "even_list": pa.bool_()} | dict.fromkeys(M.METRICS, pa.float64()))


def metrics_tall(wide: DataFrame, genre: str = "academic") -> DataFrame:
    """One row per document and metric with its genre's zone and status: unknown, low, high, overshoot or ok."""
    names = list(L.ZONES["en"])
    tall = wide.unpivot(["doc_id", "language", "n_words", "n_sentences"], names, "metric_id", "value")
    zones = zone_table(wide.sparkSession, genre=genre)
    v = F.col("value")
    thin = F.col("metric_id").isin(L.NEEDS_MATERIAL) & ((F.col("n_words") < 120) | (F.col("n_sentences") < 5))
    down = F.col("metric_id").isin(L.DOWNWARD)
    status = (
        F.when(v.isNull() | thin, "unknown")
        .when(down & (v >= F.col("overshoot")), "high")
        .when(~down & (v > F.col("overshoot")), "overshoot")
        .when(v < F.col("low"), "low")
        .when(v > F.col("high"), "high")
        .otherwise("ok")
    )
    return tall.join(F.broadcast(zones), ["language", "metric_id"], "left").select("doc_id", "language", "metric_id", "value", "low", "high", status.alias("status"))


#: Texts that a calibration needs to be trusted.
TRUSTED_FROM = 100


def zone_table(spark: SparkSession, overlay: DataFrame | None = None, genre: str = "academic") -> DataFrame:
    """(language, metric_id, low, high, overshoot): the zones of a genre, with those of ``overlay`` (language, metric_id, low, high, overshoot) in their place.

    Bounds that an overlay leaves null stay; metrics that have no zone yet get none. A null language overlays both.
    """
    tables = L.ZONES if genre == "academic" else dict.fromkeys(L.ZONES, L.GENRE_ZONES[genre])
    zones = spark.createDataFrame([(lang, m, *(None if x is None else float(x) for x in z)) for lang, t in tables.items() for m, z in t.items()], "language string, metric_id string, low double, high double, overshoot double")
    if overlay is None:
        return zones
    names = ("low", "high", "overshoot")
    new = overlay.select(F.coalesce("language", F.lit("*")).alias("_l"), "metric_id", *(F.col(c).alias(f"_{c}") for c in names))
    own, both = new.where("_l <> '*'").withColumnRenamed("_l", "language"), new.where("_l = '*'").drop("_l").withColumnsRenamed({f"_{c}": f"_{c}0" for c in names})
    joined = zones.join(F.broadcast(both), "metric_id", "left").join(F.broadcast(own), ["language", "metric_id"], "left")
    return joined.select("language", "metric_id", *(F.coalesce(f"_{c}", f"_{c}0", c).alias(c) for c in names))


def calibration_status(calibrated: DataFrame) -> DataFrame:
    """``calibrated`` (language, metric_id, texts, ...) with ``applied``, whether there is such a zone, and ``trustworthy``."""
    known = F.array(*(F.lit(f"{lang}:{m}") for lang, t in L.ZONES.items() for m in t))
    applied = F.coalesce(F.array_contains(known, F.concat_ws(":", "language", "metric_id")), F.lit(False))
    return calibrated.withColumns({"applied": applied, "trustworthy": F.col("texts") >= TRUSTED_FROM})


def overshoot_warnings(wide: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """(doc_id, metric_id, value, overshoot): metrics at or past the point where a text begins to pose."""
    tall = wide.unpivot(["doc_id", "language"], list(L.ZONES["en"]), "metric_id", "value")
    zones = zone_table(wide.sparkSession) if zones is None else zones
    found = tall.join(F.broadcast(zones.select("language", "metric_id", "overshoot")), ["language", "metric_id"])
    return found.where(F.col("value") >= F.col("overshoot")).select("doc_id", "metric_id", "value", "overshoot")


def status_counts(tall: DataFrame) -> DataFrame:
    """(doc_id, n_<status>...): how many metrics of a document have each status; a null status counts as none."""
    return tall.groupBy("doc_id").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "low", "high", "overshoot", "unknown")))


def report_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics that changed by 0.0001 or more between two tall reports."""
    key = ["doc_id", "metric_id"]
    both = before.select(*key, F.col("value").alias("before")).join(after.select(*key, F.col("value").alias("after")), key)
    return both.withColumn("delta", F.col("after") - F.col("before")).where(F.abs("delta") >= 1e-4)


def calibration(wide: DataFrame, points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Percentiles of each metric by language over the corpus, interpolated between neighbours.

    Values are counted, ranked in ranges of the sort order, and only totals per range and metric meet; no
    task holds all values of a metric.
    """
    keys = ["language", "metric_id"]
    tall = wide.unpivot(["doc_id", "language"], list(L.ZONES["en"]), "metric_id", "value").where("value is not null")
    ranked = spans.ranked_values(tall.withColumn("n", F.lit(1)), keys)
    holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
    place = lambda p: (F.col("all") - 1) * F.lit(p)
    aggs = {}
    for p in points:
        aggs[f"a{p}"] = F.max(F.when(holds(F.floor(place(p))), F.col("value")))
        aggs[f"b{p}"] = F.max(F.when(holds(F.ceil(place(p))), F.col("value")))
    wanted = ranked.groupBy(*keys).agg(F.max("all").alias("texts"), *(v.alias(k) for k, v in aggs.items()))
    share = lambda p: (F.col("texts") - 1) * F.lit(p) - F.floor((F.col("texts") - 1) * F.lit(p))
    between = lambda p: F.col(f"`a{p}`") + (F.col(f"`b{p}`") - F.col(f"`a{p}`")) * share(p)
    return wanted.select(*keys, "texts", *(between(p).alias(f"p{round(100 * p)}") for p in points))
