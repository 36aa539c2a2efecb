"""Stores that streams keep: a bounded list of entries for each key, merged batch by batch.

A store is a folder of Parquet in the shared storage. Keys lie in ``buckets`` by hash. A batch reads the buckets it
touches as they were before it, applies its events in order to each key's entries, and writes them as its own version; then it
is committed. So a batch that runs again, or ran in half before, reads the same and writes the same: a replay changes nothing.
Readers take of each bucket the newest version that is committed.

What an event does is a step: a column expression over the entries so far and the event. ``revision_step`` keeps the versions of
a text, ``part_step`` the parts of a work.

Scale: a batch costs its events and the touched buckets, not the store. Entries of a key are bounded by the step; the
events of one key in one batch are one row's array, bounded by the trigger's batch size. The only list on the driver is of bucket numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexiflow.functions import text as T
from lexiflow.operators.projects import clean_part

# Versions kept of a text, letters of a label and of a version.
LIMIT, LABEL, LETTERS = 20, 60, 300_000

Step = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Store:
    """Where entries of type ``entry`` (DDL) are kept by ``key`` of type ``kind``, and what events do to them."""

    path: str
    entry: str
    step: Step
    key: str = "key"
    kind: str = "string"
    buckets: int = 64

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(f"{self.key} {self.kind}, entries array<struct<{self.entry}>>, bucket int, version long")


def _versions(spark: SparkSession, store: Store, below: int | None) -> DataFrame:
    """All committed rows of a store, of versions under ``below``."""
    rows = spark.read.schema(store.schema).option("pathGlobFilter", "*.parquet").option("basePath", f"{store.path}/rows").parquet(f"{store.path}/rows")
    done = spark.read.schema("committed long").parquet(f"{store.path}/commits").distinct()
    rows = rows.join(done, F.col("version") == F.col("committed"), "left_semi")
    return rows if below is None else rows.where(F.col("version") < below)


def _exists(spark: SparkSession, store: Store) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store.path}/commits/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, store: Store, below: int | None = None) -> DataFrame:
    """(key, entries, bucket): a store as its last committed version has it, or the last one under ``below``."""
    if not _exists(spark, store):
        return spark.createDataFrame([], store.schema).drop("version")
    rows = _versions(spark, store, below)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # reads folder names only
    return rows.join(newest, ["bucket", "version"]).select(store.key, "entries", "bucket")


def merge(store: Store, events: DataFrame, version: int) -> None:
    """Apply ``events`` (key, seq, and what the step reads) as batch ``version``; to do it again changes nothing.

    Events go by ``seq``; those of one ``seq`` in the order of their other columns. Events without a key or ``seq`` are left out. A batch whose
    events touch nothing is committed all the same. Versions must rise.
    """
    spark = events.sparkSession
    own = events.where(F.col(store.key).isNotNull() & F.col("seq").isNotNull())
    bucket = F.pmod(F.xxhash64(store.key), F.lit(store.buckets)).cast("int")
    fields = [c for c in own.columns if c not in (store.key, "seq")]
    batch = own.groupBy(store.key).agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("_events")).withColumn("bucket", bucket)
    touched = [r[0] for r in own.select(bucket.alias("b")).distinct().collect()]
    before = read(spark, store, version).where(F.col("bucket").isin(touched))
    none = F.array().cast(f"array<struct<{store.entry}>>")
    both = before.join(batch, [store.key, "bucket"], "full_outer")
    entries = F.aggregate(F.coalesce("_events", F.array().cast(batch.schema["_events"].dataType)), F.coalesce("entries", none), lambda so_far, e: store.step(so_far, e))
    if touched:
        rows = both.select(store.key, entries.alias("entries"), "bucket")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store.path}/rows/version={version}")
    spark.range(1).select(F.lit(version).cast("long").alias("committed")).write.mode("append").parquet(f"{store.path}/commits")


def keep_stream(events: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """Merge a stream of events into a store, a version for each micro-batch."""
    writer = events.writeStream.foreachBatch(lambda batch, number: merge(store, batch, number)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def entries(spark: SparkSession, store: Store) -> DataFrame:
    """(key, place, *entry): a store as rows; ``place`` counts from 1."""
    rows = read(spark, store).select(store.key, F.posexplode("entries").alias("place", "_e"))
    return rows.select(store.key, (F.col("place") + 1).alias("place"), "_e.*")


def compacted(spark: SparkSession, store: Store, path: str) -> Store:
    """A new store at ``path`` with the newest version alone."""
    rows = read(spark, store)
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows/version=0")
    spark.range(1).select(F.lit(0).cast("long").alias("committed")).write.parquet(f"{path}/commits")
    return Store(path, store.entry, store.step, store.key, store.kind, store.buckets)


REVISION = "id: string, at: bigint, label: string, words: bigint, score: double, off_zone: double, text: string, truncated: boolean"


def revision_step(so_far: Column, e: Column, limit: int = LIMIT) -> Column:
    """Versions of a text, newest first: ``save`` puts one in front, ``remove`` takes that of an id away, ``clear`` all.

    A saved text that is there already moves to the front; a blank one changes nothing. Beyond ``limit`` the oldest go for good.
    Texts are cut at ``LETTERS``, which ``truncated`` tells. Events: seq (the time), op, id, label, words, score, off_zone, text.
    """
    text = F.coalesce(e["text"], F.lit(""))
    cut = F.substring(text, 1, LETTERS)
    record = F.struct(
        F.concat(F.lit("rev-"), e["seq"].cast("string"), F.lit("-"), F.length(text).cast("string")).alias("id"),
        e["seq"].cast("long").alias("at"),
        F.substring(F.coalesce(F.nullif(e["label"], F.lit("")), F.lit("version")), 1, LABEL).alias("label"),
        F.coalesce(e["words"], F.lit(0)).cast("long").alias("words"),
        e["score"].cast("double").alias("score"),
        e["off_zone"].cast("double").alias("off_zone"),
        cut.alias("text"),
        (F.length(text) > LETTERS).alias("truncated"),
    )
    saved = F.slice(F.concat(F.array(record), F.filter(so_far, lambda x: x["text"] != cut)), 1, limit)
    removed = F.filter(so_far, lambda x: ~x["id"].eqNullSafe(e["id"]))
    return F.when((e["op"] == "save") & (T.strip(text) != ""), saved).when(e["op"] == "remove", removed).when(e["op"] == "clear", F.slice(so_far, 1, 0)).otherwise(so_far)


EVENT = "op string, id string, label string, words long, score double, off_zone double, text string"

PART = "part_id: string, section_id: string, title: string, source_name: string, text: string, at: bigint"


def part_step(sections: tuple[str, ...]) -> Step:
    """Parts of a work in order: ``add``, ``remove``, ``move`` (to ``section_id``), and ``profile`` (``sections_now``: what is allowed from now on).

    An added part without text changes nothing; an unknown section becomes ``unassigned``, and so do parts whose section a new
    profile hasn't. A move to an unknown section, or of a part that isn't there, changes nothing. Adding a part again by its id replaces it in place.
    """

    def step(so_far: Column, e: Column) -> Column:
        known = F.array_contains(F.array(*map(F.lit, (*sections, "unassigned"))), e["section_id"])
        section = F.when(known, e["section_id"]).otherwise(F.lit("unassigned"))
        text = clean_part(e["text"])
        part = F.struct(e["part_id"].alias("part_id"), section.alias("section_id"), clean_part(e["title"]).alias("title"), clean_part(e["source_name"]).alias("source_name"), text.alias("text"), e["seq"].cast("long").alias("at"))
        there = F.exists(so_far, lambda x: x["part_id"] == e["part_id"])
        added = F.when(there, F.transform(so_far, lambda x: F.when(x["part_id"] == e["part_id"], part).otherwise(x))).otherwise(F.concat(so_far, F.array(part)))
        moved = F.transform(so_far, lambda x: F.when(x["part_id"] == e["part_id"], x.withField("section_id", e["section_id"])).otherwise(x))
        turned = F.transform(so_far, lambda x: F.when(F.array_contains(e["sections_now"], x["section_id"]), x).otherwise(x.withField("section_id", F.lit("unassigned"))))
        out = F.when((e["op"] == "add") & e["part_id"].isNotNull() & (text != ""), added).when(e["op"] == "remove", F.filter(so_far, lambda x: ~x["part_id"].eqNullSafe(e["part_id"])))
        return out.when((e["op"] == "move") & known, moved).when((e["op"] == "profile") & e["sections_now"].isNotNull(), turned).otherwise(so_far)

    return step


PART_EVENT = "op string, part_id string, section_id string, title string, source_name string, text string, sections_now array<string>"

