"""Session defaults and the shared scratch folder every multi-stage plan uses."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STASHED: list[tuple[SparkSession, str]] = []


def local_session(name: str = "lexiflow", cores: int = 8, partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


#: A table of up to so many bytes may be dealt out anew for the sake of idle cores; larger ones are read as they lie.
SPREAD_BYTES = 256 << 20
#: How many times its share of the rows the largest split of a larger table may have.
UNEVEN = 1.5


def spread(df: DataFrame, heavy: bool = False) -> DataFrame:
    """``df`` over all cores, where it is a scan of a few small files that would leave most of them idle.

    One row group can't be split, whatever the scan's options. The shuffle is bounded by ``SPREAD_BYTES``, so
    it never happens to a large table. ``heavy``: what follows costs far more than a shuffle of the rows, so a
    larger table is dealt out too if its row groups leave cores idle, which the counts of its splits tell.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_BYTES
    if small or not heavy:
        return df.repartition(cores) if small and 0 < len(df.inputFiles()) < cores else df
    rows = [n for (n,) in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    return df.repartition(max(cores, df.rdd.getNumPartitions())) if rows and UNEVEN * sum(rows) < max(rows) * cores else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where a session that runs in one process leaves it unset (tests, notebooks) is a local folder used;
    on a cluster that is an error, as executors don't see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexiflow-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends."""
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _STASHED:
        atexit.register(_sweep)
    _STASHED.append((spark, path))
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    Row identifiers made by ``monotonically_increasing_id`` and integer names become
    facts on disk, so a lost executor can't change them. Files go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "lexiflow")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    while _STASHED:
        spark, path = _STASHED.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have stopped already
            return
