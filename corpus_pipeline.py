"""From raw documents to token ids: quality rules, exact and near dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.bpe import bpe_codec
from lexiflow.llm.common import identified
from lexiflow.llm.exact_dedup import exact_dedup
from lexiflow.llm.graph import among
from lexiflow.llm.mixing import mix
from lexiflow.llm.ngram_join import ngram_components
from lexiflow.llm.quality_rules import clean_rows
from lexiflow.llm.queries import vocabulary
from lexiflow.session import scratch, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """``docs`` but the rows with these numbers, which follow file order and go to all tasks as bits, so no text moves."""
    return among(identified(docs), rids.select("rid"), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; of the others the lines that too many texts share go."""
    shorter = ~F.col("clean_text").eqNullSafe(F.col("text"))
    n_chars = F.when(shorter, F.length("clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean_rows(docs).withColumns({"n_chars": n_chars, "text": F.col("clean_text")}).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return _without(docs, exact_dedup(docs).where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (the first such row, null last)."""
    found = stash(ngram_components(docs)).where("n_shingles > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    own = found.groupBy("root").agg(least.alias("least")).select(F.col("least.rid").alias("rid"))
    return _without(docs, found.join(own, "rid", "left_anti"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics."""
    return mix(docs).where("sampled").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the sampled documents."""
    return bpe_codec(docs, vocabulary())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("encode", encode)]

#: Raking and byte-pair merges are iterations that SQL can't express; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder, which goes when the driver ends, and read again."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
