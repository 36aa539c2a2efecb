"""Exact deduplication by deterministic block naming (DataFrame functions only).

Texts are cut into blocks of fixed size. All distinct blocks are sorted and numbered; the
number is the block's name. Sorting goes by the block's hash bucket first and by its bytes
within the bucket, so no range of blocks has to be sampled. Adjacent pairs of names are sorted
and numbered in turn, level by level, until one name is left for each text. Equal names mean
equal bytes by construction: no hash decides, so nothing can collide.

A text whose (length, hash) occurs once cannot have a twin, so only the others are cut into
blocks; that prefilter can let a false candidate through but can't hide a true one.

Scale: text moves twice (prefilter, naming), in groups that adaptive execution can split;
names of hot blocks are pre-aggregated where they are read. Each level halves the rows, and
there are log2(longest text / block) of them. The driver sees one yes or no per level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import numbered
from lexiflow.session import stash

BLOCK_BYTES = 512


def _named(values: DataFrame, *cols: str) -> DataFrame:
    """Distinct ``values`` with an integer name each, sorted within the buckets that ``distinct`` deals them to, written down."""
    return stash(values.select(*cols).distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id()))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, level, name) for each of ``docs`` (rid, doc_id, text): equal pairs, equal texts."""
    raw = F.col("text").cast("binary")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length(raw) / block_bytes)).cast("int")
    blocks = stash(
        docs.select("rid", "doc_id", raw.alias("raw"), n_blocks.alias("n"))
        .select("rid", "doc_id", "n", "raw", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
        .select("rid", "doc_id", "n", "pos", F.substring(F.col("raw"), F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("block"))
    )
    parts = stash(blocks.join(_named(blocks, "block"), "block").select("rid", "doc_id", "n", "pos", "name"))
    done, level = [], 0
    while True:
        done.append(parts.where("n = 1").select("rid", "doc_id", F.lit(level).alias("level"), "name"))
        rest = parts.where("n > 1")
        if rest.isEmpty():
            break
        odd = F.col("pos") % 2 == 1
        pairs = stash(
            rest.groupBy("rid", "doc_id", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.max(F.when(~odd, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        parts = stash(
            pairs.join(_named(pairs, "a", "b"), ["a", "b"]).select("rid", "doc_id", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")
        )
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical texts, nothing normalised. Of equal texts the row with the largest
    ``doc_id`` stays; among repeated rows with that id, the last one read. A null text counts as
    empty (and equals other empty texts); a null ``doc_id`` ranks below all others. An empty
    table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
    """
    rows = numbered(docs)
    keys = rows.select("rid", "doc_id", F.sha2("text", 256).alias("text_sha256"))
    marked = rows.withColumn("size", F.octet_length("text")).withColumn("mark", F.xxhash64("text"))
    # twins and groups are written down, so that the joins deal rows anew and can split a hot key
    twins = stash(marked.groupBy("size", "mark").agg(F.count("*").alias("n_same")).where("n_same > 1").select("size", "mark"))
    named = identities(marked.join(twins, ["size", "mark"], "left_semi").select("rid", "doc_id", "text"), block_bytes)
    last = F.max(F.struct("doc_id", "rid"))
    groups = stash(named.groupBy("level", "name").agg(last.alias("last"), F.count("*").alias("group_size")))
    found = named.join(groups, ["level", "name"]).select(
        "rid", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.rid") == F.col("rid")).alias("kept")
    )
    return keys.join(found.withColumn("found", F.lit(True)), "rid", "left").select(
        "rid",
        "doc_id",
        F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        "text_sha256",
    )
