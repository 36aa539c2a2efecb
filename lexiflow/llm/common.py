"""What the training-data operators share: row identity and text columns."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.session import spread, stash

#: Characters that part words: space and \x09-\x0D, the same set in every engine.
SPACES = "[\\x09-\\x0D ]"


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``rid``, a row number that each read gives alike: by file, then by place in it.

    Over plain Parquet scans it comes from the sorted file list and the row's index within its
    file, so neither the planning of splits nor the cores of the moment have a part in it.
    Anything else is numbered once and written down.
    """
    place = _place(docs)
    if place is None:
        return stash(docs.withColumn("rid", F.monotonically_increasing_id()))
    # Spark spells a local path as file:/ or file:///, and names encoded or plain
    rows = docs.withColumns({"_file": F.regexp_replace(place["file_path"], "^file:/+", "file:/"), "_at": place["row_index"]})
    files = sorted(re.sub("^file:/+", "file:/", f) for f in docs.inputFiles())
    spelt = {unquote(f): k for k, f in enumerate(files)} | {f: k for k, f in enumerate(files)}
    numbers = docs.sparkSession.createDataFrame([(*x,) for x in spelt.items()], "_file string, _number long")
    rid = F.shiftleft("_number", 40) + F.col("_at")
    known = F.when(F.col("_number").isNull(), F.raise_error(F.concat(F.lit("not a file of the input: "), F.col("_file"))).cast("long")).otherwise(rid)
    out = rows.join(F.broadcast(numbers), "_file", "left").select(*docs.columns, known.alias("rid"))
    return spread(out)


def _place(docs: DataFrame) -> Column | None:
    """Where a row stands in its file, if ``docs`` is one Parquet scan with narrow steps only."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation":
        return None
    place = docs.metadataColumn("_metadata")
    try:
        docs.select(place["row_index"], place["file_path"])
    except AnalysisException:
        return None
    return place


def numbered(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(rid, doc_id, text, *keep): a row number beside ids that may be null or repeat.

    ``rid`` follows file order and is the same at each read (see ``identified``). Null texts
    become empty.
    """
    return identified(docs.drop("rid")).select(
        "rid",
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *(F.col(k) for k in keep),
    )


def words(text: Column | str) -> Column:
    """The words of a text, in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; lambdas would repeat a plain reference."""
    return F.element_at(F.transform(F.array(value), body), 1)
