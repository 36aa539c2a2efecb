"""Streams: texts scored as they arrive, and values held against their key's recent history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiflow.operators.scores import scores

# Samples that a key's history keeps, and how many it needs before it is spoken of.
KEPT, LEAST = 200, 5


def score_stream(docs: DataFrame) -> DataFrame:
    """The scores of a stream of documents (doc_id, text): a narrow step without state."""
    return scores(docs)


def against_history(events: DataFrame, key: str = "key", kept: int = KEPT, least: int = LEAST) -> DataFrame:
    """(key, id, value, median, share) of a stream (key, id, value): where each value stands among the last ``kept`` of its key, itself included.

    Values of a micro-batch are taken by id. Fewer than ``least`` samples give nulls; null values are left
    out. The state of a key is at most ``kept`` numbers, so it doesn't grow with the stream.
    """
    kind = dict(events.dtypes)[key]

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: list[float] = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).dropna(subset=["value"]).sort_values("id", kind="stable")
        rows = []
        for number, value in zip(new["id"], new["value"], strict=True):
            seen = [*seen, float(value)][-kept:]
            if len(seen) < least:
                rows.append((name[0], number, value, None, None))
                continue
            order = sorted(seen)
            middle = (order[(len(order) - 1) // 2] + order[len(order) // 2]) / 2
            below, same = sum(x < value for x in seen), sum(x == value for x in seen)
            rows.append((name[0], number, value, middle, (below + same / 2) / len(seen)))
        state.update((seen,))
        yield pd.DataFrame(rows, columns=[key, "id", "value", "median", "share"]).astype({"median": "float64", "share": "float64"})

    plain = events.selectExpr(key, "cast(id as long) id", "cast(value as double) value")
    return plain.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, id long, value double, median double, share double", "seen array<double>", "append", GroupStateTimeout.NoTimeout
    )
