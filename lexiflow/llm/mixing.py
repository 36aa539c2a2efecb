"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source x language x topic). The tokens to take from each cell are
raked: scaled to each marginal in turn until all three hold, where no cell gives more than it
has. If the targets can't be met at the share of all tokens that is aimed at, the largest share
at which they can is found by bisection. Documents are then sampled with a probability that is
the same within a cell.

Scale: one map-side-combined aggregation to cells. Whatever the corpus, cells are bounded
by the target tables (values without a target share one rest class), so they fit the
driver, and the probabilities fit a broadcast of at most that many rows. The draw is a hash of
the document, so it needs no shuffle and is the same after a retry.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import SPACES

REST = "(rest)"

#: Share of tokens per value; what is left to 1 goes to all other values together.
SOURCES = {f"src{i}": 0.05 for i in range(20)}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1}
TOPICS = {"brief": 0.15, "tabular": 0.01, "numeric": 0.02, "prose": 0.82}


def topic(text: Column) -> Column:
    """A coarse topic from the text alone: tabular, numeric, brief or prose. Tables that know better name their own."""
    n = F.greatest(F.length(text), F.lit(1))
    marks = lambda chars: F.regexp_count(text, F.lit(chars))
    return (
        F.when(marks("[|\\t]") * 50 > n, "tabular").when(marks("[0-9]") * 50 > n, "numeric").when(n < 800, "brief").otherwise("prose")
    )


class Mixture(NamedTuple):
    """Tokens to take from each cell, the share of all that they are, and the largest miss of a marginal."""

    take: np.ndarray
    share: float
    miss: float


def _fitted(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray]) -> list[np.ndarray]:
    """The targets over classes that have tokens; what the others were to get is dealt out over these."""
    out = []
    for axis, t in zip(axes, targets, strict=True):
        t = np.where(np.bincount(axis, tokens, len(t)) > 0, t, 0.0)
        out.append(t / t.sum() if t.sum() > 0 else t)
    return out


def _scaled(take: np.ndarray, most: np.ndarray, want: float) -> np.ndarray:
    """``take`` times one factor, no cell above ``most``, so that the sum is ``want`` or as near as it can be."""
    live = take > 0
    if want <= 0 or not live.any():
        return np.zeros_like(take)
    limit = np.where(live, most / np.where(live, take, 1), np.inf)  # the factor at which a cell is full
    order = np.argsort(limit, kind="stable")
    full = np.concatenate([[0.0], np.cumsum(np.where(live, most, 0)[order])])
    rest = np.concatenate([np.cumsum(take[order][::-1])[::-1], [0.0]])  # of the cells not full yet
    factor = np.divide(want - full, rest, out=np.full(len(full), np.inf), where=rest > 0)
    k = int(np.argmax(factor <= np.append(limit[order], np.inf)))
    return np.minimum(take * factor[k], most) if np.isfinite(factor[k]) else np.where(live, most, 0.0)


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], share: float = 1.0, bounded: bool = False, tolerance: float = 1e-9, rounds: int = 500) -> Mixture:
    """Tokens per cell scaled so that the sums over each axis are ``share`` of all, dealt out by its targets.

    axes[k][i] is the class of cell i on axis k. Classes without tokens can't be filled: their
    target is dealt out over the classes that have some. ``bounded``: no cell gives more than its
    tokens. Stops at ``tolerance`` or ``rounds``; marginals that contradict each other or the bounds
    leave the last fit, with its miss.
    """
    total = share * tokens.sum()
    most = tokens.astype(float) if bounded else np.full(len(tokens), np.inf)
    take, miss, fit = tokens.astype(float) * share, 1.0, _fitted(tokens, axes, targets)
    for _ in range(rounds):
        for axis, t in zip(axes, fit, strict=True):
            for k in range(len(t)):
                here = axis == k
                if here.any():
                    take[here] = _scaled(take[here], most[here], total * t[k]) if bounded else take[here] * (total * t[k] / max(take[here].sum(), 1e-300))
        last, miss = miss, max(float(np.abs(np.bincount(axis, take, len(t)) / max(take.sum(), 1e-300) - t).max(initial=0)) for axis, t in zip(axes, fit, strict=True))
        if miss < tolerance or abs(last - miss) < tolerance * 1e-3:
            break
    return Mixture(take, float(take.sum() / max(tokens.sum(), 1e-300)), miss)


def calibrate(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], share: float, tolerance: float = 1e-3) -> Mixture:
    """The largest mixture of at most ``share`` of all tokens that meets the marginals within ``tolerance``.

    If none does, targets contradict each other; then the best fit at the smallest share tried.
    """
    best = rake(tokens, axes, targets, share, bounded=True, tolerance=tolerance / 10)
    if best.miss <= tolerance or not tokens.sum():
        return best
    low, high, best = 0.0, share, None
    for _ in range(12):
        mid = (low + high) / 2
        got = rake(tokens, axes, targets, mid, bounded=True, tolerance=tolerance / 10)
        if got.miss <= tolerance:
            low, best = mid, got
        else:
            high = mid
    return best or got


OURS = ("cell_source", "cell_lang", "cell_topic", "n_tokens", "target_weight", "probability", "wanted", "reached", "sampled")


def mix(
    docs: DataFrame,
    share: float = 0.5,
    sources: Mapping[str, float] = SOURCES,
    languages: Mapping[str, float] = LANGUAGES,
    topics: Mapping[str, float] = TOPICS,
    topic_of: Callable[[Column], Column] = topic,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with cell_source, cell_lang, cell_topic, n_tokens, target_weight, probability, wanted, reached, sampled.

    At most ``share`` of all tokens is taken, less if the target weights can't be met otherwise.
    ``target_weight`` is the cell's share of the mixture; ``wanted`` and ``reached`` have the marginals of
    the row's source, language and topic: the target, and what the probabilities lead one to expect.
    Values without a target, null ones included, share a rest class per axis; it gets what the
    targets leave of 1. Targets of values that don't occur are dealt out over the others. Null and
    empty texts have no tokens and go by their cell's probability. The draw depends on ``seed``,
    ``doc_id`` and text, so repeated rows are drawn alike. An empty table stays empty. Columns with
    our names are overwritten.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = lambda c, t: F.when(c.isin(*t), c).otherwise(F.lit(REST)) if t else F.lit(REST)
    rows = docs.drop(*OURS).withColumns(
        {
            "cell_source": known(F.col("source"), list(sources)),
            "cell_lang": known(F.col("lang"), list(languages)),
            "cell_topic": known(topic_of(text), list(topics)),
            "n_tokens": F.regexp_count(text, F.lit("[^\\x09-\\x0D ]+")).cast("long"),
        }
    )
    keys = ["cell_source", "cell_lang", "cell_topic"]
    cells = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).collect()  # at most (|sources| + 1) (|languages| + 1) (|topics| + 1) rows
    tables = [dict(t) | {REST: max(0.0, 1 - sum(t.values()))} for t in (sources, languages, topics)]
    index = [{v: i for i, v in enumerate(t)} for t in tables]
    axes = [np.array([index[k][c[key]] for c in cells], int) for k, key in enumerate(keys)]
    n, targets = np.array([c["n"] for c in cells], float), [np.array(list(t.values())) for t in tables]
    got = calibrate(n, axes, targets, share) if len(cells) else Mixture(n, 0.0, 0.0)
    chance = np.where(n > 0, np.minimum(1, got.take / np.maximum(n, 1)), got.share)
    weight = got.take / max(got.take.sum(), 1e-300)
    reached = [np.bincount(axis, weight, len(t)) for axis, t in zip(axes, targets, strict=True)]
    plan = docs.sparkSession.createDataFrame(
        [
            (*(c[k] for k in keys), float(weight[i]), float(chance[i]), [float(t[a[i]]) for a, t in zip(axes, targets, strict=True)], [float(r[a[i]]) for a, r in zip(axes, reached, strict=True)])
            for i, c in enumerate(cells)
        ],
        "cell_source string, cell_lang string, cell_topic string, target_weight double, probability double, wanted array<double>, reached array<double>",
    )
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))), 1, 8), 16, 10)
    return rows.join(F.broadcast(plan), keys, "left").withColumn("sampled", draw.cast("double") / 4294967296.0 < F.col("probability"))
