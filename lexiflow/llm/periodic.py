"""Runs of repeated words: maximal periodic stretches, found by divide and conquer.

A run is a stretch of words with smallest period q (words q apart are identical) that is at least
``times`` periods and ``least`` words long and that neither neighbouring word extends. The words of a
batch of texts are interned as integers; a number of its own stands between two texts, so no run
crosses them. Blocks of doubling size are halved at their midpoints. A run belongs to the smallest
block that holds it whole and crosses its midpoint there; as it has four periods, two of them lie on
one side, so that half starts (seen from the midpoint) with a square. The Z-function of the half tells:
z[q] >= q. Squares of multiples of a period are passed over, so few periods a midpoint are
left; each is extended to both sides within the block. What ends at the block's edge
but goes on beyond belongs to a larger block and is left to it. Both sides may find the same interval, so
intervals are made distinct and keep their smallest period.

All blocks of a size are looked at together: the first two words of each possible square and a few
probes in it are compared as arrays, which leaves almost nothing of plain prose. What is left is
matched word for word; a midpoint where that would take more than a few lengths of its half gets its
Z-function in one linear pass. So the work is n log n, whatever the text.

Scale: one narrow pass, no shuffle. A batch holds about 1 MB of texts; a longer text is a
batch of its own, of which only integers are held, 4 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import let, words
from lexiflow.llm.repeats import batches_of, segments_of


@dataclass(frozen=True)
class Runs:
    """A run has ``least`` words and ``times`` periods or more; ``times`` is 4 at least, so that one half holds two."""

    least: int = 6
    times: int = 4

    def __post_init__(self) -> None:
        if self.times < 4 or self.least < 5:
            raise ValueError("runs of fewer than four periods or five words need not start a half with a square")


def z_function(x: np.ndarray) -> list[int]:
    """z[i]: how many values from i on equal those from the start on. Linear."""
    s = x.tolist()
    n = len(s)
    z = [n] + [0] * (n - 1)
    lo = hi = 0
    for i in range(1, n):
        k = min(z[i - lo], hi - i) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the start on are equal, in steps that double."""
    n, k, step = min(len(a), len(b)), 0, 16
    while k < n:
        differ = a[k : min(k + step, n)] != b[k : min(k + step, n)]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k += len(differ)
        step *= 2
    return n


def _possible(half: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, period) of halves that may start with a square, by two words and a few probes."""
    same = half[:, :1] == half[:, 1 : most + 1]
    same &= half[:, 1:2] == half[:, 2 : most + 2]
    row, period = np.nonzero(same)
    period = period + 1
    for part in (1.0, 1 / 2, 1 / 3, 3 / 4, 7 / 8):
        probe = ((period - 1) * part).astype(np.int64)
        alike = half[row, probe] == half[row, period + probe]
        row, period = row[alike], period[alike]
    return row, period


def _squares(half: np.ndarray, periods: list[int]) -> Iterator[tuple[int, int]]:
    """(period, z) of the squares that ``half`` starts with; ``periods`` rise. Multiples of a shorter one are left out."""
    z, work, reach = None, 0, 0
    for q in periods:
        if 2 * q <= reach:
            continue
        if z is None and work > 4 * len(half):
            z = z_function(half)
        same = z[q] if z is not None else matched(half[q:], half)
        work += same + 16
        if same >= q:
            reach = q + same
            yield q, same


def runs_in(w: np.ndarray, longest: int, r: Runs = Runs()) -> np.ndarray:
    """(start, length, period) rows of all runs of ``w``, by start. ``longest``: words of the longest text in it.

    ``w`` holds no negative numbers but those that part texts, each of which stands once.
    """
    n = len(w)
    size = 8
    while size < n + 2:
        size *= 2
    own = np.empty(size, np.int32)
    own[: n + 1] = np.concatenate([[np.iinfo(np.int32).min], w])
    own[n + 1 :] = np.arange(np.iinfo(np.int32).min + 1, np.iinfo(np.int32).min + size - n)  # what fills up stands once, too
    found: dict[tuple[int, int], int] = {}
    half = 4
    while 2 * half <= size:
        blocks = own.reshape(-1, 2 * half)
        most = min(half // 2, max(1, longest // 2))
        for flipped in (False, True):
            turned = blocks[:, ::-1] if flipped else blocks
            row, period = _possible(turned[:, half:], most)
            edges = [*(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
            lo = 0
            for hi in edges if len(row) else []:
                k = int(row[lo])
                block = np.ascontiguousarray(turned[k])
                for q, same in _squares(block[half:], period[lo:hi].tolist()):
                    back = matched(block[:half][::-1], block[q : half + q][::-1])
                    start, length = half - back, back + q + same
                    if length >= max(r.least, r.times * q):
                        start = 2 * half * k + (2 * half - start - length if flipped else start)
                        if own[start - 1] != own[start - 1 + q] and own[start + length] != own[start + length - q]:
                            found[start - 1, length] = min(q, found.get((start - 1, length), q))
                lo = hi
        half *= 2
    out = np.array([(*at, q) for at, q in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def interned(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words as integers with a negative one before each text but the first, place of each text's first word and one past the last's end)."""
    number: dict[bytes, int] = {}
    parts, base, at = [], [0], 0
    for k, text in enumerate(texts):
        if k:
            parts.append(np.array([-k], np.int32))
            at += 1
            base[-1] = at
        for _, raw in segments_of(text, "word", 1):
            own = raw.split()
            parts.append(np.fromiter((number.setdefault(x, len(number)) for x in own), np.int32, len(own)))
            at += len(own)
        base.append(at + 1)
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(base)


def collapsed(text: bytes, gone: np.ndarray | None) -> bytes:
    """The words that are not ``gone``, joined by one space."""
    out, at = [], 0
    for _, raw in segments_of(text, "word", 1):
        own = raw.split()
        kept = own if gone is None else [x for x, g in zip(own, gone[at : at + len(own)].tolist(), strict=True) if not g]
        out += [b" ".join(kept)] if kept else []
        at += len(own)
    return b" ".join(out)


def periodic_runs(docs: DataFrame, r: Runs = Runs()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    ``runs``: array of (start, length, period) by start, then period; words count from 0. ``collapsed``: the
    words that are in no run after the run's first period, joined by one space; so each run is left with
    one period unless another run takes it. A null or empty text, or one without words, has no
    words, no runs and an empty ``collapsed``. Null and repeated ids and repeated rows are taken as they
    come, each row by itself; an empty table gives no rows; other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for own, _, texts in batches_of(batch.column(1).cast(pa.binary()).to_pylist()):
                w, base = interned(texts)
                n = np.diff(base) - 1
                found = runs_in(w, int(n.max(initial=0)), r)
                text = np.searchsorted(base, found[:, 0], side="right") - 1
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                runs, kept = [], []
                for k, raw in enumerate(texts):
                    mine = found[cut[k] : cut[k + 1]] - [base[k], 0, 0]
                    gone = np.zeros(int(n[k]), bool) if len(mine) else None
                    for start, length, q in mine.tolist():
                        gone[start + q : start + length] = True
                    runs.append([{"start": s, "length": x, "period": q} for s, x, q in mine.tolist()])
                    kept.append(collapsed(raw, gone))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(own, pa.int64())), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(doc_id: Column | str, text: Column | str) -> Column:
    """``text``, of which one in ten by the checksum of its id goes on in a loop from some word on; a test input by a rule.

    A null id or text is left as it is.
    """
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def loop(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        at = g % n
        period = F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i < at, i).otherwise(at + (i - at) % period)
        own = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, place(i).cast("int"))), " ")
        return F.when(n > 0, own).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), loop)).otherwise(text)


def run_columns(found: DataFrame) -> DataFrame:
    """The longest run of each row and checksums of its runs and of what is left of its text."""
    line = F.concat(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), F.array(F.lit("")))
    # nulls come first in a least struct, so rows without runs give null
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("_first", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_first.start").alias("start"),
        (-F.col("_first.length")).alias("length"),
        F.col("_first.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("_first.length") / F.col("_first.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.array_join(line, "\n")).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
