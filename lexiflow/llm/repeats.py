"""Finding every repeated window of a corpus: the frame that two operators share.

A unit is a byte or a word, a window ``length`` consecutive units of one text. Each window
is assigned to a trigger: the unit with the least rolling hash among its first ``reach``
units. That depends on the window's content alone, so equal windows have triggers at the
same offset, and the ``length - reach + 1`` units from the trigger on (the trigger's key)
are equal too. Windows of one trigger in a row form a run; the units they span are a phrase.
Phrases overlap so far that every window lies within one.

1. Count keys. A key that stands once proves its windows unique; they are gone from here.
2. The parse of the rest is a table of phrase names and places, its dictionary the distinct
   phrases with their number and first place. Text is cut out once for each distinct phrase.
3. Shards hold all phrases of their keys and compare real text: ``shard`` is the method of the
   operator and tells for each phrase which windows stand elsewhere too. The verdict goes to
   every place of the phrase through the parse.
4. A key with more than ``hot`` distinct phrases is not one shard's work. Its phrases are
   parsed again into ``fan`` parts by the window's offset from the trigger: a part's key holds
   all units that its windows have in common. Step 3 follows for the parts, and step 4 again for
   keys that are still too large; a part of one window has one phrase, so that ends.

Scale: names, not text, are shuffled (one row a run), pre-aggregated on the map side. Text
moves by row number twice: to cut out distinct phrases and to apply the result. No step
gathers a key's occurrences. Step 4 makes at most ``fan`` rows of a phrase, without text.
Texts over ``SEGMENT`` bytes are taken in overlapping segments, so no array grows with them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stash

#: Random weights of bytes in rolling hashes, and the factor between places (odd: has an inverse).
_RNG = np.random.default_rng(20)
WEIGHTS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 1 << 20
SEGMENT = 1 << 20


@dataclass(frozen=True)
class Windows:
    """What a window is. ``seed``: units that a rolling hash covers; ``shard``: phrases of a shard."""

    unit: str
    length: int
    reach: int
    seed: int
    fan: int = 4
    hot: int = 5000
    shard: int = 500

    def __post_init__(self) -> None:
        if self.reach + self.seed - 1 > self.length:
            raise ValueError("a trigger must lie within each of its windows")


class Batch:
    """Texts as one array of units. ``first``, ``last``: bytes of each unit; ``base``: each text's first unit."""

    def __init__(self, texts: list[bytes], unit: str) -> None:
        if unit == "word":
            texts = [b" ".join(t.split()) for t in texts]
            self.data = b" ".join(texts) + b" "
            raw = np.frombuffer(self.data, np.uint8)
            part = np.flatnonzero(raw == 32)
            n_words = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
            gap = np.zeros(len(raw), bool)
            gap[part] = True
            word = ~gap
            start = word.copy()
            start[1:] &= gap[:-1]
            end = word.copy()
            end[:-1] &= gap[1:]
            self.first, self.last = np.flatnonzero(start), np.flatnonzero(end) + 1
            self.base = np.concatenate([[0], np.cumsum(n_words)])
        else:
            self.data = b"".join(texts)
            self.first = self.last = None
            self.base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    @cached_property
    def hash(self) -> np.ndarray:
        """A hash of each unit; a word's is the same wherever it stands."""
        raw = np.frombuffer(self.data, np.uint8)
        if self.first is None:
            return WEIGHTS[raw]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(WEIGHTS[raw] * _powers(len(raw)), out=sums[1:])
        return (sums[self.last] - sums[self.first]) * _powers(len(raw), inverse=True)[self.first]

    def cut(self, lo: int, hi: int) -> bytes:
        """The bytes of units lo to hi (exclusive)."""
        return self.data[lo:hi] if self.first is None else self.data[self.first[lo] : self.last[hi - 1]]

    def cuts(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[bytes]:
        """The bytes of units lo to hi (exclusive) of many stretches."""
        a, b = (lo, hi) if self.first is None else (self.first[lo], self.last[hi - 1])
        data = self.data
        return (data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))

    def runs(self, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, last window, trigger) of each run, in order; units count from the batch's start."""
        n = len(self.hash)
        if n < w.length:
            return (np.empty(0, np.int64),) * 4
        h, k = self.hash, 1
        while k < w.seed:  # the hash of 2 k units from two of k
            h = h[:-k] * _power(k) + h[k:]
            k *= 2
        h = ((h * FACTOR) ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= w.reach:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if k < w.reach:
            least = np.minimum(least[: len(least) - (w.reach - k)], least[w.reach - k :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.repeat(self.base[1:], np.diff(self.base))
        start = np.flatnonzero(np.arange(len(at)) + w.length <= ends[: len(at)])
        if not len(start):
            return (np.empty(0, np.int64),) * 4
        trigger, text_end = at[start], ends[start]
        new = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(text_end) != 0)) + 1
        lo, hi = start[np.concatenate([[0], new])], start[np.concatenate([new - 1, [len(start) - 1]])]
        return np.searchsorted(self.base, lo, side="right") - 1, lo, hi, trigger[np.concatenate([[0], new])]


_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    got = _POWERS.get(inverse)
    if got is None or len(got) < n:
        step = np.uint64(pow(int(FACTOR), -1, 1 << 64)) if inverse else FACTOR
        got = np.full(max(n, BATCH_BYTES + 1), step, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 8 * BATCH_BYTES:
            _POWERS[inverse] = got
    return got[:n]


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), k, 1 << 64))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def segments_of(raw: bytes, unit: str, length: int, size: int = 0) -> Iterator[tuple[int, bytes]]:
    """(first unit, bytes) of segments of one text: each of its windows lies in exactly one of them."""
    size = size or SEGMENT
    if len(raw) <= size + size // 8:
        yield 0, raw
    elif unit == "byte":
        for at in range(0, max(1, len(raw) - length + 1), size):
            yield at, raw[at : at + size + length - 1]
    else:
        lo, seen, carry = 0, 0, []
        while lo < len(raw):
            hi = min(lo + size, len(raw))
            while hi < len(raw) and raw[hi] not in b"\t\n\v\f\r ":
                hi += 1
            own = carry + raw[lo:hi].split()
            yield seen, b" ".join(own)
            carry = own[max(0, len(own) - length + 1) :]
            seen += len(own) - len(carry)
            lo = hi


def batches_of(texts: list[bytes | None], unit: str = "", length: int = 1) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, first units, bytes) in slices of about ``BATCH_BYTES``; with ``unit``, long texts in segments."""
    own, base, part, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at, raw in segments_of(t or b"", unit, length) if unit else [(0, t or b"")]:
            if part and size + len(raw) > BATCH_BYTES:
                yield own, base, part
                own, base, part, size = [], [], [], 0
            own.append(i)
            base.append(at)
            part.append(raw)
            size += len(raw)
    if part:
        yield own, base, part


def run_keys(docs: DataFrame, w: Windows, places: bool) -> DataFrame:
    """One row a run: key and, with ``places``, ctx, rid, doc, lo, hi (windows by first unit of the text)."""
    names = ["key", *(["ctx", "rid", "doc", "lo", "hi"] if places else [])]
    core = w.length - w.reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, base, texts in batches_of(batch.column(2).cast(pa.binary()).to_pylist(), w.unit, w.length):
                b = Batch(texts, w.unit)
                text, lo, hi, trigger = b.runs(w)
                digest = xxhash.xxh3_64_intdigest
                cols = [pa.array(_signed(list(map(digest, b.cuts(trigger, trigger + core)))))]
                if places:
                    ctx = list(map(digest, b.cuts(lo, hi + w.length), (trigger - lo).tolist()))
                    off, row = np.array(base, np.int64)[text] - b.base[text], pa.array(np.array(own, np.int64)[text])
                    cols += [pa.array(_signed(ctx)), batch.column(0).take(row), batch.column(1).take(row), pa.array((lo + off).astype(np.int32)), pa.array((hi + off).astype(np.int32))]
                yield pa.record_batch(cols, names=names)

    kind = "key long" + ", ctx long, rid long, doc long, lo int, hi int" * places
    return docs.select("rid", "doc", "text").mapInArrow(run, kind)


def repeated_runs(docs: DataFrame, w: Windows, shard: Callable, earlier: bool) -> DataFrame:
    """(rid, lo, hi, mask): windows to remove of ``docs`` (rid, doc, text).

    Without ``earlier`` every window that also occurs elsewhere; with it, those that occur
    earlier by (doc, rid, place). ``mask`` null: all windows from lo to hi; else one byte a window.
    ``shard(phrases, w)`` gets ``Phrases`` and gives for each two masks: of the windows to remove at its
    first place, and of those at each of its other places.
    """
    keys = stash(run_keys(docs, w, False).groupBy("key").count().where("count > 1").select("key"))
    none = F.lit(0).cast("long")
    found = run_keys(docs, w, True).join(keys, "key").withColumns({"n": F.lit(1).cast("long"), "t": F.lit(-1), "skey": none, "sctx": none})
    source, on, size, out = docs.select("rid", F.lit(0).alias("base"), F.col("text").cast("binary").alias("data")), ["rid"], w.reach, None
    while True:
        parse = stash(found)
        phrases = parse.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "rid", "lo", "hi", "t", "skey", "sctx")).alias("rep"))
        phrases = stash(phrases.select("key", "ctx", "n", "rep.*"))
        crowded = stash(phrases.groupBy("key").count().where(F.col("count") > (w.hot if size > 1 else 1 << 62)).select("key", F.lit(True).alias("hot")))
        phrases = phrases.join(crowded, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        asked = phrases.groupBy(*on).agg(F.collect_list(F.struct(*(c for c in PHRASE if c not in ("data", *on)))).alias("asked"))
        texts = stash(_cut_out(source.join(asked, on), on, w))
        verdicts = stash(_sharded(texts.where("not hot"), w, shard))
        own = verdicts.where("marked").select("rid", "lo", "hi", "mask")
        # a phrase that stands again repeats as a whole, whatever the parts of its first place turn out to be
        again = texts.where("hot and n > 1").select("key", "ctx", "rid", "lo", "hi", F.lit(None).cast("binary").alias("further"))
        if not earlier:
            own = own.unionByName(again.select("rid", "lo", "hi", F.col("further").alias("mask")))
        again = verdicts.where("n > 1").select("key", "ctx", "rid", "lo", "further").unionByName(again.drop("hi"))
        again = again.select("key", "ctx", F.col("rid").alias("first_rid"), F.col("lo").alias("first_lo"), F.col("further").alias("mask"))
        others = parse.join(again, ["key", "ctx"]).where("rid != first_rid or lo != first_lo").select("rid", "lo", "hi", "mask")
        out = own.unionByName(others) if out is None else out.unionByName(own).unionByName(others)
        if size == 1 or crowded.isEmpty():
            return out
        size = -(-size // w.fan)
        source, on = texts.where("hot").select(F.col("key").alias("skey"), F.col("ctx").alias("sctx"), F.col("lo").alias("base"), "data", "n", "doc", "rid", "hi", "t"), ["skey", "sctx"]
        found, source = _parts(source, w, size), source.select("skey", "sctx", "base", "data")


#: A phrase: its names, how often it stands, its first place, the trigger's distance from its first window, where its text is.
PHRASE = {"key": "long", "ctx": "long", "n": "long", "doc": "long", "rid": "long", "lo": "int", "hi": "int", "t": "int", "hot": "boolean", "skey": "long", "sctx": "long", "data": "binary"}
KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _ddl(names: dict[str, str]) -> str:
    return ", ".join(f"{n} {k}" for n, k in names.items())


def _cut_out(rows: DataFrame, on: list[str], w: Windows) -> DataFrame:
    """The phrases asked for, with their text; a hot one's ``t`` is found if it isn't known yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                lists = batch.column(len(on) + 2)
                got = dict(zip((f.name for f in lists.type.value_type), lists.flatten().flatten(), strict=True))
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                got |= {c: batch.column(k).take(row) for k, c in enumerate(on)}
                lo, hi, at, data = got["lo"].to_pylist(), got["hi"].to_pylist(), 0, []
                for raw, base, n in zip(batch.column(len(on) + 1).to_pylist(), batch.column(len(on)).to_pylist(), sizes.tolist(), strict=True):
                    if w.unit == "word":
                        units = (raw or b"").split()
                        data += [b" ".join(units[lo[k] - base : hi[k] - base + w.length]) for k in range(at, at + n)]
                    else:
                        data += [raw[lo[k] - base : hi[k] - base + w.length] for k in range(at, at + n)]
                    at += n
                got["data"] = pa.array(data, pa.binary())
                t = zip(got["t"].to_pylist(), got["hot"].to_pylist(), data, strict=True)
                got["t"] = pa.array([int(Batch([d], w.unit).runs(w)[3][0]) if hot and k < 0 else k for k, hot, d in t], pa.int32())
                yield pa.record_batch([got[c].cast(KINDS[k]) for c, k in PHRASE.items()], names=list(PHRASE))

    return rows.select(*on, "base", "data", "asked").mapInArrow(run, _ddl(PHRASE))


@dataclass
class Phrases:
    """Phrases of whole keys: their text, number of windows, number of places, first place, and whether the key has no other phrase."""

    data: list[bytes]
    windows: list[int]
    n: list[int]
    place: list[tuple[int, int, int]]
    lone: list[bool]


VERDICT = {"key": "long", "ctx": "long", "n": "long", "rid": "long", "lo": "int", "hi": "int", "marked": "boolean", "mask": "binary", "further": "binary"}


def _sharded(phrases: DataFrame, w: Windows, shard: Callable) -> DataFrame:
    """Verdicts from shards of whole keys, about ``w.shard`` phrases each; large keys that meet are compared apart.

    A mask that is null stands for all windows.
    """
    n = max(1, phrases.count() // w.shard)
    packed = lambda m: None if m.all() else m.astype(np.uint8).tobytes()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        key = table["key"].to_numpy()
        edges = [*(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
        cols = {c: table[c].to_pylist() for c in ("data", "n", "doc", "rid", "lo", "hi")}
        windows = [b - a + 1 for a, b in zip(cols["lo"], cols["hi"], strict=True)]
        place = list(zip(cols["doc"], cols["rid"], cols["lo"], strict=True))
        size = np.diff([0, *edges])
        lone = np.repeat(size == 1, size).tolist()
        asked = lambda a, b: shard(Phrases(cols["data"][a:b], windows[a:b], cols["n"][a:b], place[a:b], lone[a:b]), w)
        masks, lo, last = [], 0, 0
        for hi in edges:
            if hi - lo > w.shard and last > lo:
                masks += asked(lo, last)
                lo = last
            last = hi
        masks += asked(lo, len(key)) if lo < len(key) else []
        marked = [bool(m.any()) for m, _ in masks]
        keep = pa.array([a or n > 1 for a, n in zip(marked, cols["n"], strict=True)], pa.bool_())
        extra = [pa.array(marked, pa.bool_()), pa.array([packed(m) for m, _ in masks], pa.binary()), pa.array([packed(f) for _, f in masks], pa.binary())]
        names = ["key", "ctx", "n", "rid", "lo", "hi"]
        out = pa.table([*(table[c] for c in names), *extra], names=list(VERDICT))
        return out.filter(keep)

    dealt = phrases.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n))).select("shard", "key", "ctx", "n", "doc", "rid", "lo", "hi", "data")
    return dealt.groupBy("shard").applyInArrow(run, _ddl(VERDICT))


PART = {k: v for k, v in PHRASE.items() if k not in ("hot", "data")}


def _parts(phrases: DataFrame, w: Windows, size: int) -> DataFrame:
    """The parse of hot phrases (skey, sctx, base, data, n, doc, rid, hi, t): a row for each part, without its text.

    Parts are cut where a window's distance to the trigger is a multiple of ``size``, so equal windows are
    in parts alike; the key names the units that all windows of such a part have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for skey, sctx, base, data, n, doc, rid, hi, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = data.split(b" ") if w.unit == "word" else data
                cut = (lambda a, b, u=units: b" ".join(u[a:b])) if w.unit == "word" else (lambda a, b, u=units: u[a:b])
                s = 0
                while s <= hi - base:
                    block = (t - s) // size
                    near = t - block * size
                    e = min(hi - base, near)
                    named = struct.pack("<qii", skey, size, block)
                    key = xxhash.xxh3_64_intdigest(named + cut(near, near - size + 1 + w.length))
                    ctx = xxhash.xxh3_64_intdigest(named + struct.pack("<i", near - s) + cut(s, e + w.length), seed=1)
                    rows.append((key, ctx, n, doc, rid, base + s, base + e, t - s, skey, sctx))
                    s = e + 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(PART)
            arrays = [pa.array(_signed(list(c))) for c in cols[:2]] + [pa.array(c, KINDS[k]) for c, k in zip(cols[2:], list(PART.values())[2:], strict=True)]
            yield pa.record_batch(arrays, names=list(PART))

    return phrases.select("skey", "sctx", "base", "data", "n", "doc", "rid", "hi", "t").mapInArrow(run, _ddl(PART))


def covered(n: int, runs: list[dict], length: int) -> np.ndarray:
    """Which of ``n`` units the removed windows cover."""
    out = np.zeros(n, bool)
    for r in runs:
        lo, hi, mask = r["lo"], r["hi"], r["mask"]
        if mask is None:
            out[lo : hi + length] = True
        else:
            edge = np.flatnonzero(np.diff(np.frombuffer(b"\0" + mask + b"\0", np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                out[lo + a : lo + b - 1 + length] = True
    return out
