"""Suffix-array deduplication through prefix-free parsing.

Rolling-hash triggers cut the corpus into overlapping phrases; each text is a parse, a row of
phrase names (``lexiflow.llm.repeats``), and every 400-byte string lies within one phrase. The
dictionary's phrases are dealt to shards by their trigger, so strings that could be equal meet.
What shares its trigger with no other phrase repeats as often as the parse holds it. Of the others a shard parses once more: rolling-hash triggers cut its phrases into short ones, whose distinct
forms make a dictionary and whose numbers make a parse. Suffix arrays of both are built apart;
together they give all suffixes in corpus order: first by the rest of the short phrase, then by
the parse that follows. Strings that repeat stand side by side there, and a phrase's number of
places in the corpus's parse tells how often. The more a corpus repeats itself, the smaller its
dictionaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import numbered
from lexiflow.llm.repeats import WEIGHTS, Phrases, Windows, _power, covered, repeated_runs

BYTES = Windows("byte", length=400, reach=192, seed=16)
#: Phrases end where the rolling hash of ``OVERLAP`` bytes is 0 modulo ``MODULUS``.
OVERLAP, MODULUS = 8, 32
#: Letters that one sort key holds.
LEADING = 7


def suffix_ranks(first: np.ndarray, width: int, ends: np.ndarray) -> np.ndarray:
    """Rank of each suffix among suffixes that run to their own row's end; equal suffixes, equal ranks.

    ``first`` orders suffixes by their first ``width`` letters, ``ends`` has the exclusive end of
    the row each place belongs to. Prefix doubling: ranks by 2 k letters come from pairs of ranks
    by k, for places that others still share a rank with.
    """
    n = len(first)
    rank, k = np.zeros(n + 1, np.int64), width
    here = np.argsort(first)
    new = np.concatenate([[True], first[here[1:]] != first[here[:-1]]])[:n]
    rank[here] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    while len(here):
        size = np.diff(np.append(np.flatnonzero(new), len(here)))
        here, size = here[np.repeat(size > 1, size)], size[size > 1]
        own = np.repeat(np.arange(len(size)), size)
        on = here + k < ends[here]  # the others have ended: equal to the end
        ended = size - np.bincount(own[on], minlength=len(size))
        here, own = here[on], own[on]
        if not len(here):
            break
        nxt = rank[here + k]
        by = np.argsort(own * (n + 2) + nxt, kind="stable")  # quick on rows that are grouped already
        here, own, nxt = here[by], own[by], nxt[by]
        group = np.concatenate([[True], own[1:] != own[:-1]])
        new = group | np.concatenate([[True], nxt[1:] != nxt[:-1]])
        start = np.maximum.accumulate(np.where(group, np.arange(len(here)), 0))
        sub = np.maximum.accumulate(np.where(new, np.arange(len(here)), 0)) - start
        # those that ended have the lowest rank of their group; the rest follow behind them
        rank[here] += ended[own] + sub
        k *= 2
    return rank[:n]


def _leading(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first ``LEADING`` letters at each place as one number; what lies past the row's end is below all letters."""
    n = len(letters)
    left, letter, key = ends - np.arange(n), letters.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for k in range(min(LEADING, n)):
        key[: n - k] += (letter[k:] * (left[: n - k] > k)) << np.uint64(9 * (LEADING - 1 - k))
    return key


class Parsing:
    """Dictionary and parse of some texts, and the suffix order that they combine to."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.text_end = np.repeat(ends, sizes)
        h, k = WEIGHTS[raw], 1
        while k < OVERLAP:
            h = h[:-k] * _power(k) + h[k:] if len(h) > k else h[:0]
            k *= 2
        hit = np.flatnonzero((h ^ (h >> np.uint64(31))) % np.uint64(MODULUS) == 0)
        hit = hit[hit + OVERLAP <= self.text_end[hit]]
        # a phrase begins at each trigger and each text's start, and takes the next trigger's bytes along
        self.begin = np.union1d(hit, np.concatenate([[0], ends[:-1]])[sizes > 0]).astype(np.int64)
        nxt = np.append(self.begin[1:], len(raw))
        own = self.text_end[self.begin] if len(self.begin) else self.begin
        stop = np.where(nxt < own, nxt + OVERLAP, own)
        numbers: dict[bytes, int] = {}
        spans = zip(self.begin.tolist(), np.minimum(stop, own).tolist(), strict=True)
        parse = np.array([numbers.setdefault(self.data[a:b], len(numbers)) for a, b in spans], np.int64)
        self.dictionary = list(numbers)
        self.parse, self.owner = parse, own

    def order(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``places`` in corpus order, and the dictionary rank of each."""
        if not len(self.parse):
            return places[:0], places[:0]
        sizes = np.array([len(p) for p in self.dictionary], np.int64)
        ends = np.cumsum(sizes)
        row_ends = np.repeat(ends, sizes)
        letters = np.frombuffer(b"".join(self.dictionary), np.uint8)
        inner = suffix_ranks(_leading(letters, row_ends), LEADING, row_ends)  # suffixes of dictionary phrases
        begin = ends - sizes
        row_end = np.searchsorted(self.begin, self.owner)
        outer = suffix_ranks(inner[begin][self.parse], 1, row_end)  # suffixes of the parse, phrases in order of their text
        phrase = np.searchsorted(self.begin, places, side="right") - 1
        first = inner[begin[self.parse[phrase]] + places - self.begin[phrase]]
        rest = np.append(outer, 0)[np.where(phrase + 1 < row_end[phrase], phrase + 1, len(outer))]
        by = np.argsort(first * (len(outer) + 2) + rest)
        return places[by], first[by]


def repeated_places(texts: list[bytes], length: int) -> np.ndarray:
    """For each byte of the joined texts: does a ``length``-byte string start here that also starts elsewhere?"""
    parsing = Parsing(texts)
    out = np.zeros(len(parsing.data), bool)
    if len(parsing.data) < length:
        return out
    places = np.flatnonzero(np.arange(len(out)) + length <= parsing.text_end)
    order, first = parsing.order(places)
    raw = np.frombuffer(parsing.data, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    # neighbours with another rest of the phrase differ within it, as no such rest begins another
    twins = np.flatnonzero(first[:-1] == first[1:]) if parsing_is_short(parsing, length) else np.arange(max(0, len(order) - 1))
    for lo in range(0, len(twins), 1 << 14):
        t = twins[lo : lo + (1 << 14)]
        same = t[(view[order[t]] == view[order[t + 1]]).all(axis=1)]
        out[order[same]] = out[order[same + 1]] = True
    return out


def parsing_is_short(parsing: Parsing, length: int) -> bool:
    """Whether each window passes the end of the phrase it starts in."""
    return max(map(len, parsing.dictionary), default=0) < length


def shard_masks(p: Phrases, w: Windows) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which windows of each phrase the suffix order puts beside an equal one, or the parse holds again.

    Equal windows have equal keys and no run holds two of them, so only phrases of keys with several phrases need an order.
    """
    shared = [data for data, lone in zip(p.data, p.lone, strict=True) if not lone]
    found = repeated_places(shared, w.length) if shared else np.zeros(0, bool)
    out, at = [], 0
    for data, windows, n, lone in zip(p.data, p.windows, p.n, p.lone, strict=True):
        mask = np.full(windows, n > 1) if lone else found[at : at + windows] | (n > 1)
        out.append((mask, mask))
        at += 0 if lone else len(data)
    return out


def suffix_dedup(docs: DataFrame, w: Windows = BYTES) -> DataFrame:
    """One row per document: rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Each text is UTF-8 bytes (null: empty). A byte is removed where a string of ``w.length`` bytes
    covers it that also starts anywhere else, in this or another document, judged on the input.
    ``spans`` lists the maximal removed runs as (start, end), end exclusive. Repeated rows repeat
    each other and so lose what is long enough. Texts shorter than a window, empty tables and
    null ids are fine; columns besides doc_id and text are left out.
    """
    rows = numbered(docs).withColumnRenamed("doc_id", "doc")
    runs = repeated_runs(rows, w, shard_masks, earlier=False)
    gone = runs.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "mask")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"rid": [], "n_removed": [], "kept": [], "spans": []}
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                cover = covered(len(raw), batch.column(2)[i].as_py(), w.length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
                out["rid"].append(batch.column(0)[i].as_py())
                out["n_removed"].append(int(cover.sum()))
                out["kept"].append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~cover].tobytes()).hexdigest())
                out["spans"].append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    cut = rows.select("rid", "text").join(gone, "rid").mapInArrow(run, "rid long, n_removed long, kept string, spans array<struct<start:int,end:int>>")
    whole = rows.select("rid", F.col("doc").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha256"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return whole.join(cut, "rid", "left").select(
        "rid",
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "all_sha256").alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"),
    )
