"""Substring deduplication with repeated-phrase automata.

Passages that recur are confirmed word for word, compiled into Aho-Corasick automata, one a
shard, and the text is streamed through to locate every occurrence; all but the earliest
are removed. Shards hold whole keys (see ``lexiflow.llm.repeats``), so each stretch of text
is streamed through just the automaton that can know it, and a stretch that stands many times
is streamed once: what is located in it holds for each of its places.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import SPACES, numbered, words
from lexiflow.llm.repeats import Phrases, Windows, covered, repeated_runs

WORDS = Windows("word", length=20, reach=15, seed=4, fan=3, shard=1000)
#: Stands for a null id, which ranks before all others.
NO_ID = -(1 << 63)


def recurring(texts: list[tuple[int, ...]], times: list[int], length: int) -> dict[tuple[int, ...], int]:
    """The word sequences of ``length`` that stand more than once, numbered; ``times``: how often each text stands."""
    seen: dict[tuple[int, ...], int] = {}
    count = seen.get
    for t, n in zip(texts, times, strict=True):
        for i in range(len(t) - length + 1):
            p = t[i : i + length]
            seen[p] = count(p, 0) + n
    return {p: k for k, p in enumerate(p for p, n in seen.items() if n > 1)}


def automaton(passages: dict[tuple[int, ...], int]) -> ahocorasick.Automaton | None:
    """One automaton over all passages; None without any."""
    if not passages:
        return None
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p, k in passages.items():
        machine.add_word(p, k)
    machine.make_automaton()
    return machine


def shard_masks(p: Phrases, w: Windows) -> list[tuple[np.ndarray, np.ndarray]]:
    """The windows that the shard's automaton locates: at each text's first place those that stand earlier
    somewhere, and all of them at its later places.

    Texts are streamed through in the order of their first places, whose windows don't interleave, so a
    passage stands earlier if it has been located before.
    """
    numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    texts = [tuple(map(numbers.__getitem__, data.split(b" "))) for data in p.data]
    machine = automaton(recurring(texts, p.n, w.length))
    out = [(np.zeros(n, bool), np.zeros(n, bool)) for n in p.windows]
    seen: set[int] = set()
    for i in sorted(range(len(texts)), key=p.place.__getitem__) if machine else ():
        found = [(end - w.length + 1, k) for end, k in machine.iter(texts[i])]
        if found:
            starts, passages = zip(*found, strict=True)
            # a passage may stand twice in one text too, so each is noted as it comes
            out[i][0][list(starts)] = [bool(k in seen or seen.add(k)) for k in passages]
            out[i][1][list(starts)] = True
    return out


def _cut(rows: DataFrame, w: Windows) -> DataFrame:
    """(rid, n_removed, kept_text) of the documents that lose words; ``rows`` has rid, doc_id, text."""
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    runs = repeated_runs(rows, w, shard_masks, earlier=True)
    gone = runs.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "mask")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"rid": [], "n_removed": [], "kept_text": []}
            for i in range(batch.num_rows):
                found = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                cover = covered(len(found), batch.column(2)[i].as_py(), w.length)
                out["rid"].append(batch.column(0)[i].as_py())
                out["n_removed"].append(int(cover.sum()))
                kept = b" ".join([x for x, c in zip(found, cover.tolist(), strict=True) if not c])
                out["kept_text"].append(kept.decode("utf-8", "surrogatepass"))
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.select("rid", "text").join(gone, "rid").mapInArrow(run, "rid long, n_removed long, kept_text string")


def phrase_dedup(docs: DataFrame, w: Windows = WORDS) -> DataFrame:
    """One row per document: rid, doc_id, n_words, n_removed, kept_sha256.

    A word is removed where a window of ``w.length`` words covers it whose words also start
    earlier: in a document with a smaller id (repeated ids: the earlier row), or before in the
    same one. Windows are judged on the input. ``kept_sha256`` is of the kept words, one space
    between them; ``deduplicated`` has that text itself. Null texts have no words; a null id
    ranks first; texts shorter than a window keep all. Columns besides doc_id and text are
    left out; an empty table gives no rows.
    """
    rows = numbered(docs)
    cut = _cut(rows, w).select("rid", "n_removed", F.sha2("kept_text", 256).alias("cut_sha256"))
    whole = rows.select("rid", "doc_id", F.size(words("text")).cast("long").alias("n_words"), F.sha2(_plain(), 256).alias("all_sha256"))
    removed = F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed")
    return whole.join(cut, "rid", "left").select("rid", "doc_id", "n_words", removed, F.coalesce("cut_sha256", "all_sha256").alias("kept_sha256"))


def deduplicated(docs: DataFrame, w: Windows = WORDS) -> DataFrame:
    """(rid, doc_id, text): every document with its kept words only, as ``phrase_dedup`` judges them."""
    rows = numbered(docs)
    cut = _cut(rows, w)
    return rows.join(cut, "rid", "left").select("rid", "doc_id", F.coalesce("kept_text", _plain()).alias("text"))


def _plain():
    return F.array_join(words("text"), " ")
