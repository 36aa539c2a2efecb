"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. Over its adjacent pairs stands a segment tree of (rank, place);
the root is the leftmost lowest-rank merge. A merge changes three leaves, so three paths to
the root are renewed: logarithmic work a merge, until the root holds no mergeable pair.
Trees of many words are kept as one array and step together, which is what makes this fast
in numpy; words of a batch are encoded once each.

Scale: a narrow stage without shuffle. A task holds one Arrow batch and a word cache of at
most ``CACHE_WORDS`` entries. The vocabulary is read from ``path`` on each executor, once a
worker process.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 300_000
#: Cells of a batch of trees, and documents of an output batch.
TREE_CELLS, OUT_DOCS = 1 << 22, 256
NONE = np.int64(1) << 62
#: Words of more bytes than ``LONG`` are encoded one by one where a batch has less than ``FEW`` of their length.
LONG, FEW = 128, 32


class Bpe:
    """The BPE tokenizer that a tokenizer.json file of the kind in ``word_bpe_49k.json`` describes."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        end, letters = model["end_of_word_suffix"] or "", byte_letters()
        self.plain = np.array([self.vocab[c] for c in letters], np.int64)
        self.final = np.array([self.vocab[c + end] for c in letters], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pair = np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank, self.made = pair[order], order.astype(np.int64), made[order]
        self.by_rank = made
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.rank_of: dict[int, int] | None = None
        self.made_by: list[int] = []

    def words(self, text: str) -> list[str]:
        """Normalised pre-tokens: NFC, lower case letter by letter, white space dropped."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE without one."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NONE)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each word."""
        raw = [w.encode() for w in words]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(raw)
        sizes = np.array([len(r) for r in raw])
        width = np.where(sizes > 2, 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(int), 1)
        for p in np.unique(width[sizes > 0]):
            rows = np.flatnonzero((width == p) & (sizes > 0))
            if p >= LONG and len(rows) < FEW:  # too few to step together
                for i in rows:
                    out[i] = self._encode_one(raw[i], int(p))
                continue
            step = max(1, TREE_CELLS // int(2 * p))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                for i, ids in zip(part, self._encode([raw[i] for i in part], int(p)), strict=True):
                    out[i] = ids
        return out

    def _encode(self, raw: list[bytes], p: int) -> list[np.ndarray]:
        """Words of 1 to p + 1 bytes, each with a tree of p leaves; node 1 is the root."""
        n = np.array([len(r) for r in raw])
        rows, cols = len(raw), p + 1
        inside = np.arange(cols) < n[:, None]
        sym = np.zeros((rows, cols), np.int64)
        sym[inside] = self.plain[np.frombuffer(b"".join(raw), np.uint8)]
        all_rows = np.arange(rows)
        sym[all_rows, n - 1] = self.final[np.array([r[-1] for r in raw])]
        alive = inside.copy()
        after = np.tile(np.arange(1, cols + 1), (rows, 1))
        after[after >= n[:, None]] = cols
        before = np.tile(np.arange(-1, cols - 1), (rows, 1))
        tree = np.full((rows, 2 * p), NONE, np.int64)
        r, c = np.nonzero(inside[:, 1:])
        tree[r, p + c] = self._leaf(sym[r, c], sym[r, c + 1], c)
        for k in range(p - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root & 0xFFFFFFFF, root >> 32
            gone = after[live, at]
            sym[live, at] = self.by_rank[rank]
            alive[live, gone] = False
            nxt, prv = after[live, gone], before[live, at]
            after[live, at] = nxt
            has = nxt < cols
            before[live[has], nxt[has]] = at[has]
            new = np.full(len(live), NONE)
            new[has] = self._leaf(sym[live[has], at[has]], sym[live[has], nxt[has]], at[has])
            self._renew(tree, live, p, at, new)
            inner = gone < p
            self._renew(tree, live[inner], p, gone[inner], np.full(inner.sum(), NONE))
            had = prv >= 0
            self._renew(tree, live[had], p, prv[had], self._leaf(sym[live[had], prv[had]], sym[live[had], at[had]], prv[had]))
            live = live[tree[live, 1] < NONE]
        ends = np.cumsum(alive.sum(axis=1))
        return np.split(sym[alive].astype(np.uint32), ends[:-1])

    def _encode_one(self, raw: bytes, p: int) -> np.ndarray:
        """One word with a tree of p leaves of its own; a path is renewed as far up as it changes."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.pair.tolist(), self.rank.tolist(), strict=True))
            self.made_by = self.by_rank.tolist()
        n, none, rank_of = len(raw), int(NONE), self.rank_of
        sym = self.plain[np.frombuffer(raw, np.uint8)].tolist()
        sym[-1] = int(self.final[raw[-1]])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * p)

        def leaf(i: int, j: int) -> int:
            rank = rank_of.get((sym[i] << 20) | sym[j])
            return none if rank is None else (rank << 32) | i

        def put(i: int, value: int) -> None:
            k = i + p
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    return
                tree[k] = least

        for i in range(n - 1):
            tree[p + i] = leaf(i, i + 1)
        for k in range(p - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            at, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone, prv = after[at], before[at]
            sym[at], nxt = self.made_by[rank], after[gone]
            after[at] = nxt
            if nxt < n:
                before[nxt] = at
            put(at, leaf(at, nxt) if nxt < n else none)
            if gone < p:
                put(gone, none)
            if prv >= 0:
                put(prv, leaf(prv, at))
        ids, i = [], 0
        while i < n:
            ids.append(sym[i])
            i = after[i]
        return np.array(ids, np.uint32)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where(rank < NONE, (rank << 32) | at, NONE)

    @staticmethod
    def _renew(tree: np.ndarray, rows: np.ndarray, p: int, leaf: np.ndarray, value: np.ndarray) -> None:
        """Put ``value`` at the leaves and renew the path from each to the root."""
        k = leaf + p
        tree[rows, k] = value
        while p > 1:
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            p >>= 1

    def learn(self, words: set[str]) -> None:
        """Put the encodings of ``words`` into the cache, which starts anew beyond its bound."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        for w, ids in zip(new, self.encode_words(new), strict=True):
            self.cache[w] = (ids.astype("<u4").tobytes(), self.decode(ids))

    def decode(self, ids) -> str:
        """The tokens of ``ids`` joined by a space, as a tokenizer without decoder has it."""
        return " ".join(self.tokens[int(i)] for i in ids)

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        cut = [self.split_special.split(t) if self.split_special else [t] for t in texts]
        parts = [[self.words(s) if k % 2 == 0 else s for k, s in enumerate(c)] for c in cut]
        out, lo = [], 0
        while lo < len(parts):  # as many texts at a time as the cache can hold the words of
            need, hi = set(), lo
            while hi < len(parts) and (hi == lo or len(need) < CACHE_WORDS // 2):
                need.update(*(p for p in parts[hi] if isinstance(p, list)))
                hi += 1
            self.learn(need)
            for part in parts[lo:hi]:
                got = []
                for p in part:
                    if isinstance(p, list):
                        got += map(self.cache.__getitem__, p)
                    else:
                        got.append((self.special[p].to_bytes(4, "little"), p))
                out.append((b"".join([x[0] for x in got]), " ".join([x[1] for x in got])))
            lo = hi
        return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def bpe_codec(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_le, decoded): every text encoded and its ids decoded again.

    ``ids_le`` is binary, little-endian unsigned 32-bit integers; no special tokens are added,
    but their strings in a text become their ids. Null texts count as empty: no tokens and an
    empty decoded text. Rows come out as they went in, repeated ones too; other columns are
    left out. ``path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_DOCS):
                part = batch.slice(lo, OUT_DOCS)
                got = bpe.encode_batch(part.column(1).to_pylist())
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x, _ in got], pa.int64()),
                        pa.array([x for x, _ in got], pa.binary()),
                        pa.array([x for _, x in got], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_le", "decoded"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_le binary, decoded string")
