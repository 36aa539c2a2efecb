"""Phrase collocations: frequent n-grams by pivot partitioning, scored by their weakest cut.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and those into words; all counts
are per language.

1. Words are counted, in each task first. Those with ``least`` occurrences or more are ranked by frequency; every
   other word is a gap, as no phrase with it is frequent.
2. Pivot partitioning: an n-gram belongs to its rarest word, of several such to the leftmost. At each place of a word the
   text around it is rewritten to what phrases of this pivot can hold: up to ``longest - 1`` words on each side, as far as
   they are no rarer (and on the left not the same). These fragments are combined in each task and routed to the pivot's shard.
3. Each shard mines its pivots level by level: from the pivot to the right, then to the left, going on only from n-grams
   that are frequent. All places of an n-gram are in its pivot's shard, so its count there is whole, and no n-gram is counted twice.
   A pivot with over ``hot`` occurrences is dealt to several shards by its fragments; their counts are added up before the bound is applied.
4. Cuts are joined with the counts of both parts; a phrase that a longer one holds as often is dropped; the best remain.

Scale: text is read twice and never shuffled. What is shuffled are fragments as packed numbers, at most one
a word and combined in each task. The list of ranks that tasks get has ``listed`` words at most (12 bytes each); if there are
more frequent words, those beyond count as rarer than all listed and go by their hash, and gaps are no longer
known beforehand, which costs work, not results. Words are told apart by 64-bit hashes within a language. The
last step ranks by language; Spark keeps ``best`` rows a task before it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.chosen_path import mixed
from lexiflow.llm.repeats import segments_of
from lexiflow.session import stash


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 to ``longest`` words with ``least`` places; ``share`` percent of the places of a phrase must be
    outside of each longer one; ``best`` rows a language. ``window``: words a task combines at once."""

    longest: int = 5
    least: int = 100
    share: int = 100
    best: int = 2000
    listed: int = 1_000_000
    hot: int = 1_000_000
    shard: int = 400_000
    window: int = 2_000_000


#: Where pieces end; these characters are in no word.
ENDS = b".,;:!?\n\v\f\r"
_TURNED = bytes(46 if b in ENDS else b for b in range(256))
UNKNOWN = "und"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, with a single full stop where a piece ends; long texts come in several lists."""
    for _, raw in segments_of(text, "word", 1):
        yield raw.lower().translate(_TURNED).replace(b".", b" . ").split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def word_id(h: np.ndarray) -> np.ndarray:
    """The name of a word in a phrase: its hash, beyond all ranks."""
    return (h >> np.uint64(2)).astype(np.int64) + np.int64(1 << 32)


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, h, word, f): counts of words, and of all of a language's words under a null word."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        out = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
        langs, words, n = zip(*out, strict=True) if out else ((), (), ())
        h = np.array([0 if w is None else word_hash(w) for w in words], np.uint64).view(np.int64)
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(h), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "h", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = counts[lang]
                for words in pieces(text.as_py()):
                    ends = words.count(b".")
                    own.update(words)
                    if ends:
                        own[b"."] -= ends
                    own[None] += len(words) - ends
                if sum(map(len, counts.values())) > 200_000:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    found = docs.mapInArrow(run, "lang string, h long, word binary, f long")
    return found.where("f > 0").groupBy("lang", "h", "word").agg(F.sum("f").alias("f"))


class Ranks:
    """Ranks of frequent words by language: 1 for the most frequent. ``whole``: all frequent words are listed."""

    def __init__(self, rows: list[tuple[str, int, int]], whole: bool) -> None:
        """``rows``: (lang, hash, f) of words, most frequent first within a language."""
        by: dict[str, list] = defaultdict(list)
        for lang, h, f in rows:
            by[lang].append((h, f))
        self.whole = whole
        self.hashes = {k: np.array([h for h, _ in v], np.int64).view(np.uint64) for k, v in by.items()}
        self.counts = {k: np.array([f for _, f in v], np.int64) for k, v in by.items()}
        self.order = {k: np.argsort(v).astype(np.int32) for k, v in self.hashes.items()}
        most = max((len(v) for v in by.values()), default=0)
        self.kind = np.int64 if not whole else np.uint16 if most < 1 << 16 else np.uint32

    def of(self, lang: str, h: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes: the rank, or 0 for a word that isn't frequent, or a number beyond all ranks if that isn't known."""
        other = np.int64(0) if self.whole else word_id(h)
        if lang not in self.hashes:
            return np.zeros(len(h), np.int64) + other
        order, own = self.order[lang], self.hashes[lang]
        at = order[np.minimum(np.searchsorted(own, h, sorter=order), len(own) - 1)]
        return np.where(own[at] == h, at.astype(np.int64) + 1, other)

    def shares(self, lang: str, number: np.ndarray, hot: int) -> np.ndarray:
        """To how many shards a pivot is dealt."""
        counts = self.counts.get(lang, np.zeros(1, np.int64))
        listed = (number > 0) & (number <= len(counts))
        return np.where(listed, -(-counts[np.where(listed, number, 1) - 1] // hot), 1)


def fragments(w: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragments, how often each stands) of numbered words, 0 for gaps. A fragment is a column: the pivot, the words to its right, those to its left."""
    side = longest - 1
    padded = np.concatenate([np.zeros(side, w.dtype), w, np.zeros(side, w.dtype)])
    cols = [w]
    for step in (1, -1):
        open_ = w > 0
        for d in range(1, longest):
            at = side + step * d
            near = padded[at : at + len(w)]
            open_ = open_ & (near > 0) & ((near <= w) if step == 1 else (near < w))
            cols.append(np.where(open_, near, 0))
    rows = np.stack(cols)
    rows = rows[:, (rows[1] > 0) | (rows[1 + side] > 0)]
    key = np.zeros(rows.shape[1], np.uint64)
    for c in rows:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if (rows[:, first][:, inverse] != rows).any():  # two fragments of one hash
        return np.unique(rows, axis=1, return_counts=True)
    return rows[:, first], n


def _routed(docs: DataFrame, ranks: Ranks, p: Phrases, n_shards: int) -> DataFrame:
    """(shard, lang, n, data): fragments, packed by shard."""

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = k = len(self)
            return k

    def packed(lang: str, numbers: dict, parts: list[np.ndarray]) -> Iterator[tuple]:
        h = np.fromiter(map(word_hash, numbers), np.uint64, len(numbers))
        known = ranks.of(lang, h)
        known[numbers[b"."]] = 0
        rows, n = fragments(known[np.concatenate(parts)], p.longest)
        share = ranks.shares(lang, rows[0], p.hot)
        key = np.zeros(rows.shape[1], np.uint64)
        for c in rows:
            key = mixed(key + c.astype(np.uint64))
        salt = key % share.astype(np.uint64)
        start = np.uint64(word_hash(lang.encode()))
        shard = mixed(mixed(rows[0].astype(np.uint64) ^ start) + salt) % np.uint64(n_shards)
        order = np.argsort(shard, kind="stable")
        rows, n, shard = rows[:, order].astype(ranks.kind), n[order].astype(np.int32), shard[order]
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(shard[lo]), lang, hi - lo, rows[:, lo:hi].tobytes() + n[lo:hi].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, Numbers] = defaultdict(Numbers)
        parts: dict[str, list] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in parts.items():
                out = list(packed(lang, numbers[lang], own))
                for lo in range(0, len(out), 64):
                    cols = list(zip(*out[lo : lo + 64], strict=True))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["shard", "lang", "n", "data"])
            numbers.clear()
            parts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = numbers[lang]
                for words in pieces(text.as_py()):
                    parts[lang].append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                parts[lang].append(np.array([own[b"."]], np.int32))
                if size > p.window:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, "shard long, lang string, n long, data binary")


def mined(rows: np.ndarray, n: np.ndarray, salted: np.ndarray, p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) by shape: those of ``rows`` (as ``fragments`` gives them) with ``p.least`` places, or any where ``salted``."""
    side = p.longest - 1

    def grown(state: tuple, column: np.ndarray, right: bool) -> tuple | None:
        at, name, grams, free = state
        own = column[at] > 0
        at, name = at[own], name[own]
        if not len(at):
            return None
        values, code = np.unique(column[at], return_inverse=True)
        keys, inverse = np.unique(name * len(values) + code, return_inverse=True)
        counts = np.bincount(inverse, weights=n[at]).astype(np.int64)
        parent, added = keys // len(values), values[keys % len(values)]
        kept = (counts >= p.least) | free[parent]
        number = np.cumsum(kept) - 1
        stay = kept[inverse]
        word = added[kept][:, None]
        grams = grams[parent[kept]]
        grams = np.concatenate([grams, word] if right else [word, grams], axis=1)
        return (at[stay], number[inverse[stay]], grams, free[parent[kept]]), counts[kept]

    pivots, name = np.unique(rows[0], return_inverse=True)
    free = np.zeros(len(pivots), bool)
    free[name[salted]] = True
    start = (np.arange(rows.shape[1]), name, pivots[:, None], free)
    for r in range(p.longest):
        if r:
            found = grown(start, rows[r], True)
            if found is None:
                return
            start, counts = found
            yield start[2], counts
        state = start
        for k in range(1, p.longest - r):
            found = grown(state, rows[side + k], False)
            if found is None:
                break
            state, counts = found
            yield state[2], counts


def _grams(routed: DataFrame, ranks: Ranks, p: Phrases) -> DataFrame:
    """(lang, hs, f): frequent n-grams as names of their words."""

    def run(table: pa.Table) -> pa.Table:
        by: dict[str, list] = defaultdict(list)
        for lang, n, data in zip(*(table[c].to_pylist() for c in ("lang", "n", "data")), strict=True):
            by[lang].append((n, data))
        langs, grams, counts = [], [], []
        for lang, packs in by.items():
            cut = np.dtype(ranks.kind).itemsize * (2 * p.longest - 1)
            rows = np.concatenate([np.frombuffer(d, ranks.kind, n * (2 * p.longest - 1)).reshape(-1, n) for n, d in packs], axis=1).astype(np.int64)
            n = np.concatenate([np.frombuffer(d, np.int32, k, k * cut) for k, d in packs])
            salted = ranks.shares(lang, rows[0], p.hot) > 1
            own = ranks.hashes.get(lang, np.zeros(1, np.uint64))
            for found, f in mined(rows, n, salted, p):
                listed = found <= len(own)
                grams += np.where(listed, word_id(own[np.where(listed, found, 1) - 1]), found).tolist()
                counts += f.tolist()
                langs += [lang] * len(f)
        return pa.table({"lang": pa.array(langs, pa.string()), "hs": pa.array(grams, pa.list_(pa.int64())), "f": pa.array(counts, pa.int64())})

    found = routed.groupBy("shard").applyInArrow(run, "lang string, hs array<long>, f long")
    return found.groupBy("lang", "hs").agg(F.sum("f").alias("f")).where(F.col("f") >= p.least)


def collocations(docs: DataFrame, p: Phrases = Phrases()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases, from 1.

    ``n`` counts all words of the language, ``a`` the places of the phrase. A cut after its first k words gives l and r, the places of
    both parts, and floor(1000 a n / (l r)); the lowest score counts, of ties that of the smallest k. Order is by score, then
    ``a``, both falling, then by the phrase's bytes, so it has no ties. Needs ``lang`` and ``text``: a null language is
    ``und``, a null or empty text has no words; repeated rows count each; any length of text is taken whole; an empty table, or one without
    frequent phrases, gives no rows; other columns are left out, whatever their names.
    """
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = stash(_counted(docs).where((F.col("f") >= p.least) | F.col("word").isNull()))
    totals = counted.where("word is null").select("lang", F.col("f").cast("decimal(15, 0)").alias("n"))
    words = counted.where((F.col("f") >= p.least) & F.col("word").isNotNull())
    known = words.agg(F.count("*").alias("words"), F.coalesce(F.sum("f"), F.lit(0)).alias("places")).first()
    top = words.orderBy(F.desc("f"), "lang", "h").limit(p.listed).select("lang", "h", "f").collect()  # ``listed`` rows at most
    ranks = Ranks([tuple(r) for r in sorted(top, key=lambda r: (r.lang, -r.f, r.h))], known.words <= p.listed)
    routed = _routed(docs, ranks, p, max(1, known.places // p.shard))
    grams = stash(_grams(routed, ranks, p))
    own = stash(words.select("lang", (F.shiftrightunsigned("h", 2) + F.lit(1 << 32)).alias("id"), F.col("word").cast("string").alias("word"), "f"))
    every = stash(own.select("lang", F.array("id").alias("hs"), "f").unionByName(grams))
    of = lambda c: every.select("lang", F.col("hs").alias(c), F.col("f").cast("decimal(15, 0)").alias(c[0]))
    size = F.size("hs")
    cuts = grams.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("hs", F.lit(1), F.col("k")), "right": F.slice("hs", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(of("left"), ["lang", "left"]).join(of("right"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(f as decimal(15, 0)) * n * cast(1000 as decimal(4, 0))) div (l * r)")
    scored = cuts.groupBy("lang", "hs").agg(F.first("f").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # what a longer phrase holds: its parts of two words and more
    parts = grams.where(size > 2).withColumn("len", F.explode(F.sequence(F.lit(2), size - 1)))
    parts = parts.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("len") + 1))).select("lang", F.slice("hs", F.col("at"), F.col("len")).alias("hs"), "f")
    within = parts.groupBy("lang", "hs").agg(F.max("f").alias("longer"))
    free = scored.join(within, ["lang", "hs"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < p.share * F.col("a"))).drop("longer")
    spelt = free.select("lang", "hs", F.posexplode("hs").alias("at", "id")).join(own.select("lang", "id", "word"), ["lang", "id"])
    spelt = spelt.groupBy("lang", "hs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = free.join(spelt, ["lang", "hs"]).withColumns({"score": F.col("cut.score"), "l": F.col("cut.l").cast("long"), "r": F.col("cut.r").cast("long"), "n": F.col("n").cast("long")})
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= p.best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
