"""N-gram Jaccard self-join with signature trees.

A document's set has the hashes of its word n-grams. Sets that may link come together in
families; in each a signature tree is built: leaves of similar sets, inner nodes with the
OR of the token bitmaps below and the range of set sizes. The tree is traversed against
itself, pairs of nodes first: a pair goes no further when the largest overlap that bitmaps
and sizes allow can't reach the threshold, or when all its sets are linked already. What is
left is verified on the sets.

Candidates: with a threshold of t percent, a set has at most (100 - t) percent tokens that a set
it links with lacks. So a set with more tokens of its own alone can't link. That is counted
twice: over the tokens with a hash below ``share`` of the range for all sets, then over the
other tokens for the sets that passed. Few but true near copies are left.

Families: two sets that link share one of their first n - ceil(t n / 100) + 1 tokens in any
order common to all sets. The order here is by hash, but tokens that are frequent in a bounded
sample of the candidates come last; it only decides how much work there is. Connected
components over shared first tokens are the families. No link can join two of them. Sets that link
are of similar size, so a token only ties sets of neighbouring size bands: each set stands under
its own band and the next. That keeps phrases that texts of all lengths share from chaining families.

Scale: a part of each set is shuffled by token, pre-aggregated on the map side. Equal sets are
one node, named by its first row, so names never clash. Candidates are told to all tasks as bits, so
texts and sets stay where they are until families are joined. Links come back as spanning edges, never as all pairs. A family over ``family`` tokens
is no one task's work. First it is parted again, with an order of tokens by how many of its sets have them: what few
sets share comes first, so passages that many unlike texts hold no longer chain it, whatever the sample missed. That is
done again while it helps. What stays over ``family`` is dealt to blocks of sets of similar size, twice and differently, and
each block is joined in itself; that grows large groups of copies together. What is in its
family's largest group then need not meet others of that group, so only the remaining sets are
paired with all blocks of compatible size. The work left is the number of such sets times the
family, which is small where the family is one group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import numbered
from lexiflow.llm.graph import among, components
from lexiflow.llm.repeats import Batch, batches_of
from lexiflow.session import stash


#: A list of tasks of up to so many rows may be broadcast, if Spark finds it small enough on disk.
BROADCAST_ROWS = 300_000


@dataclass(frozen=True)
class Similar:
    """``gram`` words a shingle, links from ``percent`` of the union; ``share`` of the hash range that
    is counted for all; ``sample`` candidates, of
    which tokens with ``frequent`` or more (``last`` at most) come last in the order; ``family``
    tokens a task at most (8 bytes each), ``bits`` of a bitmap, ``leaf`` sets a leaf, ``fan`` children a node."""

    gram: int = 5
    percent: int = 75
    share: float = 0.3
    sample: int = 10_000
    frequent: int = 6
    last: int = 50_000
    family: int = 6_000_000
    bits: int = 2048
    leaf: int = 16
    fan: int = 4


def shingle_sets(texts: list[bytes], gram: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z counts as a-z. Long texts are taken in segments."""
    mix = np.uint64(0xD6E8FEB86659FD93)
    open_, parts = 0, []
    for own, base, part in batches_of([t.lower() for t in texts], "word", gram):
        b = Batch(part, "word")
        n = len(b.hash) - gram + 1
        h = np.zeros(max(n, 0), np.uint64)
        for k in range(gram):
            h = (h ^ (h >> np.uint64(32))) * mix + b.hash[k : k + max(n, 0)] if n > 0 else h
        h = _mixed(h)
        for text, at, lo, hi in zip(own, base, b.base[:-1].tolist(), b.base[1:].tolist(), strict=True):
            if text != open_:
                yield _united(parts)
                open_, parts = text, []
            if hi - lo >= gram:
                parts.append(np.unique(h[lo : hi - gram + 1]))
            elif hi > lo and not at:  # fewer words: the whole sequence, told apart from any shingle by its length
                parts.append(np.array([xxhash.xxh3_64_intdigest(b.cut(lo, hi), seed=hi - lo)], np.uint64))
    if texts:
        yield _united(parts)


def _united(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _described(docs: DataFrame, p: Similar) -> DataFrame:
    """(rid, doc_id, n, sid, sid2) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = [], [], []
            for s in shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), p.gram):
                x, y = set_id(s)
                n.append(len(s))
                a.append(x)
                b.append(y)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["rid", "doc_id", "n", "sid", "sid2"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n long, sid long, sid2 long")


def _frequent(sets: DataFrame, p: Similar) -> np.ndarray:
    """Sorted hashes of tokens that are frequent in a sample of about ``p.sample`` sets, ``p.last`` at most."""
    keep = min(1.0, p.sample / max(sets.count(), 1))
    some = sets.where(F.pmod(F.xxhash64("sid"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)
    found = _dealt(some, lambda s: s, False).groupBy("token").count().where(F.col("count") >= p.frequent)
    rows = found.orderBy(F.desc("count"), "token").limit(p.last).select("token").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def prefix(s: np.ndarray, last: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a sorted set: any set that reaches ``percent`` with it shares one of them in its own prefix."""
    n = len(s) - -(-percent * len(s) // 100) + 1
    if len(last) and len(s):
        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
        late = last[at] == s
        if late.any():
            s = np.concatenate([s[~late], s[late]])
    return s[:n]


def banded(s: np.ndarray, last: np.ndarray, percent: int) -> np.ndarray:
    """A set's prefix under its size band and the next; sets whose sizes let them link share a band.

    A band is a little wider than the sizes that link, so rounding can't part them.
    """
    first = prefix(s, last, percent)
    band = int(math.log(max(1, len(s))) / (1.001 * math.log(100 / percent))) if percent < 100 else len(s)
    return np.concatenate([_mixed(first + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) for k in (band, band + 1)])


def _owned(docs: DataFrame, p: Similar) -> DataFrame:
    """(id, own): tokens below ``p.share`` of the hash range that stand in the set of this name (``sid``) alone, however many rows have that set."""
    cut = np.uint64(int(p.share * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 256):
                sets = list(shingle_sets(texts[lo : lo + 256], p.gram))
                part = [s[: int(np.searchsorted(s, cut))] for s in sets]
                names = np.array([set_id(s)[0] for s in sets], np.int64)
                yield pa.record_batch([pa.array(np.concatenate(part).view(np.int64)), pa.array(np.repeat(names, [len(s) for s in part]))], names=["token", "id"])

    return _alone(docs.select("text").mapInArrow(run, "token long, id long"))


def _alone(tokens: DataFrame) -> DataFrame:
    """(id, own): how many of its tokens no other id has."""
    ends = tokens.groupBy("token").agg(F.min("id").alias("id"), F.max("id").alias("top"))
    return ends.where("id = top").groupBy("id").agg(F.count("*").alias("own"))


def _dealt(sets: DataFrame, part, ids: bool) -> DataFrame:
    """(token, id) of ``part`` of each of ``sets`` (sid, tokens), without the id if ``ids`` is off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [part(np.frombuffer(t, np.uint64)) for t in batch.column(1).to_pylist()]
            cols = [pa.array(np.concatenate(found).view(np.int64))] if found else [pa.array([], pa.int64())]
            if ids:
                cols.append(pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])))
            yield pa.record_batch(cols, names=["token", "id"][: 1 + ids])

    return sets.select("sid", "tokens").mapInArrow(run, "token long" + ", id long" * ids)


def _candidates(docs: DataFrame, same: DataFrame, p: Similar) -> DataFrame:
    """(sid, n, tokens): each of the sets ``same`` (rid, n, sid) that has enough tokens in common with others to link, by the row that stands for it."""
    spare = lambda own: 100 * own <= (100 - p.percent) * F.col("n")
    first = stash(same.join(_owned(docs, p).withColumnRenamed("id", "sid"), "sid", "left").select("rid", "n", F.coalesce("own", F.lit(0)).alias("own")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = list(shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), p.gram))
                cols = [part.column(0), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.record_batch(cols, names=["rid", "n", "tokens"])

    texts = among(docs.select("rid", "text"), first.where(spare(F.col("own"))))
    sets = stash(texts.mapInArrow(run, "rid long, n long, tokens binary"))
    cut = np.uint64(int(p.share * 2**64))
    named = sets.withColumnRenamed("rid", "sid")
    more = _alone(_dealt(named, lambda s: s[int(np.searchsorted(s, cut)) :], True)).select(F.col("id").alias("rid"), F.col("own").alias("more"))
    passed = first.join(more, "rid", "left").where(spare(F.col("own") + F.coalesce("more", F.lit(0))))
    return stash(among(sets, passed).withColumnRenamed("rid", "sid"))


class Tree:
    """A signature tree over sets, and the traversal that links them."""

    def __init__(self, sets: list[np.ndarray], p: Similar, groups: list[int] | None = None) -> None:
        self.p = p
        # neighbours in this order share their least token, so leaves hold similar sets
        self.order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]) if len(sets[i]) else 0, len(sets[i])))
        self.sets = [sets[i] for i in self.order]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        words = p.bits // 64
        self.bits = np.zeros((len(sets), words), np.uint64)
        for i, s in enumerate(self.sets):
            b = s % np.uint64(p.bits)
            np.bitwise_or.at(self.bits[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        #: tokens that share a bit with another of their set
        self.hidden = self.n - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        #: sets with equal labels are linked already; ``groups`` has what is known at the start
        self.label = np.arange(len(sets)) if groups is None else np.array([groups[i] for i in self.order])
        self.links: list[tuple[int, int]] = []

    def join(self, left: int | None = None) -> list[tuple[int, int]]:
        """Spanning links between the sets; with ``left``, only those that pair the first ``left`` sets given with the others."""
        side = None if left is None else np.array([i < left for i in self.order])
        root = self._node(0, len(self.sets))
        stack = [(root, root)]
        while stack:
            a, b = stack.pop()
            if not self._possible(a, b):
                continue
            if a["children"] or b["children"]:
                if a is b:
                    c = a["children"]
                    stack += [(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))]
                elif a["children"] and (not b["children"] or a["hi"] - a["lo"] >= b["hi"] - b["lo"]):
                    stack += [(c, b) for c in a["children"]]
                else:
                    stack += [(a, c) for c in b["children"]]
            else:
                self._leaves(a, b, side)
        return [(self.order[i], self.order[j]) for i, j in self.links]

    def _node(self, lo: int, hi: int) -> dict:
        children = []
        if hi - lo > self.p.leaf:
            step = -(-(hi - lo) // self.p.fan)
            children = [self._node(k, min(k + step, hi)) for k in range(lo, hi, step)]
        own = slice(lo, hi)
        bits = np.bitwise_or.reduce([c["bits"] for c in children], axis=0) if children else np.bitwise_or.reduce(self.bits[own], axis=0)
        return {"lo": lo, "hi": hi, "children": children, "bits": bits, "least": int(self.n[own].min(initial=1 << 60)), "most": int(self.n[own].max(initial=0)), "hidden": int(self.hidden[own].max(initial=0))}

    def _possible(self, a: dict, b: dict) -> bool:
        """Can any set of one node link with one of the other that isn't in the same group yet?"""
        pct = self.p.percent
        if 100 * min(a["most"], b["most"]) < pct * max(a["least"], b["least"]):
            return False
        first = self.label[a["lo"]]
        if (self.label[a["lo"] : a["hi"]] == first).all() and (self.label[b["lo"] : b["hi"]] == first).all() and not (a is b and a["hi"] - a["lo"] == 1):
            return False
        overlap = int(np.bitwise_count(a["bits"] & b["bits"]).sum()) + min(a["hidden"], b["hidden"])
        return (100 + pct) * overlap >= pct * (a["least"] + b["least"])

    def _leaves(self, a: dict, b: dict, side: np.ndarray | None) -> None:
        i = np.arange(a["lo"], a["hi"])
        j = np.arange(b["lo"], b["hi"])
        overlap = np.bitwise_count(self.bits[i][:, None, :] & self.bits[j][None, :, :]).sum(axis=2).astype(np.int64)
        overlap += np.minimum(self.hidden[i][:, None], self.hidden[j][None, :])
        overlap = np.minimum(overlap, np.minimum(self.n[i][:, None], self.n[j][None, :]))
        pct = self.p.percent
        can = (100 + pct) * overlap >= pct * (self.n[i][:, None] + self.n[j][None, :])
        can &= (i[:, None] < j[None, :]) if a is b else True
        if side is not None:
            can &= side[i][:, None] != side[j][None, :]
        for x, y in np.argwhere(can).tolist():
            x, y = x + a["lo"], y + b["lo"]
            if self.label[x] != self.label[y] and self._linked(self.sets[x], self.sets[y]):
                self.links.append((x, y))
                self.label[self.label == self.label[y]] = self.label[x]

    def _linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * both >= self.p.percent * (len(x) + len(y) - both)


def _links(sets: DataFrame, tasks: DataFrame, p: Similar) -> DataFrame:
    """(a, b): spanning links within each of ``tasks`` (task, left, grp, sid), written down.

    ``left`` null: the sets of a task are joined with each other; else those on the left with the others.
    Sets with the same ``grp`` are linked already.
    """

    def run(table: pa.Table) -> pa.Table:
        by: dict[str, list[dict]] = {}
        for r in table.to_pylist():
            by.setdefault(r["task"], []).append(r)
        a, b = [], []
        for rows in by.values():
            rows.sort(key=lambda r: (r["left"] is not True, r["sid"]))
            left = sum(r["left"] is True for r in rows) if rows[0]["left"] is not None else None
            number: dict[int, int] = {}
            groups = [number.setdefault(r["grp"], len(number)) for r in rows]
            tree = Tree([np.frombuffer(r["tokens"], np.uint64) for r in rows], p, groups)
            for i, j in tree.join(left):
                a.append(rows[i]["sid"])
                b.append(rows[j]["sid"])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = tasks.count()
    n_tasks = max(1, rows // 300)
    # a list that is short on disk may be long in memory, so the number of rows decides whether the driver may hold it
    dealt = sets.select("sid", "tokens").join(tasks if rows <= BROADCAST_ROWS else tasks.hint("merge"), "sid").withColumn("shard", F.pmod(F.xxhash64("task"), F.lit(n_tasks)))
    return stash(dealt.select("shard", "task", "left", "grp", "sid", "tokens").groupBy("shard").applyInArrow(run, "a long, b long"))


def _task(*parts) -> Column:
    return F.concat_ws(":", *parts)


def _parted(sets: DataFrame, big: DataFrame, p: Similar) -> DataFrame:
    """(sid, n, fam): the families ``big`` (sid, n, fam) parted into smaller ones that no link crosses; sets that link with nothing are left out.

    Prefixes are as in ``prefix``, with the tokens that the fewest sets of the family have first. One that no other set of its
    family has needs no place in the shuffle: how many there are of these tells how much of the prefix they fill.
    """
    fam = big.select("sid", "n", "fam")
    tokens = _dealt(sets.join(fam.select("sid"), "sid", "left_semi"), lambda s: s, True).withColumnRenamed("id", "sid").join(fam.select("sid", "fam"), "sid")
    counted = tokens.withColumn("c", F.count("*").over(Window.partitionBy("fam", "token"))).where("c > 1")
    order = counted.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("order")).join(fam, "sid")
    n = F.col("n")
    first = n - F.ceil(p.percent * n / 100) + 1 - (n - F.size("order"))
    band = F.floor(F.log(n.cast("double")) / (1.001 * math.log(100 / p.percent))).cast("long") if p.percent < 100 else n
    shared = order.where(first > 0).select("sid", "fam", band.alias("band"), F.explode(F.slice("order", 1, first.cast("int"))).alias("t"))
    keys = stash(shared.select("sid", F.explode(F.array(*(F.xxhash64("fam", "t.token", F.col("band") + k) for k in (0, 1)))).alias("key")))
    ends = keys.groupBy("key").agg(F.min("sid").alias("b"), F.max("sid").alias("top")).where("b != top").select("key", "b")
    found = components(keys.join(stash(ends), "key").select(F.col("sid").alias("a"), "b"))
    return stash(fam.drop("fam").join(found.select(F.col("node").alias("sid"), F.col("root").alias("fam")), "sid"))


def _joined(sets: DataFrame, members: DataFrame, p: Similar) -> DataFrame:
    """(a, b): spanning links of all ``members`` (sid, n, fam) of families."""

    def divided(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Members of small families, those of large ones, and how many tokens these have."""
        counts = stash(rows.groupBy("fam").agg(F.sum("n").alias("size")))
        large = F.col("size") > p.family
        sized = rows.join(counts, "fam")
        return sized.where(~large), sized.where(large), counts.where(large).agg(F.sum("size")).first()[0] or 0

    alone = F.lit(None).cast("boolean").alias("left")
    small, sized, size = divided(members)
    before = math.inf
    while size and size < 0.9 * before:
        before = size
        less, sized, size = divided(_parted(sets, sized, p))
        small = small.select("sid", "fam").unionByName(less.select("sid", "fam"))
    links = _links(sets, stash(small.select(F.col("fam").cast("string").alias("task"), alone, F.col("sid").alias("grp"), "sid")), p)
    if not size:
        return links
    # sets that link differ in size by 100 / percent at most, which is so many steps of 15 percent
    reach = math.floor(math.log(100 / p.percent) / math.log(1.15)) + 1
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.15))).cast("int")
    big = stash(sized.select("sid", "n", "fam", step.alias("step"), F.col("sid").alias("grp")))
    block = max(1, p.family // 2)
    for turn in (0, 1):
        band = F.floor((F.col("step") + 2 * turn) / 4).cast("int")
        rows = big.withColumn("band", band)
        parts = stash(rows.groupBy("fam", "band").agg(F.ceil(F.sum("n") / block).cast("long").alias("parts")))
        part = F.pmod(F.xxhash64("sid", F.lit(turn)), F.col("parts"))
        links = links.unionByName(_links(sets, stash(rows.join(parts, ["fam", "band"]).select(_task("fam", "band", part).alias("task"), alone, "grp", "sid")), p))
        big = _grouped(big, links)
    most = big.groupBy("fam", "grp").count().groupBy("fam").agg(F.max(F.struct("count", "grp"))["grp"].alias("main"))
    big = stash(big.join(stash(most), "fam").withColumn("rest", F.col("grp") != F.col("main")).drop("main"))
    return links.unionByName(_links(sets, stash(_pairs(big, reach, block)), p))


def _grouped(big: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links)
    return stash(big.join(comp.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "n", "fam", "step", F.coalesce("root", "sid").alias("grp")))


def _pairs(big: DataFrame, reach: int, block: int) -> DataFrame:
    """(task, left, grp, sid): blocks of the ``rest`` of each family against each other and against blocks of its main group, by compatible size."""
    parts = big.groupBy("fam", "rest", "step").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    #: the steps of a family with their numbers of parts are a short list: sizes up to 1.15 ** 300
    around = stash(parts.groupBy("fam").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("rest", "step"), "parts"))).alias("parts")))
    dealt = big.join(around, "fam")
    own = F.element_at("parts", F.struct("rest", "step"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("sid"), own.cast("long")).cast("int"))

    def others(rest: bool):
        key = lambda s: F.struct(F.lit(rest).alias("rest"), s.alias("step"))
        count = lambda s: F.coalesce(F.try_element_at("parts", key(s)), F.lit(0))
        numbers = lambda s: F.when(count(s) > 0, F.sequence(F.lit(0), count(s) - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(F.sequence(F.col("step") - reach, F.col("step") + reach), lambda s: F.transform(numbers(s), lambda k: F.struct(F.lit(rest).alias("rest"), s.alias("step"), k.alias("part")))))

    # a block of the rest meets all blocks; one of the main group meets those of the rest only
    met = F.when(F.col("rest"), F.concat(others(True), others(False))).otherwise(others(True))
    paired = dealt.withColumn("other", F.explode(met)).withColumn("own", F.struct("rest", "step", "part"))
    name = lambda x: F.concat_ws(".", x["rest"].cast("string"), x["step"], x["part"])
    same = F.col("own") == F.col("other")
    return paired.select(
        _task("fam", name(F.least("own", "other")), name(F.greatest("own", "other"))).alias("task"), F.when(~same, F.col("own") < F.col("other")).alias("left"), "grp", "sid"
    )


def ngram_components(docs: DataFrame, p: Similar = Similar()) -> DataFrame:
    """One row per document: rid, doc_id, n_shingles, component_id, root.

    ``root`` is the component's own key, whatever ids its rows have; null for an empty set.
    ``component_id`` is the smallest ``doc_id`` that links reach. Equal sets always link, but a
    document without words, or with a null text, has an empty set and links with nothing: its
    component is its own id. Null ids are no candidates for ``component_id`` (null only if all
    are null); repeated rows are in one component. Any length of text is taken whole; an empty
    table gives no rows; other columns are left out.
    """
    rows = numbered(docs)
    facts = stash(_described(rows, p))
    # one row stands for each set; written down, so that joins with it deal their other side anew and can split a hot key
    same = stash(facts.where("n > 0").groupBy("sid", "sid2").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.count("*").alias("rows")))
    sets = _candidates(rows, same.select("rid", "n", "sid"), p)
    last = _frequent(sets, p)
    tokens = _dealt(sets, lambda s: banded(s, last, p.percent), True)
    ends = stash(tokens.groupBy("token").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b != top").select("token", "b"))
    fams = components(tokens.join(ends, "token").select(F.col("id").alias("a"), "b"))
    members = stash(sets.select("sid", "n").join(fams.select(F.col("node").alias("sid"), F.col("root").alias("fam")), "sid"))
    comp = components(_joined(sets, members, p)).select(F.col("node").alias("rid"), "root")
    shared = stash(same.join(comp, "rid", "left").where("rows > 1 or root is not null").select("sid", "sid2", F.coalesce("root", "rid").alias("root")))
    named = facts.where("n > 0").join(shared, ["sid", "sid2"], "left").withColumn("root", F.coalesce("root", "rid"))
    ids = stash(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    found = named.join(ids, "root").select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "root")
    none = F.lit(None).cast("long").alias("root")
    return found.unionByName(facts.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none))
