"""Near-duplicates by MinHash: a set similarity join over chosen paths.

A document's set has the hashes of its word n-grams, and a sketch of ``values`` minwise tokens: the
token that comes first under each of so many hash functions. In each of ``trees`` independent trees a set
branches by minwise tokens: at a node, functions are chosen by the node's name, one always and another one in
four (1.25 on average for a threshold of 80 percent), and the set goes on to the child that its
token under that function names. Sets that link agree on a token with the chance of their
similarity, so the paths that they share don't die out on average, and those of different sets do. Nodes are names
only: a set tells all its nodes from its sketch, so levels need no data but counts.

Trees have ``depth`` levels. What shares a node then is settled in three steps:

1. Every set is matched with the first set of its nodes that its sketch finds similar, one pair a set. The pairs
   are confirmed on the full sets, and links give groups. So a large family of copies hangs together
   after work in proportion to its size, and is never compared with itself.
2. In a node that holds several groups yet, the sets outside of its largest group (its rest) are compared
   exhaustively with all of the node, by sketches. The sketches' bar is ``slack`` standard deviations below what the threshold
   gives. Each set's ``most`` most similar pairs are confirmed on full sets; what links is one group from then on and
   asks for nothing more. Sets that have yet more similar sets of other groups (families whose
   copies are just too unlike to link) meet those with their full sets at hand, block by block, so no pairs are written down.
3. Nodes whose rest is over ``small`` sets branch one level further, to steps 1 and 2 again. Below
   ``deepest`` levels the rest is dealt in blocks of ``small`` sets, so nothing is cut off.

Recall: with similarity s, a tree keeps a pair to the next level with chance 1 - E[(1 - s (1 - miss))^children].
``kept_by`` works that out; for the defaults at 80 percent it is 0.64 a tree and all but 1e-9 over 20 trees, were they
independent; as they share the sketch's 128 functions, and the bar loses 3e-6, it is more like 1 - 1e-5. More similar pairs are safer yet, and a document
is lost only if all its links are.

Scale: sketches are 512 bytes a set and equal sets count once; a sketch stays where it is, and what is compared in a node has a
byte of each of its values. Two shuffles of (node, set) names, 16 bytes each; text moves by row number, only of sets that are to be confirmed. Blocks of ``chunk`` sets bound what a task compares, and pairs
with one set in common are dealt to tasks of ``chunk`` pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import numbered
from lexiflow.llm.graph import LISTED, among, components
from lexiflow.llm.ngram_join import set_id, shingle_sets
from lexiflow.session import stash


@dataclass(frozen=True)
class Paths:
    """``gram`` words a shingle, links from ``percent`` of the union; the others as the module tells."""

    gram: int = 2
    percent: int = 80
    values: int = 128
    trees: int = 20
    depth: int = 3
    deepest: int = 10
    small: int = 1024
    chunk: int = 2048
    slack: float = 4.5
    most: int = 4

    @property
    def bar(self) -> int:
        """So many minwise tokens of two sets agree at least, if they link."""
        s = self.percent / 100
        return max(1, int(self.values * s - self.slack * (self.values * s * (1 - s)) ** 0.5))

    def kept_by(self, similarity: float, depth: int | None = None) -> float:
        """The chance that a pair of that similarity shares a node of some tree."""
        second, miss = 100 / self.percent - 1, 0.0
        for _ in range(self.depth if depth is None else depth):
            out = 1 - similarity * (1 - miss)
            miss = (1 - second) * out + second * out * out
        return 1 - miss**self.trees


_RNG = np.random.default_rng(12)
XORS, FACTORS = (_RNG.integers(1, 1 << 32, 1024, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(s: np.ndarray, values: int) -> np.ndarray:
    """The first token of a set under each of ``values`` hash functions, as its hash of 32 bits."""
    s = (s >> np.uint64(32)).astype(np.uint32)
    x, f = XORS[:values, None], FACTORS[:values, None]
    least = np.full(values, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(s), 512):
        least = np.minimum(least, ((s[lo : lo + 512] ^ x) * f).min(axis=1))
    return least


def branches(node: np.ndarray, sketches: np.ndarray, p: Paths) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of sets at ``node`` with their ``sketches``, a row each."""
    rows, children = [], []
    second = np.uint64(int((100 / p.percent - 1) * 2**64))
    for turn in (1, 2):
        named = mixed(node + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64))
        own = np.arange(len(node)) if turn == 1 else np.flatnonzero(mixed(named) < second)
        at = (named[own] % np.uint64(p.values)).astype(np.int64)
        token = sketches[own, at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(32))
        rows.append(own)
        children.append(mixed(named[own] ^ mixed(token)))
    return np.concatenate(rows), np.concatenate(children)


def _described(docs: DataFrame, p: Paths) -> DataFrame:
    """(rid, doc_id, n, sid, sid2, sketch, marks) of each document; ``marks``: a byte of each of the sketch's values, enough to compare by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                n, a, b, k, m = [], [], [], [], []
                for s in shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), p.gram):
                    x, y = set_id(s)
                    n.append(len(s))
                    a.append(x)
                    b.append(y)
                    values = sketch(s, p.values) if len(s) else None
                    k.append(None if values is None else values.tobytes())
                    m.append(None if values is None else values.astype(np.uint8).tobytes())
                columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n, a, b)), pa.array(k, pa.binary()), pa.array(m, pa.binary())]
                yield pa.record_batch(columns, names=["rid", "doc_id", "n", "sid", "sid2", "sketch", "marks"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n long, sid long, sid2 long, sketch binary, marks binary")


def _matrix(column: pa.Array, values: int, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, values)


def _planted(sets: DataFrame, p: Paths) -> DataFrame:
    """(node, sid): the nodes of each of ``sets`` (sid, sketch) at ``depth`` in all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = _matrix(batch.column(1), p.values)
            for root in mixed(np.arange(1, p.trees + 1, dtype=np.uint64)):
                row, node = np.arange(batch.num_rows), np.full(batch.num_rows, root)
                for _ in range(p.depth):
                    own, node = branches(node, sketches[row], p)
                    row = row[own]
                yield pa.record_batch([pa.array(node.view(np.int64)), batch.column(0).take(pa.array(row))], names=["node", "sid"])

    return sets.select("sid", "sketch").mapInArrow(run, "node long, sid long")


def _branched(crowded: DataFrame, sets: DataFrame, p: Paths) -> DataFrame:
    """(node, sid): the children of ``crowded`` (node, sid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, node = branches(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), _matrix(batch.column(2), p.values), p)
            yield pa.record_batch([pa.array(node.view(np.int64)), batch.column(1).take(pa.array(row))], names=["node", "sid"])

    return crowded.join(sets.select("sid", "sketch"), "sid").select("node", "sid", "sketch").mapInArrow(run, "node long, sid long")


def _first_alike(members: DataFrame, sets: DataFrame, p: Paths) -> DataFrame:
    """(a, b): for each set b the first set a of its nodes that its sketch finds similar, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(4), p.values, np.uint8) == _matrix(batch.column(5), p.values, np.uint8)).sum(axis=1)
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            good = (same >= p.bar) & (100 * np.minimum(n, m) >= p.percent * np.maximum(n, m))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    pairs = members.where("sid != first").select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct()
    one = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"marks_{c}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "n_a", "n_b", "marks_a", "marks_b")
    return both.mapInArrow(run, "a long, b long").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def _compared(rows: DataFrame, sets: DataFrame, p: Paths) -> DataFrame:
    """(a, b, crowded): pairs of different groups that their sketches find similar, from ``rows`` (node, sid, grp, rest, chunks, blocks).

    In each node the rest meets all: a block of the rest and a chunk of the node are one task. A set of the rest gives its ``p.most`` most similar
    pairs of a task; where it has others, ``crowded`` (one of the pair, else null) tells it.
    """
    part = lambda of: F.pmod(F.xxhash64("sid"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = rows.where("rest").withColumns({"block": part("blocks"), "left": F.lit(True)}).withColumn("chunk", every("chunks"))
    right = rows.withColumns({"chunk": part("chunks"), "left": F.lit(False)}).withColumn("block", every("blocks"))
    both = left.unionByName(right).select("sid", "grp", "left", F.xxhash64("node", "block", "chunk").alias("task"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("task").combine_chunks()
        task, sid, grp, n, left = (table[c].to_numpy() for c in ("task", "sid", "grp", "n", "left"))
        marks = _matrix(table["marks"], p.values, np.uint8)
        found: set[tuple] = set()
        edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = np.arange(lo, hi)
            others = own[~left[lo:hi]]
            for k in own[left[lo:hi]].tolist():
                fit = others[(grp[others] != grp[k]) & (100 * np.minimum(n[others], n[k]) >= p.percent * np.maximum(n[others], n[k]))]
                same = (marks[fit] == marks[k]).sum(axis=1)
                good = np.flatnonzero(same >= p.bar)
                order = good[np.lexsort((sid[fit[good]], -same[good]))][: p.most]
                own_sid = int(sid[k])
                found |= {(min(x, own_sid), max(x, own_sid), own_sid if len(good) > p.most else None) for x in sid[fit[order]].tolist()}
        cols = list(zip(*found, strict=True)) or [()] * 3
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "crowded"), cols, strict=True)})

    n_tasks = max(1, rows.count() // 8192)
    dealt = both.join(sets.select("sid", "n", "marks"), "sid").withColumn("shard", F.pmod("task", F.lit(n_tasks)))
    found = dealt.select("shard", "task", "sid", "grp", "left", "n", "marks").groupBy("shard").applyInArrow(run, "a long, b long, crowded long")
    return found.distinct()


def _texts(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """(rid, text) of ``rids`` (sid, each once), written down."""
    return stash(among(docs.select("rid", "text"), rids.select(F.col("sid").alias("rid"))))


def _dealt(docs: DataFrame, tasks: DataFrame, n_tasks: int, p: Paths) -> DataFrame:
    """(shard, task, left, grp, rid, tokens): the full sets of ``tasks`` (rid, task, left, grp), whose texts ``docs`` has."""
    asked = tasks.groupBy("rid").agg(F.collect_list(F.struct("task", "left", "grp")).alias("tasks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                for rid, tasks, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), p.gram), strict=True):
                    tokens = s.tobytes()
                    for own in (tasks[lo : lo + 64] for lo in range(0, len(tasks), 64)):
                        task, left, grp = ([t[c] for t in own] for c in ("task", "left", "grp"))
                        cols = [pa.array([t % n_tasks for t in task], pa.int64()), pa.array(task, pa.int64()), pa.array(left, pa.bool_()), pa.array(grp, pa.int64())]
                        yield pa.record_batch([*cols, pa.array([rid] * len(own), pa.int64()), pa.array([tokens] * len(own), pa.binary())], names=["shard", "task", "left", "grp", "rid", "tokens"])

    texts = docs.select("rid", "text").join(asked.hint("broadcast" if tasks.count() <= LISTED else "merge"), "rid").select("rid", "text", "tasks")
    return texts.mapInArrow(cut, "shard long, task long, left boolean, grp long, rid long, tokens binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, p: Paths) -> DataFrame:
    """(a, b): the ``pairs`` that link by their full sets, written down."""
    pairs = stash(pairs)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.chunk).cast("long").alias("parts"))
    task = lambda part: F.xxhash64("a", part).alias("task")
    grp = F.lit(None).cast("long").alias("grp")
    firsts = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.col("a").alias("rid"), task(F.col("part")), F.lit(True).alias("left"), grp)
    others = pairs.join(parts, "a").select(F.col("b").alias("rid"), task(F.pmod(F.xxhash64("b"), F.col("parts"))), F.lit(False).alias("left"), grp)

    def run(table: pa.Table) -> pa.Table:
        first: dict[int, tuple] = {}
        a, b = [], []
        rows = list(zip(*(table[c].to_pylist() for c in ("task", "left", "rid", "tokens")), strict=True))
        for task, left, rid, tokens in rows:
            if left:
                first[task] = rid, np.frombuffer(tokens, np.uint64)
        for task, left, rid, tokens in rows:
            if not left:
                own, x = first[task]
                if linked(x, np.frombuffer(tokens, np.uint64), p.percent):
                    a.append(own)
                    b.append(rid)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = _dealt(docs, firsts.unionByName(others), max(1, pairs.count() // 500), p)
    return stash(dealt.groupBy("shard").applyInArrow(run, "a long, b long"))


def _settled(docs: DataFrame, rows: DataFrame, crowded: DataFrame, p: Paths) -> DataFrame:
    """(a, b): links of the sets ``crowded`` (sid) with others in nodes of ``rows`` (node, sid, size, grp), written down.

    Nodes that have a crowded set in common are one region; its crowded sets meet all of it, block by chunk, with their full sets at hand, so
    only links leave a task. What is linked is one group within a task too.
    """
    shared = stash(rows.join(crowded, "sid", "left_semi").select("node").distinct())
    own = rows.join(shared, "node").join(crowded.withColumn("crowded", F.lit(True)), "sid", "left")
    own = stash(own.select("node", "sid", "grp", F.col("n"), F.coalesce("crowded", F.lit(False)).alias("crowded")))
    first = own.groupBy("node").agg(F.min("sid").alias("b"))
    region = components(own.join(first, "node").select(F.col("sid").alias("a"), "b")).select(F.col("node").alias("sid"), F.col("root").alias("region"))
    sets = stash(own.drop("node").distinct().join(region, "sid"))
    tokens = 4_000_000
    of = lambda n, size, most: F.greatest(F.ceil(n / most), F.ceil(size / tokens)).cast("long")
    c = F.col("crowded")
    sizes = sets.groupBy("region").agg(of(F.count("*"), F.sum("n"), p.chunk).alias("chunks"), F.greatest(F.lit(1), of(F.count_if(c), F.sum(F.when(c, F.col("n")).otherwise(0)), p.small)).alias("blocks"))
    sized = sets.join(sizes, "region")
    part = lambda of: F.pmod(F.xxhash64("sid"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = sized.where(c).withColumns({"block": part("blocks"), "left": F.lit(True)}).withColumn("chunk", every("chunks"))
    right = sized.withColumns({"chunk": part("chunks"), "left": F.lit(False)}).withColumn("block", every("blocks"))
    tasks = stash(left.unionByName(right).select(F.col("sid").alias("rid"), F.xxhash64("region", "block", "chunk").alias("task"), "left", "grp"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("task").combine_chunks()
        task, left, grp, rid = (table[c].to_numpy() for c in ("task", "left", "grp", "rid"))
        sets = [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
        n = np.array([len(s) for s in sets])
        marks = np.stack([sketch(s, p.values).astype(np.uint8) for s in sets])
        a, b = [], []
        edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = np.arange(lo, hi)
            others = own[~left[lo:hi]]
            root: dict[int, int] = {}

            def find(g: int, root: dict = root) -> int:
                while root.get(g, g) != g:
                    root[g] = root.get(root[g], root[g])
                    g = root[g]
                return g

            for k in own[left[lo:hi]].tolist():
                fit = others[(grp[others] != grp[k]) & (100 * np.minimum(n[others], n[k]) >= p.percent * np.maximum(n[others], n[k]))]
                for x in fit[(marks[fit] == marks[k]).sum(axis=1) >= p.bar].tolist():
                    g, h = find(int(grp[k])), find(int(grp[x]))
                    if g != h and linked(sets[k], sets[x], p.percent):
                        root[g] = h
                        a.append(int(rid[k]))
                        b.append(int(rid[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    n_tasks = tasks.select("task").distinct().count()
    return stash(_dealt(docs, tasks, max(1, n_tasks), p).groupBy("shard").applyInArrow(run, "a long, b long"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sorted sets reach the threshold?"""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _hung(links: DataFrame) -> DataFrame:
    """(sid, root): what each linked set hangs on, by its least partner and two steps further. Sets with one root hang together; not all that do have one root yet."""
    least = stash(links.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("sid")).groupBy("sid").agg(F.min("root").alias("root")))
    hung, few = least, least.count() <= LISTED
    for _ in range(2):
        up = least.select(F.col("sid").alias("root"), F.col("root").alias("next"))
        hung = hung.join(up.hint("broadcast") if few else up, "root", "left").select("sid", F.coalesce("next", "root").alias("root"))
    return hung.hint("broadcast") if few else hung


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """(node, sid, size, grp, rest, n_rest): the members of nodes that hold several groups yet; ``rest``: outside of the node's largest group.

    Groups are known links as ``_hung`` has them; they only save work, so they needn't be whole components.
    """
    grouped = stash(members.join(_hung(links), "sid", "left").select("node", "sid", "size", F.coalesce("root", "sid").alias("grp")))
    open_ = grouped.groupBy("node").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo != hi").select("node")
    counts = grouped.join(open_, "node").groupBy("node", "grp").agg(F.count("*").alias("own"))
    main = counts.groupBy("node").agg(F.max(F.struct("own", "grp")).alias("main"), F.sum("own").alias("all"))
    main = stash(main.select("node", F.col("main.grp").alias("main"), (F.col("all") - F.col("main.own")).alias("n_rest")))
    return stash(grouped.join(main, "node").withColumn("rest", F.col("grp") != F.col("main")).drop("main"))


def _either(pairs: DataFrame) -> DataFrame:
    """(sid): the sets of ``pairs`` (a, b), each once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()


def _links(docs: DataFrame, sets: DataFrame, p: Paths) -> DataFrame:
    """(a, b): links of ``sets`` (sid, n, sketch) that join all sets that links join."""
    nodes, depth = _planted(sets, p), p.depth
    links = tried = texts = seen = dense = None
    add = lambda x, y: y if x is None else x.unionByName(y)
    while True:
        shared = stash(nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("sid").alias("first")).where("size > 1"))
        members = stash(nodes.join(shared, "node"))
        asked = stash(_first_alike(members, sets, p))
        top = texts is None
        if top:
            texts = _texts(docs, _either(asked))
        links, tried = add(links, _confirmed(texts, asked, p)), add(tried, asked)
        sized = _open(members, links)
        now = F.col("n_rest") <= p.small if depth < p.deepest else F.lit(True)
        chunks, blocks = F.ceil(F.col("size") / p.chunk).cast("long"), F.ceil(F.col("n_rest") / p.small).cast("long")
        rows = stash(sized.where(now).select("node", "sid", "grp", "rest", chunks.alias("chunks"), blocks.alias("blocks")))
        found = stash(_compared(rows, sets, p))
        fresh = stash(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        busy = stash(found.where("crowded is not null").select(F.col("crowded").alias("sid")).distinct())
        region = stash(rows.join(rows.join(busy, "sid", "left_semi").select("node").distinct(), "node", "left_semi").select("node", "sid"))
        crowded = stash(sized.where(~now).select("node", "sid"))
        if top:
            # whatever this level and those below ask for: texts are fetched twice, however many levels follow
            later = _either(fresh).unionByName(region.select("sid")).unionByName(crowded.select("sid")).distinct()
            texts = texts.unionByName(_texts(docs, later.join(_either(asked), "sid", "left_anti")))
        links, tried = links.unionByName(_confirmed(texts, fresh, p)), tried.unionByName(fresh)
        seen, dense = add(seen, region), add(dense, busy)
        if crowded.isEmpty():
            break
        nodes, depth = _branched(crowded, sets, p), depth + 1
    # families whose copies are just too unlike to link leave few links, so those of all levels are settled at once
    dense = stash(dense.distinct())
    if dense.isEmpty():
        return links
    return links.unionByName(_settled(texts, _open(seen.withColumn("size", F.lit(0)), links).join(sets.select("sid", "n"), "sid"), dense, p))


def chosen_path_components(docs: DataFrame, p: Paths = Paths()) -> DataFrame:
    """One row per document: rid, doc_id, n_shingles, component_id, root, kept.

    Links are confirmed on full sets of 64-bit shingle hashes; ``root`` is the component's own key, whatever ids
    its rows have (null for an empty set), ``component_id`` the smallest ``doc_id`` that links reach, ``kept`` whether
    that is the row's own. Equal sets always link, but a document without words, or with a null text, has an
    empty set, links with nothing and is kept. Null ids are no candidates for ``component_id``, which is null only if
    all are, and a row with a null id is kept only then; repeated rows are in one component. Any length
    of text is taken whole; an empty table gives no rows; other columns are left out.
    """
    rows = numbered(docs)
    facts = stash(_described(rows, p))
    same = stash(facts.where("n > 0").groupBy("sid", "sid2").agg(F.min("rid").alias("rid"), F.count("*").alias("rows")))
    sets = among(facts.select("rid", "n", "sketch", "marks"), same).withColumnRenamed("rid", "sid")
    comp = components(_links(rows, sets, p)).select(F.col("node").alias("rid"), "root")
    shared = stash(same.join(comp, "rid", "left").where("rows > 1 or root is not null").select("sid", "sid2", F.coalesce("root", "rid").alias("root")))
    told = facts.drop("sketch", "marks")
    named = told.where("n > 0").join(shared, ["sid", "sid2"], "left").withColumn("root", F.coalesce("root", "rid"))
    ids = stash(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    found = named.join(ids, "root").select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "root")
    none = F.lit(None).cast("long").alias("root")
    empty = told.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none)
    return found.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
