"""The chosen-path join against all pairs, on families of near copies."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import chosen_path
from lexiflow.llm.chosen_path import Paths
from tests.llm import brute


def texts() -> list[tuple]:
    """(doc_id, text): unlike texts, families of near copies around the threshold, copies of other case, chains."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "x" * 20_000), (6, "two words"), (7, "ab " * 2000)]
    at = 10
    for family in range(12):
        base = text(r.choice([3, 12, 60, 200]))
        for _ in range(8):
            w = base[:]
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = word()
            out.append((at, " ".join(w).upper() if r.random() < 0.2 else " \n".join(w)))
            at += 1
        if family % 3 == 0:  # a chain: each links with the next only
            w = base[:]
            for _ in range(6):
                w = w[len(w) // 16 :] + text(len(w) // 16)
                out.append((at, " ".join(w)))
                at += 1
    out += [(at + k, " ".join(text(r.randint(1, 150)))) for k in range(120)]
    return out


SCHEMA = "doc_id long, text string, rid string, root string, kept int, sketch string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "a", "b", 1, "c") for x in texts()], SCHEMA).coalesce(1)


@pytest.mark.parametrize("change", [{}, {"depth": 1, "deepest": 3, "small": 2, "chunk": 5, "most": 1}])
def test_components(docs, change):
    """Any way of branching and dealing gives the links of a plain search."""
    p = replace(Paths(), **change)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.chosen_path_components(docs, p).collect()}
    want = brute.components(texts(), 80, 2)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 30


def test_ids(spark):
    """Null ids, repeated rows and ids, an empty table."""
    a, b = "some words that stand here more than once or twice", "quite other words are in this one and no more of them"
    rows = [(None, a), (None, b), (None, b), (7, a), (7, a), (9, b + " ."), (9, a), (8, None), (None, "")]
    docs = spark.createDataFrame([(*x, "a", "b", 1, "c") for x in rows], SCHEMA)
    got = chosen_path.chosen_path_components(docs)
    assert sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in got.collect()), key=str) == sorted(
        [(None, 7, 9, False), (None, 9, 11, False), (None, 9, 11, False), (7, 7, 9, True), (7, 7, 9, True), (9, 9, 12, True), (9, 7, 9, False), (8, 8, 0, True), (None, None, 0, True)], key=str
    )
    assert chosen_path.chosen_path_components(docs.limit(0)).count() == 0


def test_recall_of_the_trees():
    """Sketches alone bring together what the module states: pairs at the threshold share a node."""
    p, r = Paths(), np.random.default_rng(8)
    assert 0.64 < 1 - (1 - p.kept_by(0.8)) ** (1 / p.trees) < 0.65 and p.kept_by(0.8) > 1 - 1e-8
    met, n = 0, 400
    for _ in range(n):
        both = r.integers(0, 1 << 63, 160, dtype=np.uint64)
        x, y = (np.concatenate([both, r.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(2))  # 160 of 200
        s = np.stack([chosen_path.sketch(v, p.values) for v in (x, y)])
        nodes = []
        for own in s:
            row, node = np.arange(p.trees), chosen_path.mixed(np.arange(1, p.trees + 1, dtype=np.uint64))
            for _ in range(p.depth):
                k, node = chosen_path.branches(node, np.repeat(own[None], len(row), axis=0), p)
                row = row[k]
            nodes.append(set(node.tolist()))
        met += bool(nodes[0] & nodes[1])
    assert met == n


def test_large_family_is_not_compared_with_itself(spark, monkeypatch):
    """A family of n sets asks for n confirmations, not for their square."""
    r = random.Random(2)
    asked = []
    for n in (150, 600):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        rows = []
        for k in range(n):
            w = base[:]
            w[r.randrange(len(w))] = f"own{k}"
            rows.append((k, " ".join(w)))
        seen = []
        confirmed = chosen_path._confirmed

        def counting(docs, pairs, p, seen=seen, confirmed=confirmed):
            seen.append(pairs.count())
            return confirmed(docs, pairs, p)

        monkeypatch.setattr(chosen_path, "_confirmed", counting)
        got = chosen_path.chosen_path_components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got.select("component_id").distinct().count() == 1
        monkeypatch.setattr(chosen_path, "_confirmed", confirmed)
        asked.append(sum(seen))
    assert asked[0] < 2 * 150 and asked[1] < 2 * 600


def test_long_text_as_a_whole(spark):
    w = [f"w{k}" for k in range(250_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-30_000])), (3, " ".join(w[:-60_000] + [f"v{k}" for k in range(60_000)]))]
    got = chosen_path.chosen_path_components(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 249_999, 1), (2, 219_999, 1), (3, 249_999, 3)]


def test_texts_are_fetched_twice_whatever_the_levels(docs, monkeypatch):
    """Levels below the first, and dense regions, read the candidates' texts and not the table again."""
    fetched, levels, fetch, branched = [], [], chosen_path._texts, chosen_path._branched
    monkeypatch.setattr(chosen_path, "_texts", lambda *a: fetched.append(1) or fetch(*a))
    monkeypatch.setattr(chosen_path, "_branched", lambda *a: levels.append(1) or branched(*a))
    rows = chosen_path.numbered(docs)
    whole, asked = [], chosen_path._confirmed
    monkeypatch.setattr(chosen_path, "_confirmed", lambda have, *a: whole.append(have is rows) or asked(have, *a))
    monkeypatch.setattr(chosen_path, "numbered", lambda _: rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.chosen_path_components(docs, replace(Paths(), depth=1, deepest=4, small=2, chunk=5, most=1)).collect()}
    assert got == brute.components(texts(), 80, 2)
    assert len(levels) >= 2 and len(fetched) == 2 and not any(whole)
