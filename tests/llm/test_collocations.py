"""Collocations against plain counting of all n-grams."""

import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import collocations, repeats
from lexiflow.llm.collocations import Phrases


def plain(docs: list[tuple], p: Phrases) -> set:
    grams, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^\\x20\\x09]+", piece)
            total[lang] += len(w)
            grams[lang].update(tuple(w[i : i + k]) for k in range(1, p.longest + 1) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in grams.items():
        often = {g: a for g, a in f.items() if a >= p.least and len(g) > 1}
        rows = []
        for g, a in often.items():
            within = lambda d, g=g: any(d[i : i + len(g)] == g for i in range(len(d) - len(g) + 1))
            if any(len(d) > len(g) and 100 * b >= p.share * a and within(d) for d, b in often.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        out |= {(lang, k + 1, g.decode(), -a, left, right, total[lang], -s) for k, (s, a, g, left, right) in enumerate(sorted(rows)[: p.best])}
    return out


def awkward() -> list[tuple]:
    r = random.Random(6)
    words = ["the", "of", "Of", "a", "b", "c", "é", "ß", "x y", "\x00", "end"]
    docs = [("en", None), ("en", ""), (None, " \t\n"), ("fr", ".,;"), ("en", "a" * 5000), (None, "und und und und"), ("", "b a b a b a")]
    for k in range(150):
        w = [r.choice(words) + r.choice(["", "", "", "", ",", ".", "!\n", "\t", " \r\n"]) for _ in range(r.randint(0, 60))]
        docs.append((r.choice(["en", "en", "de", None]), " ".join(w) + r.choice(["", " in the very same long phrase. The Very same", "the the the the the the"])))
    return docs + docs[-3:]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, 1, "f", "w", 2) for x in awkward()], "lang string, text string, n int, f string, word string, rank int")


SMALL = Phrases(least=5, best=40)


@pytest.mark.parametrize("change", [{"hot": 7}, {"listed": 4, "hot": 3, "shard": 50}, {"window": 20, "shard": 100}, {"longest": 3, "best": 5}, {"share": 60, "least": 2}])
def test_against_plain_counts(docs, change):
    """Pivots over many shards, words beyond the list, small windows: all give the counts of a plain search."""
    p = replace(SMALL, **change)
    rows = collocations.collocations(docs, p).collect()
    assert {tuple(r) for r in rows} == plain(awkward(), p)
    assert len(rows) > 10 and list(rows[0].asDict()) == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_nothing_frequent(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, Phrases(least=10**6)).count() == 0


def test_fragments_own_each_ngram_once():
    """Mining the fragments gives each n-gram's count, under one pivot."""
    r = np.random.default_rng(1)
    p = Phrases(least=1)
    for _ in range(30):
        w = r.integers(0, 6, 80)
        rows, n = collocations.fragments(w, 5)
        got = Counter()
        for grams, counts in collocations.mined(rows, n, np.zeros(rows.shape[1], bool), p):
            for g, f in zip(grams.tolist(), counts.tolist(), strict=True):
                assert tuple(g) not in got
                got[tuple(g)] = f
        want = Counter(g for k in range(2, 6) for i in range(len(w) - k + 1) if min(g := tuple(w[i : i + k].tolist())) > 0)
        assert got == want


def test_equal_hashes_keep_fragments_apart(monkeypatch):
    w = np.array([1, 2, 1, 3, 2, 0, 3, 1])
    rows, n = collocations.fragments(w, 3)
    monkeypatch.setattr(collocations, "mixed", lambda h: h & np.uint64(0))
    same, m = collocations.fragments(w, 3)
    assert sorted(zip(map(tuple, rows.T.tolist()), n.tolist(), strict=True)) == sorted(zip(map(tuple, same.T.tolist()), m.tolist(), strict=True))


def test_long_text_in_segments(spark, monkeypatch):
    """A piece isn't parted where a long text is."""
    text = "to be or not to be " * 3000
    docs = spark.createDataFrame([("en", text)], "lang string, text string").withColumn("doc_id", F.lit(1))
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    parts = list(collocations.pieces(text.encode()))
    assert len(parts) > 1 and [w for x in parts for w in x] == text.encode().split()
    assert {tuple(r) for r in collocations.collocations(docs).collect()} == plain([("en", text)], Phrases())


def test_exact_beyond_64_bits(spark):
    """Scores come from decimals: their products may pass 64 bits."""
    row = spark.range(1).select(F.expr("(cast(3000000000 as decimal(15, 0)) * cast(900000000000 as decimal(15, 0)) * cast(1000 as decimal(4, 0))) div (cast(3000000007 as decimal(15, 0)) * cast(3000000011 as decimal(15, 0)))").alias("x")).first()
    assert row.x == 3_000_000_000 * 900_000_000_000 * 1000 // (3_000_000_007 * 3_000_000_011)
