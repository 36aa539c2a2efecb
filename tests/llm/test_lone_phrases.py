"""Phrases that share their key with no other one take no place in the suffix order."""

import random
from collections import Counter

import numpy as np

from lexiflow.llm import suffix_dedup
from lexiflow.llm.repeats import Phrases, Windows


def test_only_phrases_of_shared_keys_are_ordered(monkeypatch):
    w = Windows("byte", length=12, reach=5, seed=4)
    r = random.Random(2)
    text = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    core = text(12)
    data = [text(30), b"x" + core + b"y", text(25), b"z" + core + b"y", text(12)]
    n, lone = [2, 1, 3, 1, 1], [True, False, True, False, True]
    ordered, places = [], suffix_dedup.repeated_places
    monkeypatch.setattr(suffix_dedup, "repeated_places", lambda texts, length: ordered.append(texts) or places(texts, length))
    got = [m.tolist() for m, _ in suffix_dedup.shard_masks(Phrases(data, [len(d) - 11 for d in data], n, [(0, k, 0) for k in range(5)], lone), w)]
    count = Counter(d[i : i + 12] for d, k in zip(data, n, strict=True) for i in range(len(d) - 11) for _ in range(k))
    assert got == [[count[d[i : i + 12]] > 1 for i in range(len(d) - 11)] for d in data]
    assert ordered == [[data[1], data[3]]]
    assert not suffix_dedup.shard_masks(Phrases(data[4:], [1], [1], [(0, 4, 0)], [True]), w)[0][0].any() and len(ordered) == 1


def test_ranks_of_suffixes():
    r = random.Random(4)
    for letters in (1, 2, 5):
        sizes = [r.randint(1, 40) for _ in range(8)]
        rows = [[r.randint(1, letters) for _ in range(k)] for k in sizes]
        ends = np.repeat(np.cumsum(sizes), sizes)
        first = np.array([x for row in rows for x in row])
        ranks = suffix_dedup.suffix_ranks(first, 1, ends).tolist()
        suffixes = [row[i:] for row in rows for i in range(len(row))]
        least = {}
        for k, s in enumerate(sorted(suffixes)):
            least.setdefault(tuple(s), k + 1)
        assert ranks == [least[tuple(s)] for s in suffixes]
