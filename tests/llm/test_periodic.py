"""Runs of repeated words against a plain search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiflow.llm import periodic, queries
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """All runs by trying each period at each place."""
    best: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                length = j + q - i
                if length >= max(6, 4 * q):
                    best.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def texts_at(w: list[list]) -> np.ndarray:
    texts = [" ".join(map(str, x)).encode() for x in w]
    ids, base = periodic.interned(texts)
    found = periodic.runs_in(ids, max(map(len, w), default=0))
    return [[(s - b, n, q) for s, n, q in found.tolist() if b <= s < e] for b, e in zip(base[:-1], base[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4))
def test_small_alphabets(texts):
    assert texts_at(texts) == [plain_runs(t) for t in texts]


def test_built_texts():
    r = random.Random(5)
    fib = [0, 1]
    while len(fib) < 400:
        fib += fib[: len(fib) * 5 // 8 or 1]
    cases = [[1] * 700, [1, 2] * 300 + [1], [1] * 200 + [2] + [1] * 200, fib[:400], [r.randint(0, 1) for _ in range(900)]]
    for _ in range(60):
        loop = [r.randint(0, 3) for _ in range(r.randint(1, 40))]
        cases.append([r.randint(0, 3) for _ in range(r.randint(0, 30))] + loop * r.randint(2, 9) + loop[: r.randint(0, len(loop))] + [r.randint(0, 3) for _ in range(r.randint(0, 30))])
        inner = ([7] * r.randint(1, 8) + [8]) * r.randint(1, 6) + [9]
        cases.append(inner * r.randint(1, 6))
    assert texts_at(cases) == [plain_runs(t) for t in cases]
    assert any(len({q for _, _, q in plain_runs(t)}) > 1 for t in cases)


def test_work_is_bounded():
    """A text of one word, and one whose squares nearly match, take no quadratic time."""
    import time

    began = time.perf_counter()
    n = 400_000
    w = np.zeros(n, np.int32)
    assert periodic.runs_in(w, n).tolist() == [[0, n, 1]]
    w[n // 2 + n // 7] = 1
    assert len(periodic.runs_in(w, n)) == 2
    assert time.perf_counter() - began < 60


def test_z_function():
    r = random.Random(1)
    for _ in range(200):
        x = [r.randint(0, 1) for _ in range(r.randint(1, 40))]
        z = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert periodic.z_function(np.array(x)) == z


def expected(doc_id, text) -> tuple:
    w = brute.WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *top, brute.sha(lines.encode()), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))


def digest(rows):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows), key=str)


def test_awkward_rows(spark):
    """Nulls, texts without words, repeats, long texts, ties, clashing columns."""
    rows = [(None, None), (None, "a " * 9), (1, ""), (2, " \t\n"), (3, "x"), (3, "x"), (4, "é é " * 7 + "b b b b b b"), (5, "a b " * 5 + "z " + "c d " * 5)]
    rows += [(i, " ".join(f"w{k % 50}" for k in range(i))) for i in range(6, 80)]
    rows.append((80, " ".join(["stop"] * 100 + [f"v{k}" for k in range(2000)] + ["go on"] * 300)))
    docs = spark.createDataFrame([(*x, 1, "r") for x in rows], "doc_id long, text string, n_words long, runs string").withColumn("_first", F.lit(1))
    got = periodic.run_columns(periodic.periodic_runs(docs.withColumn("text", periodic.looped("doc_id", "text")))).collect()
    assert digest(got) == sorted((expected(*x) for x in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i) and sum(r.n_runs for r in got) > 5
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_long_texts_in_segments(monkeypatch):
    from lexiflow.llm import repeats

    w = [f"w{k % 300}" for k in range(5000)] + ["end"]
    text = " \n".join(w).encode()
    whole = periodic.interned([text, b"a"])[0].tolist()
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    assert periodic.interned([text, b"a"])[0].tolist() == whole
    assert periodic.collapsed(text, None) == " ".join(w).encode()
    gone = np.arange(len(w)) % 3 == 0
    assert periodic.collapsed(text, gone) == " ".join(x for k, x in enumerate(w) if k % 3).encode()


def test_only_runs_of_four_periods():
    with pytest.raises(ValueError):
        periodic.Runs(times=3)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert digest(rows) == sorted((expected(r.doc_id, r.text) for r in docs), key=str)
    assert hashlib.sha256(b"").hexdigest() in {r.runs_sha256 for r in rows} and any(r.n_runs for r in rows)
