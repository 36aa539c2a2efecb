"""Whole queries on the smallest real tables against plain versions in Python."""

import hashlib
import html
import os
import re
from collections import defaultdict

import numpy as np
import pytest

from lexiflow.llm import licenses, queries
from lexiflow.llm.mixing import LANGUAGES, REST, SOURCES, TOPICS, calibrate
from tests.llm import brute

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_license_scan(spark, docs):
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    rows = {r.doc_id: r for r in queries.op6_license_scan(spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or ""))
        places = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r, at, base = rows[d["doc_id"]], [i for i, _ in places], {k for _, k in places}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | {s.label for s in r.spans})) and 0 <= r.score <= 1
        assert not places or r.score == 1
        for s in r.spans:
            own = " ".join(w[s.first_word : s.last_word + 1])
            assert any(n.label == s.label and s.errors <= n.errors and abs(len(own) - len(n.phrase)) <= n.errors for n in licenses.BASE + licenses.ADDED)


def test_html_extraction(spark):
    """The pages' articles, cut out by their tags."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = {r.page_id: r for r in queries.op5_html_extraction(spark, SF).collect()}
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search("<article>(.*?)</article>", p.html or "", re.S)
        parts = re.split("</?(?:p|h1|h2|ul|li|div)(?:\\s[^>]*)?>", article[1]) if article else []
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
        want = "\n".join(x for x in plain if x)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)


def topic(text: str) -> str:
    n = max(len(text), 1)
    marks = lambda chars: sum(c in chars for c in text)
    return "tabular" if marks("|\t") * 50 > n else "numeric" if marks("0123456789") * 50 > n else "brief" if n < 800 else "prose"


def mixed(rows: list[dict]) -> dict:
    """(cell, probability, sampled) by doc_id, with the draw of each document worked out anew."""
    tables = [SOURCES, LANGUAGES, TOPICS]
    cell = lambda d: tuple(v if v in t else REST for v, t in zip((d["source"], d["lang"], topic(d["text"] or "")), tables, strict=True))
    tokens: dict = defaultdict(int)
    for d in rows:
        tokens[cell(d)] += len(brute.WORD.findall(d["text"] or ""))
    cells = sorted(tokens)
    full = [dict(t) | {REST: max(0.0, 1 - sum(t.values()))} for t in tables]
    axes = [np.array([list(t).index(c[k]) for c in cells]) for k, t in enumerate(full)]
    n = np.array([tokens[c] for c in cells], float)
    got = calibrate(n, axes, [np.array(list(t.values())) for t in full], 0.5)
    chance = {c: min(1, x / m) if m else got.share for c, x, m in zip(cells, got.take, n, strict=True)}
    out = {}
    for d in rows:
        own = hashlib.md5((d["text"] or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"17|{'' if d['doc_id'] is None else d['doc_id']}|{own}".encode()).hexdigest()[:8], 16) / 2**32
        out[d["doc_id"]] = cell(d), chance[cell(d)], draw < chance[cell(d)]
    return out


def test_mixing(spark, docs):
    want = mixed(docs)
    rows = queries.op4_mixing(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        cell, chance, sampled = want[r.doc_id]
        assert (r.cell_source, r.cell_lang, r.cell_topic) == cell and abs(r.probability - chance) < 1e-6
        assert r.sampled == sampled or abs(r.probability - chance) > 0


def quality(rows: list[dict]) -> list[dict]:
    """What the quality stage keeps, its frequent lines taken out."""
    norm = lambda x: " ".join(brute.WORD.findall(x)).lower()
    texts, holds = defaultdict(set), defaultdict(set)
    for d in rows:
        texts[d["source"]].add(d["text"] or "")
        for x in (d["text"] or "").split("\n"):
            if brute.WORD.search(x):
                holds[d["source"], norm(x)].add(d["text"] or "")
    often = {k for k, own in holds.items() if len(own) > max(10, len(texts[k[0]]) // 100)}
    out = []
    for d in rows:
        t = d["text"] or ""
        w = brute.WORD.findall(t)
        seen = defaultdict(int)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])] += 1
        again = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = t.split("\n")
        gone = [x for x in lines if brute.WORD.search(x) and (d["source"], norm(x)) in often]
        boiler = sum(len(brute.WORD.findall(x)) for x in gone)
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        if not failed and not (boiler and len(w) - boiler < 0.3 * len(w)):
            kept = [x for x in lines if not brute.WORD.search(x) or (d["source"], norm(x)) not in often]
            out.append(d | {"text": "\n".join(kept) if gone else d["text"]})
    return out


def test_pipeline(spark, docs):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = quality(docs)
    last = {d["text"] or "": d["doc_id"] for d in rows}  # ids rise, so the largest of equal texts comes last
    rows = [d for d in rows if last[d["text"] or ""] == d["doc_id"]]
    component = brute.components([(d["doc_id"], d["text"]) for d in rows])
    least: dict = {}
    for d in rows:
        n, c = component[d["doc_id"]]
        least.setdefault(c if n else ("empty", d["doc_id"]), d["doc_id"])
    rows = [d for d in rows if d["doc_id"] in set(least.values())]
    drawn = mixed(rows)
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = set()
    for d in rows:
        if drawn[d["doc_id"]][2]:
            ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
            text = tokenizer.decode(ids, skip_special_tokens=False)
            want.add((d["doc_id"], len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(text.encode())))
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(want) > 50 and got == want
