"""Each operator against a plain version, on small tables with nulls, ties, repeats and long texts."""

import os
import random
import re
import time
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiflow.llm import common, html_extract, licenses, ngram_join, phrase_dedup, queries, repeats, secrets, suffix_dedup
from lexiflow.llm.bpe import Bpe, bpe_codec
from lexiflow.llm.exact_dedup import exact_dedup
from lexiflow.llm.mixing import LANGUAGES, SOURCES, TOPICS, calibrate, mix, rake
from lexiflow.llm.quality_rules import LineRules, quality_rules
from lexiflow.session import stash
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, kept string, n_words string, spans string"


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, empty texts, copies, near copies, shared passages, a very long text."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() + r.choice(["", "", ".", ",\n"]) for _ in range(n))
    base = [text(r.randint(3, 200)) for _ in range(12)]
    passage = text(90)
    out = [(None, None), (None, ""), (1, ""), (2, " \t\n"), (3, "one"), (3, "one"), (4, "One"), (5, "x" * 30_000), (6, "ab " * 3000)]
    for i, b in enumerate(base):
        w = b.split(" ")
        near = w[:]
        near[len(w) // 2] = "changed"
        out += [(10 + i, b), (40 + i, b), (70 + i, " ".join(near)), (100 + i, f"{text(20)}\n{passage}\n{text(20)}")]
    return [*out, (10, base[0])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "a", "b", "c", "d") for i, t in awkward()]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(none, spark):
    empty_pages = spark.createDataFrame([], "page_id long, url string, html string")
    got = [suffix_dedup.suffix_dedup(none), ngram_join.ngram_components(none), phrase_dedup.phrase_dedup(none), mix(none), html_extract.html_text(empty_pages)]
    got += [licenses.license_scan(none), exact_dedup(none), bpe_codec(none, queries.vocabulary()), quality_rules(none), secrets.secret_spans(none)]
    assert [x.count() for x in got] == [0] * 10


@pytest.mark.parametrize("change", [{}, {"hot": 1}, {"hot": 1, "fan": 2}, {"shard": 2}])
def test_suffix_dedup(docs, change):
    w = replace(suffix_dedup.BYTES, **change)
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, w).orderBy("rid").collect()]
    assert got == brute.suffix_dedup([t for _, t in awkward()], w.length)


@pytest.mark.parametrize("size", [700, 5000])
def test_long_texts_in_segments(spark, size, monkeypatch):
    """Texts cut into segments give the same keys, runs and sets as whole ones."""
    r = random.Random(size)
    words = [r.choice(["alpha", "be", "gämma", "d", "epsilonn"]) + str(r.randint(0, 9)) for _ in range(4000)]
    text = " ".join(words) + "\t" + " \n ".join(words[500:1500])
    raw = text.encode()
    for unit, length in (("byte", 400), ("word", 20), ("word", 5)):
        units = raw.split() if unit == "word" else raw
        seen = []
        for at, part in repeats.segments_of(raw, unit, length, size):
            own = part.split() if unit == "word" else part
            assert own == units[at : at + len(own)]
            seen += range(at, at + len(own) - length + 1)
        assert seen == list(range(len(units) - length + 1))
    whole = list(ngram_join.shingle_sets([raw, b"", b"a b", raw[:3000]], 5))
    monkeypatch.setattr(repeats, "SEGMENT", size)
    assert [s.tolist() for s in ngram_join.shingle_sets([raw, b"", b"a b", raw[:3000]], 5)] == [s.tolist() for s in whole]


def near_copies(spark, n: int, size: int = 60):
    """One text of ``size`` words in ``n`` copies, each with a word of its own in another place."""
    base = [f"w{k}" for k in range(size)]
    rows = [(k, " ".join(base[: k % 50] + [f"own{k}"] + base[k % 50 :])) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_parts_of_a_hot_group_grow_in_proportion(spark, monkeypatch):
    made = []
    whole = repeats._parts
    monkeypatch.setattr(repeats, "_parts", lambda *a: (made.append(out := stash(whole(*a))), out)[1])
    sizes = []
    for n in (200, 400, 800):
        made.clear()
        phrase_dedup.phrase_dedup(near_copies(spark, n), replace(phrase_dedup.WORDS, hot=20)).count()
        sizes.append(sum(m.count() for m in made))
        assert all("data" not in m.columns for m in made)
    assert sizes[0] > 0 and sizes[2] < 2.6 * sizes[1] and sizes[1] < 2.6 * sizes[0]


def test_marks_come_through_shards(spark, monkeypatch):
    """The verdict on every marked window is the suffix order's, or the automaton's."""
    docs = near_copies(spark, 60, 300).unionByName(near_copies(spark, 3, 300).withColumn("doc_id", F.col("doc_id") + 1000))
    for module, run in ((phrase_dedup, phrase_dedup.phrase_dedup), (suffix_dedup, suffix_dedup.suffix_dedup)):
        assert run(docs).agg(F.sum("n_removed")).first()[0] > 0
        blind = lambda p, w: [(np.zeros(n, bool), np.zeros(n, bool)) for n in p.windows]
        monkeypatch.setattr(module, "shard_masks", blind)
        assert run(docs).agg(F.sum("n_removed")).first()[0] == 0


@pytest.mark.parametrize("seed", range(20))
def test_corpus_order(seed):
    r = random.Random(seed)
    base = "".join(r.choice("ab" if seed % 2 else "abcdefg") for _ in range(300)).encode()
    texts = [base[a : a + r.randint(0, 150)] for a in (r.randint(0, 250) for _ in range(6))]
    parsing = suffix_dedup.Parsing(texts)
    order, _ = parsing.order(np.arange(len(parsing.data)))
    suffixes = [parsing.data[i : parsing.text_end[i]] for i in order]
    assert suffixes == sorted(suffixes)
    n = Counter(t[i : i + 12] for t in texts for i in range(len(t) - 11))
    assert suffix_dedup.repeated_places(texts, 12).tolist() == [i + 12 <= len(t) and n[t[i : i + 12]] > 1 for t in texts for i in range(len(t))]


@pytest.mark.parametrize("change", [{}, {"hot": 1}, {"hot": 1, "fan": 2}, {"shard": 2}])
def test_phrase_dedup(docs, change):
    w = replace(phrase_dedup.WORDS, **change)
    got = [(r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.phrase_dedup(docs, w).orderBy("rid").collect()]
    assert got == brute.phrase_dedup(awkward(), w.length)
    assert [brute.sha(r.text.encode()) for r in phrase_dedup.deduplicated(docs, w).orderBy("rid").collect()] == [x[2] for x in got]


@pytest.mark.parametrize("change", [{}, {"family": 2}, {"leaf": 2, "fan": 2, "bits": 64}, {"sample": 10, "frequent": 1}])
def test_ngram_components(docs, change):
    rows = ngram_join.ngram_components(docs, replace(ngram_join.Similar(), **change)).orderBy("rid").collect()
    numbered = list(enumerate(awkward()))
    expected = brute.components([(k, t) for k, (_, t) in numbered])
    groups: dict = {}
    for k, (_, c) in expected.items():
        groups.setdefault(c, []).append(k)
    for r, (k, (i, _)) in zip(rows, numbered, strict=True):
        n, c = expected[k]
        ids = [numbered[m][1][0] for m in groups[c] if numbered[m][1][0] is not None]
        assert (r.doc_id, r.n_shingles, r.component_id) == (i, n, min(ids, default=None) if n else i)


@pytest.mark.parametrize("block", [3, 64, 8192])
def test_exact_dedup(docs, block):
    rows = exact_dedup(docs, block).orderBy("rid").collect()
    same: dict = {}
    for k, (i, t) in enumerate(awkward()):
        same.setdefault(t or "", []).append((i is not None, i or 0, k))
    for k, ((i, t), r) in enumerate(zip(awkward(), rows, strict=True)):
        best = max(same[t or ""])
        assert (r.doc_id, r.keep_id, r.group_size, r.kept) == (i, best[1] if best[0] else None, len(same[t or ""]), best[2] == k)
        assert r.text_sha256 == brute.sha((t or "").encode())


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the generated tables")
def test_rules_work_on_a_real_table(spark):
    """Blocks decide equal texts by pairs too, and the line rule fires and rejects."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = exact_dedup(table).collect()
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    groups: dict = {}
    for i, t in texts.items():
        groups.setdefault(t, []).append(i)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert any(len(g) > 1 and len(t.encode()) > 512 for t, g in groups.items())
    judged = quality_rules(table)
    assert judged.where("boiler_words > 0").count() > 0 and judged.where("boiler_words > 0 and not kept and not base_failed").count() >= 0


def test_quality_rules(docs):
    rules = LineRules(max_docs=2)
    rows = quality_rules(docs, rules=rules).orderBy("rid").collect()
    texts = [t or "" for _, t in awkward()]
    norm = lambda x: " ".join(brute.WORD.findall(x)).lower()
    holds: dict = {}
    for t in texts:
        for x in t.split("\n"):
            holds.setdefault(norm(x), set()).add(t)
    for t, r in zip(texts, rows, strict=True):
        w = brute.WORD.findall(t)
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        boiler = sum(len(brute.WORD.findall(x)) for x in lines if len(holds[norm(x)]) > rules.max_docs)
        left = len(w) - boiler
        kept = not failed and not (boiler and left < rules.min_left * len(w))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_symbols, r.base_failed, r.boiler_words, r.kept) == (len(re.findall("[#*$%&|<>]", t)), failed, boiler, kept)


def test_rake_meets_marginals():
    r = np.random.default_rng(0)
    axes = [np.repeat(np.arange(3), 8), np.tile(np.repeat(np.arange(4), 2), 3), np.tile(np.arange(2), 12)]
    targets = [np.array(t) for t in ([0.2, 0.5, 0.3], [0.1, 0.2, 0.3, 0.4], [0.6, 0.4])]
    n = r.integers(1, 100, 24).astype(float)
    for got in (rake(n, axes, targets), rake(n, axes, targets, 0.1, bounded=True), calibrate(n, axes, targets, 1.0, 1e-6)):
        for axis, t in zip(axes, targets, strict=True):
            assert np.allclose(np.bincount(axis, got.take) / got.take.sum(), t, atol=1e-5)
    assert (got.take <= n + 1e-9).all() and 0.1 < got.share < 1


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 2), st.integers(0, 1)), min_size=1, max_size=12), st.floats(0.05, 1))
@settings(deadline=None, max_examples=60)
def test_calibrate_stays_in_bounds(cells, share):
    n = np.array([float(c[0]) for c in cells])
    got = calibrate(n, [np.array([c[k] for c in cells]) for k in (1, 2)], [np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.6])], share)
    assert (got.take >= 0).all() and (got.take <= n + 1e-6).all() and got.take.sum() <= share * n.sum() + 1e-6
    assert 0 <= got.share <= share + 1e-9


def test_mix_meets_its_targets_on_a_real_table(spark):
    """Expected tokens by source, language and topic; what is drawn comes near them."""
    table = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("needs the generated tables")
    rows = mix(spark.read.parquet(table))
    total = rows.agg(F.sum("n_tokens")).first()[0]
    for axis, (name, targets) in enumerate((("cell_source", SOURCES), ("cell_lang", LANGUAGES), ("cell_topic", TOPICS))):
        found = rows.groupBy(name).agg(
            F.sum(F.col("n_tokens") * F.col("probability")).alias("want"), F.sum(F.when(F.col("sampled"), F.col("n_tokens"))).alias("drawn"),
            F.first(F.col("reached")[axis]).alias("reached"), F.first(F.col("wanted")[axis]).alias("wanted"),
        ).collect()
        want, drawn = sum(r.want for r in found), sum(r.drawn or 0 for r in found)
        there = sum(targets.get(r[name], 0) for r in found)
        for r in found:
            assert abs(r.want / want - r.reached) < 1e-6
            if r[name] in targets:
                assert abs(r.reached - targets[r[name]] / there) < 3e-3 or r[name] == "(rest)"
                assert abs((r.drawn or 0) / drawn - r.reached) < 0.05
    assert 0.05 < want / total <= 0.5 + 1e-9


def test_mix_covers_every_row(docs):
    rows = mix(docs).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.probability <= 1 for r in rows)
    assert {r.cell_source for r in rows} == {"(rest)"}


def test_bpe_is_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    extra = ["<|endoftext|>a<|startoftext|> b", "ΑΣ İ ǅ ﬁ é Å", "don't WE'LL 1½²", "日本🙂🙂!!", "\x00\x1c\x85​q"]
    texts = [t or "" for _, t in awkward()] + extra
    expected = library.encode_batch(texts, add_special_tokens=False)
    got = Bpe(path).encode_batch(texts)
    for (ids, text), e in zip(got, expected, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert text == library.decode(e.ids, skip_special_tokens=False)
    rows = bpe_codec(docs, path).collect()
    assert [bytes(r.ids_le) for r in rows] == [x for x, _ in got][: len(rows)]


def test_bpe_of_long_words_is_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    ours, theirs = Bpe(path), Tokenizer.from_file(path)
    r = random.Random(1)
    words = ["".join(r.choice(a) for _ in range(n)) for a in ("ab", "abcdefghij", "éüß日本x", "a") for n in (129, 300, 2500)]
    for w, (ids, _) in zip(words, ours.encode_batch(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(w, add_special_tokens=False).ids
    began = time.perf_counter()
    ours.encode_batch(["".join(r.choice("abcde") for _ in range(40_000))])
    assert time.perf_counter() - began < 10


def test_secrets(spark):
    texts = [None, "", 'PassWord = "abc123"', "token: ab", "api_key=zzzzzz apikey:  'yyyyyyy", "AKIA" + "A" * 16 + " AKIA1", "f" * 24 + "g" + "0" * 23, "ghp_" + "a" * 36, "ſecret: abcdef"]
    rows = secrets.secret_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in rows] == [
        [], [], [("assign", 0, 18)], [], [("assign", 0, 14), ("assign", 15, 32)], [("access", 0, 20)], [("hex", 0, 24)], [("github", 0, 40), ("hex", 4, 40)], []
    ]


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_trigram_queries_lose_nothing(rule):
    """The index finds every text that a plain scan finds."""
    r = random.Random(3)
    seeds = ["password", "passwd", "SECRET", "token", "api_key", "ApiKey", "AKIA", "ghp_", "xoxb-", "AIza", "sk_live_", "eyJ", "bearer ", "://", "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(r.choice([*seeds, *"=: .@", "a1B2c3D4e5" * 5, "zz"]) for _ in range(12)) for _ in range(300)]
    found = secrets.Scanner((rule,)).scan(texts)
    pattern = re.compile(rule.pattern, re.A | re.I if rule.any_case else re.A)
    for t, f in zip(texts, found, strict=True):
        assert [(m.start(), 0, m.end()) for m in pattern.finditer(t) if m.end(rule.group) - m.start(rule.group) >= rule.least] == f


def test_licenses(spark):
    texts = [None, "Under the MIT License!", "undr the mit licence x", "apache-license, version 2 cc by nc", "cc by ncx under the", "é under the mit license under the mit license"]
    rows = licenses.license_scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows] == [
        (0, 0, None, None, "", ""), (4, 1, 0, 0, "mit", "mit"), (5, 0, None, None, "", "mit"), (7, 2, 0, 4, "apache-2,cc-by-nc", "apache-2,cc-by-nc"),
        (5, 0, None, None, "", ""), (9, 2, 1, 5, "mit", "mit"),
    ]
    assert 0.8 < rows[2].score < 1 and rows[1].score == 1 and rows[0].score == 0


PAGE = """<html><head><title>t</title><script>var a="</p><p>no</p>";</script></head><body><header>h</header><nav><ul><li>menu<li>menu2</ul></nav>
<div class="main-col"><h1>Head&amp;er {0}</h1><p>First <b>bold</b>
 text {0}.<p>Second&nbsp;{0}<br>line<div class="comments"><p>reader</p></div><aside>side</aside></div><div id="cookie-notice">ok</div><form><p>f</p></form><footer>foot</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i)) for i in range(8)] + [(8, None, None), (9, "http://x/", "<p>lone &lt;b&gt;</p>"), (9, "http://x/", "")]
    got = html_extract.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id", F.desc("n_chars")).collect()
    for i in range(8):
        assert got[i].text == f"Head&er {i}\nFirst bold text {i}.\nSecond {i} line" and got[i].slot == "html/body/div.main-col"
    assert [(r.text, r.n_chars) for r in got[8:]] == [("", 0), ("lone <b>", 8), ("", 0)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [f"{k} " + " ".join(f"w{k * 7 + j}" for j in range(40)) for k in range(30)]
    rows = [(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)] + [(100, texts[0], "en", "src1", 1), (101, texts[1] + " tail", "en", "src1", 1), (102, "too short", "en", "src1", 1), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "encode"]
    good = stages["quality"](spark, docs, "")
    assert ids(good) == [*range(30), 100, 101]
    written = lambda df, n: (df.write.parquet(f"{tmp_path}/{n}"), spark.read.parquet(f"{tmp_path}/{n}"))[1]
    one = stages["exact"](spark, written(good, "a"), "")
    assert ids(one) == [*range(1, 30), 100, 101]
    few = stages["near"](spark, written(one, "b"), "")
    kept = brute.components([(r.doc_id, r.text) for r in one.collect()])
    assert ids(few) == sorted({c for _, c in kept.values()})
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert set(ids(final)) <= set(ids(few)) and final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_row_numbers_do_not_follow_splits(spark, tmp_path):
    """Two scans planned for different numbers of cores give each row the same number."""
    path = f"{tmp_path}/a b%20c"
    spark.range(20_000).selectExpr("id doc_id", "concat('t', id, repeat(md5(string(id)), 4)) text").repartition(3).write.option("parquet.block.size", "65536").parquet(path)
    seen, parts = [], []
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        for n in (1, 40):
            spark.conf.set("spark.sql.files.minPartitionNum", str(n))
            rows = common.numbered(spark.read.parquet(path))
            parts.append(spark.read.parquet(path).rdd.getNumPartitions())
            seen.append({r.rid: r.doc_id for r in rows.select("rid", "doc_id").collect()})
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert parts[0] != parts[1] and len(seen[0]) == 20_000 and seen[0] == seen[1]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_our_names(spark):
    names = "n_words string, spans string, labels string, score string, rid string, text_2 string, n_base string, host string"
    docs = spark.createDataFrame([(1, "under the mit license", *"abcdefgh"), (None, None, *[None] * 8)], "doc_id long, text string, " + names)
    assert {r.labels for r in licenses.license_scan(docs).collect()} == {"mit", ""}
    assert sorted(len(r.spans) for r in secrets.secret_spans(docs).collect()) == [0, 0]
    assert bpe_codec(docs, queries.vocabulary()).count() == 2 and ngram_join.ngram_components(docs).count() == 2


def test_near_keeps_one_of_each_group_whatever_the_ids(spark, tmp_path):
    """Unrelated texts without ids, and unrelated texts that share an id, all stay."""
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k * 100 + j}" for j in range(40))
    rows = [(None, text(k)) for k in range(4)] + [(None, text(0) + " tail"), (5, text(5)), (5, text(6)), (7, text(6) + " tail"), (8, text(8)), (None, text(8) + " tail")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.near(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    assert sorted(r.text for r in got) == sorted(text(k) for k in (0, 1, 2, 3, 5, 6, 8))


def test_quality_takes_frequent_lines_out(spark, tmp_path):
    import corpus_pipeline

    own = lambda k: "\n\n" + " ".join(f"w{k * 100 + j}" for j in range(25)) + "\n"
    rows = [(k, f"All  rights RESERVED{own(k)} all rights reserved \nend {k}") for k in range(101)] + [(200, own(200)), (201, None), (202, "all rights reserved" + own(202))]
    table = [(i, t, "en", "s" if i != 202 else "other", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality(spark, docs, "").collect()}
    plain = {k: f"{own(k)[1:]}end {k}" for k in range(101)} | {200: own(200), 202: rows[-1][1]}
    assert got == {k: (t, len(t)) for k, t in plain.items()}
    whole = quality_rules(docs).where("doc_id = 7").first()
    assert (whole.text, whole.clean_text, whole.boiler_lines) == (rows[7][1], plain[7], 2)


def extracted(spark, pages, rule=html_extract.Deduction()):
    rows = [(i, f"http://host.example/{i}", p) for i, p in enumerate(pages)]
    return [(r.text, r.slot) for r in html_extract.html_text(spark.createDataFrame(rows, "page_id long, url string, html string"), rule).orderBy("page_id").collect()]


def test_html_keeps_text_beside_the_largest_container(spark):
    """A heading, a standfirst and a second body are main text; what is the same everywhere is template."""
    long = lambda k: f"body {k} " + "word " * 60
    page = "<body><div class=top>Welcome</div><article><h1>T{0}</h1><p>Lead {0}</p><div class=body><p>{1}</p></div><div class=more><p>More {0}</p></div></article></body>"
    got = extracted(spark, [page.format(k, long(k)) for k in range(4)])
    assert got == [(f"T{k}\nLead {k}\n{long(k).strip()}\nMore {k}", "body/article") for k in range(4)]
    copies = "<body><div class=date>{0}</div><article><p>" + long(0) + "</p></article></body>"
    assert [t for t, _ in extracted(spark, [copies.format(k) for k in range(4)])] == [long(0).strip()] * 4


PLAIN = """<body><div class=a1><div>Home</div><div>Prices and offers</div></div><div class=b7><h2>{title}</h2><div>{body}</div><h3>Notes</h3><div>{more}</div></div>
<div class=c3><p>{boiler}</p><p>Call us at 555 today</p></div></body>"""


def test_html_template_decides_without_roles(spark):
    """No article, no telling class: only the template tells the text from what is the same on all pages of a host."""
    boiler = "All rights reserved by the makers of this site and all of their friends near and far since the beginning of time"
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    pages = [PLAIN.format(title=f"Title {k}", body=text(k), more=text(k + 100), boiler=boiler) for k in range(6)]
    gold = [f"Title {k}\n{text(k)}\nNotes\n{text(k + 100)}" for k in range(6)]
    assert extracted(spark, pages) == [(g, "body/div.b0") for g in gold]
    off = extracted(spark, pages, html_extract.Deduction(pages=100))
    assert all(boiler in t and "Prices and offers" in t and slot is None for t, slot in off)


def test_html_classes_must_keep_their_order(spark):
    """Containers that change places from page to page are no template, though they stand once on each."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    part = [f"<div class=p{c}><b>{c}</b></div>" for c in "ab"]
    pages = [f"<body><div class=m>{part[k % 2]}{part[1 - k % 2]}<div class=t><p>{text(k)}</p></div></div></body>" for k in range(6)]
    assert [t for t, _ in extracted(spark, pages)] == [f"{'ab'[k % 2]}\n{'ab'[1 - k % 2]}\n{text(k)}" for k in range(6)]
    pages = [f"<body><div class=m>{part[0]}{part[1]}<div class=t><p>{text(k)}</p></div></div></body>" for k in range(6)]
    assert extracted(spark, pages) == [(text(k), "body/div.m/div.t") for k in range(6)]


def test_html_depth_costs_in_proportion():
    took = []
    for depth in (4_000, 32_000):
        page = "<div><li><nav>" * depth + "<p>deep</p>" + "text <p>" * 100
        began = time.perf_counter()
        parsed = html_extract.Page(page)
        took.append(time.perf_counter() - began)
        assert len(parsed.up) >= 3 * depth and len(parsed.blocks) == 101
    assert took[1] < 30 * took[0]


def test_html_long_class_names_stay_apart(spark):
    name = "x" * 100
    page = "<body><div class='{0}a'>Fixed line here</div><div class='{0}b'><p>{1}</p></div></body>"
    got = extracted(spark, [page.format(name, f"text of page {k} " * 5) for k in range(4)])
    assert got == [((f"text of page {k} " * 5).strip(), f"body/div.{name}b") for k in range(4)]


def test_html_extra_columns_and_nulls(spark):
    schema = "page_id long, url string, html string, rid string, host string, slot long, text string, path string"
    rows = [(None, None, None, "a", "b", 1, "c", "d"), (1, "not a url", "<p>x", "a", None, 1, None, "d"), (1, "not a url", "<p>x", "a", None, 1, None, "d"), (2, "http://h/", " ", "", "", 0, "", "")]
    got = html_extract.html_text(spark.createDataFrame(rows, schema)).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.n_chars, r.slot) for r in got] == [(None, "", 0, None), (1, "x", 1, None), (1, "x", 1, None), (2, "", 0, None)]


def test_html_counts_text_of_containers_with_ids_of_their_own(spark):
    """A body whose container has another id on each page counts with the container around it."""
    page = "<body><div class=wrap><div class=lead><p>Lead {0}</p></div><div id='post-{1}'><p>Body {0} " + "word " * 40 + "</p></div></div></body>"
    got = extracted(spark, [page.format(k, "abcdef"[k] * 3) for k in range(6)])
    assert got == [(f"Lead {k}\nBody {k} " + "word " * 39 + "word", "body/div.wrap") for k in range(6)]
    bare = "<div class=lead><p>Lead {0}</p></div>tail {0}"
    assert extracted(spark, [bare.format(k) for k in range(4)]) == [(f"Lead {k}\ntail {k}", None) for k in range(4)]


@pytest.mark.parametrize(
    "page",
    [
        "<body class='no-sidebar menu'><nav>menu</nav><article><h1>T</h1>{}</article></body>",
        "<body><nav>menu</nav><div class='content has-sidebar'><h1>T</h1>{}</div></body>",
        "<body><nav>menu</nav><article class='post comments-open'><h1>T</h1>{}</article></body>",
        "<body><form id=f><nav>menu</nav><div><h1>T</h1>{}</div><div class=comments>reader</div></form>out</body>",
        "<body><nav>menu</nav><div class='side'><h1>T</h1>{}<div class=share>share</div></div>small</body>",
    ],
)
def test_html_roles_do_not_empty_a_page(page):
    """Classes of a state, of the page as a whole or of a wrapper exclude nothing."""
    text = html_extract.main_text(page.format("<p>" + "word " * 50 + "</p>"), None)
    assert [x for x in text.split("\n") if x not in ("out", "small")] == ["T", " ".join(["word"] * 50)]


def test_html_long_comments_and_menus_stay_out():
    page = "<body><article><h1>T</h1><p>short</p></article><div class=comments><p>" + "reader " * 50 + "</p></div></body>"
    assert html_extract.main_text(page, None) == "T\nshort"
    assert html_extract.main_text("<body><nav>" + "menu " * 50 + "</nav><p>short</p></body>", None) == "short"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_licenses_against_all_word_ranges(seed):
    """Spans are matches, and wherever a range of words matches a notice a span of that notice touches it."""
    r = random.Random(seed)
    notices = licenses.BASE + licenses.ADDED
    found: list[str] = []
    for _ in range(6):
        phrase = list(r.choice(notices).phrase)
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            k = r.randrange(len(phrase))
            phrase[k : k + 1] = r.choice([[], ["x"], ["x", phrase[k]]])
        found += "".join(phrase).split() + [r.choice(["a", "the", "gnu", "license"]) for _ in range(r.randint(0, 3))]
    text = " ".join(found)
    spans = licenses.scan_text(text, licenses.BASE, notices)["spans"]
    finder = licenses.Finder(notices)
    for k, a, b, e in finder.find(text):
        assert distance(text[a:b], notices[k].phrase) <= e <= notices[k].errors
    for n in notices:
        own = [(s["first_word"], s["last_word"]) for s in spans if s["label"] == n.label]
        size = n.phrase.count(" ") + 1
        for i in range(len(found)):
            for j in range(max(i, i + size - 3), min(len(found), i + size + 3)):
                if distance(" ".join(found[i : j + 1]), n.phrase) <= n.errors:
                    assert any(a <= j and i <= b for a, b in own), (n, found[i : j + 1])


def test_license_scan_of_long_texts_is_linear():
    notices = licenses.BASE + licenses.ADDED
    took = []
    for n in (500, 4_000):
        text = "some words under the mit license and gnu genral public license " * n
        began = time.perf_counter()
        got = licenses.scan_text(text, licenses.BASE, notices)
        took.append(time.perf_counter() - began)
        assert got["n_base"] == n and len(got["spans"]) >= 2 * n
    assert took[1] < 24 * took[0]


def test_licenses_finds_a_worse_match_before_a_better_one():
    notices = licenses.BASE + licenses.ADDED
    for text in ("undr the mit licens and under the mit license", "under the mit license and undr the mit licens"):
        spans = licenses.scan_text(text, licenses.BASE, notices)["spans"]
        assert [(x["label"], x["first_word"], x["last_word"]) for x in spans] == [("mit", 0, 3), ("mit", 5, 8)]
