"""Edits, candidates and structure on small literal tables."""

import random
import re

import numpy as np
import regex
from pyspark.sql import functions as F

from lexiflow.functions import lexicon
from lexiflow.operators import edits, structure


def test_resolve_and_apply(spark):
    rows = [(1, 0, 3, 1, "X"), (1, 2, 5, 0, "no"), (1, 4, 5, 0, "Y"), (1, 0, 2, 0, "no"), (2, 1, 1, 0, "+")]
    table = spark.createDataFrame(rows, "doc_id long, start long, end long, priority int, after string")
    kept = edits.resolve(table)
    assert sorted((r.doc_id, r.start, r.after) for r in kept.collect()) == [(1, 0, "X"), (1, 4, "Y"), (2, 1, "+")]
    docs = spark.createDataFrame([(1, "абвгде"), (2, "ab"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.edited for r in edits.apply_edits(docs, kept).collect()} == {1: "XгYе", 2: "a+b", 3: ""}


def test_select_best(spark):
    rows = [(1, 0, "s", 2.0), (1, 1, "t", 2.0), (1, 2, "n", float("nan")), (2, 0, "s", 3.0), (2, 1, "t", 1.0), (3, 0, "s", None)]
    got = edits.select_best(spark.createDataFrame(rows, "doc_id long, cand_no int, text string, score double")).collect()
    assert {r.doc_id: r.cand_no for r in got} == {1: 0, 2: 1}


def test_novelty_and_hash(spark):
    rows = [("a b c d", "a b c d"), ("a b c d", "d c b a"), ("", None), ("x y", "p q")]
    got = spark.createDataFrame(rows, "a string, b string").select(edits.lexical_novelty("a", "b").alias("n"), edits.stable_hash("a").alias("h")).collect()
    assert [round(r.n, 6) for r in got] == [0.0, 0.75, 0.0, 1.0]
    assert got[2].h == 2166136261


def test_repeated_thesis(spark):
    s = "quick brown foxes jumped over several lazy sleeping dogs today"
    docs = spark.createDataFrame([(1, f"{s}. Something else entirely different stands between these long sentences here. {s} again."), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.earlier, r.later) for r in edits.repeated_thesis(docs).collect()] == [(1, 0, 2)]


def plain_repeats(text):
    """The pairs of one text by comparing all sentences of each paragraph."""
    word, out, at = regex.compile(r"[\p{L}\p{N}-]+"), [], 0
    for p in re.split("\n{2,}", text or ""):
        s = [x for x in regex.split("(?<=[.!?…][\"»”')\\]]?)\\s+", p) if x.strip()]
        c = [{w[:5] for w in word.findall(x.lower()) if len(w) >= 4 and w not in lexicon.STOP_WORDS} for x in s]
        long = [k for k, x in enumerate(s) if len(word.findall(x)) >= 8]
        out += [(at + i, at + j) for i in long for j in long if i < j and c[i] and c[j] and len(c[i] & c[j]) >= 0.6 * min(len(c[i]), len(c[j]))]
        at += len(s)
    return out


def test_repeated_thesis_is_the_plain_version(spark):
    r = random.Random(5)
    vocabulary = ["that", "this", "with", "from", "have", "were", "a", "of", "it", "well-known", "expansion", "expanding", "mill", "river", "stone_wall", "это", "слово", "словами", "7000", "что"]
    end = [". ", "! ", '." ', "? ", ".\n", ".\n\n", "… "]
    sentence = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 11)))
    texts = [None, "", *("".join(sentence() + r.choice(end) for _ in range(8)) for _ in range(60))]
    stop = "that this with from have were {0}one {0}two {0}six {0}ten"
    own = "quick brown foxes jumped over several lazy sleeping dogs today"
    texts += [f"{stop.format('aaaa')}. {stop.format('bbbb')}.", f"{own}.\n\n{own}.", f"{own}.\n{own}."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in edits.repeated_thesis(docs).collect():
        got.setdefault(x.doc_id, []).append((x.earlier, x.later))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(p) for k, t in enumerate(texts) if (p := plain_repeats(t))}
    assert [got.get(k) for k in (62, 63, 64)] == [None, None, [(0, 1)]]


def test_perplexity_of_uniform_logits_is_the_vocabulary():
    assert np.isclose(edits.perplexity(np.zeros((5, 11)), np.array([1, 4, 2, 0, 3])), 11)
    assert np.isnan(edits.perplexity(np.zeros((1, 3)), np.array([0])))


def test_structure(spark):
    b = spark.createDataFrame([(1, 0, "heading"), (1, 1, "table"), (1, 2, "table"), (1, 3, "heading")], "doc_id long, pos int, type string")
    assert [r.segment for r in structure.segments(b, F.col("type") == "heading").orderBy("pos").collect()] == [1, 1, 1, 2]
    assert [r.number for r in structure.number_captions(b.withColumn("number", F.lit(None).cast("string")), kind="type").orderBy("pos").collect()] == ["1", "1", "2", "2"]
    assert structure.block_counts(b, ["table"]).first().n_table == 2
    d = spark.createDataFrame([(["A", "B"], ["B", "C"], ["a\tb ", "c"], 'x/y: "z"')], "d array<string>, m array<string>, l array<string>, t string")
    r = structure.reference_gaps(d, "d", "m").select("unmentioned", "undeclared", structure.table_rows(F.col("l")).alias("rows"), structure.file_name(F.col("t")).alias("name")).first()
    assert (r.unmentioned, r.undeclared, r.rows, r.name) == (["A"], ["C"], [["a", "b"], ["c", ""]], "x y z")
