"""A passage that many unlike texts hold doesn't make one large family of them."""

from __future__ import annotations

from dataclasses import replace

from lexiflow.llm import ngram_join


def test_a_shared_passage_is_no_reason_to_pair_all_texts(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = []
    for i in range(24):  # twelve pairs of near copies, each with the passage
        own = [f"w{i // 2}x{k}" for k in range(180)]
        own[90] = f"other{i}"
        texts.append((i, " ".join(own[:100]) + " " + passage + " " + " ".join(own[100:])))
    paired = []
    pairs = ngram_join._pairs
    monkeypatch.setattr(ngram_join, "_pairs", lambda *a: paired.append(a) or pairs(*a))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    # the sample finds no frequent tokens here, as for tokens of middling frequency in a large table
    p = replace(ngram_join.Similar(), family=600, frequent=10**6)
    rows = ngram_join.ngram_components(docs, p).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - i % 2 for i in range(24)}
    assert not paired


def test_copies_count_as_one_set_when_tokens_of_a_set_alone_are_counted(spark):
    docs = spark.createDataFrame([(k, i, " ".join(f"t{i}x{j}" for j in range(300))) for k, i in enumerate((0, 0, 0, 1))], "rid long, doc_id long, text string")
    p = ngram_join.Similar()
    own = {r.id: r.own for r in ngram_join._owned(docs, p).collect()}
    assert len(own) == 2 and all(n > 50 for n in own.values())
