"""What the joins of documents move: lists of rows as bits, no texts, and short marks instead of sketches."""

import random

import pytest

from lexiflow.llm import chosen_path, ngram_join
from lexiflow.llm.graph import among


@pytest.fixture
def shuffling(spark):
    """Nothing is small enough to be sent to all tasks unless it is asked for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def docs(spark):
    r = random.Random(5)
    texts = []
    for i in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(80)]
        texts.append((2 * i, " ".join(words)))
        words[40] = "other"
        texts.append((2 * i + 1, " ".join(words) if i % 2 else " ".join(f"u{r.randrange(10**6)}" for _ in range(80))))
    return spark.createDataFrame(texts, "doc_id long, text string")


def plans(monkeypatch, module) -> list[tuple[list[str], str]]:
    """Columns and plan of what ``module`` writes down from here on."""
    seen, write = [], module.stash
    monkeypatch.setattr(module, "stash", lambda df: seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or write(df))
    return seen


def test_rows_are_told_by_bits(spark):
    ids = [0, 1, 62, 63, 64, 127, 128, (1 << 40) + 31, (1 << 40) + 32, (5 << 40) + 63, (1 << 62) + 63]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "rid long, text string")
    for some in (ids[::2], ids[1::2] * 2, ids, [], [2, 65]):
        rids = spark.createDataFrame([(i,) for i in some], "rid long")
        for how, want in (("left_semi", set(some) & set(ids)), ("left_anti", set(ids) - set(some))):
            got = among(rows, rids, how)
            assert got.columns == ["rid", "text"] and sorted(r.rid for r in got.collect()) == sorted(want)


def test_candidates_are_found_without_moving_texts_or_sets(docs, shuffling, monkeypatch):
    seen = plans(monkeypatch, ngram_join)
    rows = ngram_join.ngram_components(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - 1 if i % 4 == 3 else i for i in range(120)}
    own = [plan for columns, plan in seen if "tokens" in columns]
    assert len(own) == 2 and not any("SortMergeJoin" in p or "Exchange hashpartitioning" in p for p in own)


def test_sketches_and_texts_stay_where_they_are(docs, shuffling, monkeypatch):
    for name in ("_first_alike", "_compared"):
        monkeypatch.setattr(chosen_path, name, lambda rows, sets, p, of=getattr(chosen_path, name): of(rows, sets.drop("sketch"), p))
    seen = plans(monkeypatch, chosen_path)
    rows = chosen_path.chosen_path_components(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - 1 if i % 4 == 3 else i for i in range(120)}
    texts = [plan for columns, plan in seen if columns == ["rid", "text"]]
    assert texts and not any("SortMergeJoin" in p for p in texts)
