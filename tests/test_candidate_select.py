"""The best candidate of a document is found without moving texts."""

from lexiflow.operators import edits, selection
from lexiflow.plans import registry
from lexiflow.plans.editing import candidate_select


def test_selection_moves_no_texts(spark, monkeypatch):
    rows = [(1, "In order to win, it is important to note that the team works. It works in order to grow."), (2, None), (3, "Plain words."), (3, "Other plain words.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    monkeypatch.setitem(candidate_select.__globals__, "documents", lambda *_: docs)
    assert registry.QUERIES["candidate_select"] is candidate_select
    best = candidate_select(spark, "")
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan[: plan.index("MapInPandas")]  # what is above it is shuffled
    want = edits.select_best(selection.candidate_rows(docs)).drop("text")
    assert best.columns == want.columns == ["doc_id", "cand_no", "score"]
    assert sorted(best.collect()) == sorted(want.collect())
