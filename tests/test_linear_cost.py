"""Work that has to be done once a text or a part, not once for each word or package."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexiflow.operators import candidates, edits
from lexiflow.sources import packages


def test_small_parts_of_packages_are_checked_once(monkeypatch):
    raw = [packages.packed([{"type": "paragraph", "level": 0, "text": f"Text {k}."}]) for k in range(5)]
    seen = []
    scanned = packages.scanned
    monkeypatch.setattr(packages, "scanned", lambda x: seen.append(x) or scanned(x))
    assert [packages.Package(x).blocks()[0][3] for x in raw] == [f"Text {k}." for k in range(5)]
    assert sum(b"<w:document" in x for x in seen) == 5  # each document once
    assert len(seen) <= 5 + 7  # of the other parts at most one scan each, two of the styles


def test_the_language_is_told_once_for_a_vocabulary(spark):
    lang = F.when(F.length("t") - F.length(F.regexp_replace("t", "q+", "")) > 0, "ru").otherwise("en")
    frame = spark.createDataFrame([("walking horses barked",)], "t string").select(candidates.vocabulary(F.col("t"), lang).alias("v"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(t#") == 1
    assert frame.first().v == ["bark", "horse", "walk"] or frame.first().v == ["bark", "hors", "walk"]


def test_common_subsequences_of_words_that_recur():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    dice = random.Random(5)
    for _ in range(200):
        a, b = ([dice.choice("abcd") for _ in range(dice.randrange(70))] for _ in range(2))
        assert edits.lcs(a, b) == plain(a, b)
    assert edits.lcs(["a"] * 4000, ["a"] * 4000) == 4000  # sixteen million pairs of equal words
