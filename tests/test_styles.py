"""Style chains and what elements inherit."""

import random

from lexiflow.operators import styles as S

STYLE = "lib string, style_id string, based_on string, type string, is_default boolean"


def walked(rows):
    """Chains by walking from style to style."""
    known = {}
    for lib, s, b in rows:
        known[lib, s] = b if (lib, s) not in known or known[lib, s] is None or b is not None and b < known[lib, s] else known[lib, s]
    out = set()
    for lib, s in known:
        at, k, seen = s, 0, set()
        while at is not None and (lib, at) in known and at not in seen:
            seen.add(at)
            out.add((lib, s, at, k))
            at, k = known[lib, at], k + 1
    return out


def test_chains_against_walks(spark):
    r = random.Random(1)
    rows = [(lib, f"s{i}", r.choice([None, "gone", *(f"s{r.randrange(80)}" for _ in range(6))])) for lib in "xy" for i in range(80)]
    rows += [("z", f"s{i}", f"s{i + 1}") for i in range(70)] + [("z", "s70", "s50"), ("z", "own", "own"), ("x", "s1", "s2"), (None, "a", "b"), ("x", None, "s3")]
    frame = spark.createDataFrame([(*x, None, None) for x in rows], STYLE)
    want = walked([x for x in rows if None not in x[:2]])
    assert {tuple(x) for x in S.style_chains(frame, ("lib",)).collect()} == want
    cycles = {(x.lib, x.style_id): x.length for x in S.style_cycles(frame.where("lib = 'z'"), ("lib",)).collect()}
    assert cycles == {("z", f"s{i}"): 21 for i in range(50, 71)} | {("z", "own"): 1}
    assert S.style_chains(frame.limit(0), ("lib",)).count() == 0


def test_steps_are_the_logarithm_of_the_longest_chain(spark, monkeypatch):
    frame = spark.range(600).selectExpr("id style_id", "nullif(id - 1, -1) based_on")
    stashed = []
    keep = S.stash
    monkeypatch.setattr(S, "stash", lambda df: stashed.append(1) or keep(df))
    assert S.style_chains(frame).count() == 600 * 601 // 2
    assert len(stashed) <= 2 + 12


def test_nearest_style_decides(spark):
    styles = [("l", "base", None, "paragraph", True), ("l", "mid", "base", "paragraph", False), ("l", "own", "mid", "paragraph", False), ("l", "loop", "pool", "run", True), ("l", "pool", "loop", "run", False)]
    props = [("l", "base", "size", "10"), ("l", "base", "color", "red"), ("l", "mid", "size", "12"), ("l", "own", "color", ""), ("l", "pool", "bold", "on"), ("k", "own", "size", "99")]
    elements = [("l", "e1", "paragraph", "own", {"color": "blue"}), ("l", "e2", "paragraph", None, {}), ("l", "e3", "run", "", {"bold": None}), ("l", "e4", "paragraph", "missing", None)]
    styles = spark.createDataFrame(styles, STYLE)
    props = spark.createDataFrame(props, "lib string, style_id string, name string, value string")
    elements = spark.createDataFrame(elements, "lib string, element string, type string, style_id string, direct map<string, string>")
    defaults = spark.createDataFrame([("l", "paragraph", "align", "left"), ("l", "paragraph", "size", "8")], "lib string, type string, name string, value string")
    got = {(x.element, x.name): (x.value, x.origin) for x in S.applied(elements, styles, props, defaults, ("lib",)).collect()}
    assert got == {
        ("e1", "color"): ("blue", "direct"), ("e1", "size"): ("12", "mid"), ("e1", "align"): ("left", "defaults"), ("e2", "size"): ("10", "base"), ("e2", "color"): ("red", "base"), ("e2", "align"): ("left", "defaults"),
        ("e3", "bold"): ("on", "pool"), ("e4", "size"): ("8", "defaults"), ("e4", "align"): ("left", "defaults"),
    }
