"""Objects moved by hand: logs in any cut of batches, against a plain list."""

import random

from lexiflow.operators import moves as M
from lexiflow.streaming import stores

BLOCK = "doc_id long, pos long, type string, kind string, title string, text string, number string"


def plain(units, log):
    units = [list(u) for u in units]
    for op, unit, direction, title in log:
        at = next((i for i, u in enumerate(units) if u[0] == unit), None)
        if op == "move" and at is not None and units[at][1] in ("table", "figure") and direction in (-1, 1):
            to = at + direction
            if 0 <= to < len(units) and units[to][1] != "heading":
                units[at], units[to] = units[to], units[at]
        if op == "caption" and at is not None and units[at][1] in ("table", "figure"):
            units[at][2] = title
    return [tuple(u) for u in units]


def test_any_cut_of_a_log_gives_one_order(spark, tmp_path):
    r = random.Random(9)
    lists = {k: [(i, r.choice(["table", "figure", "heading", None, None]), None) for i in range(1, r.randint(2, 12))] for k in range(12)}
    log = {k: [(r.choice(["move", "move", "move", "caption", "other"]), r.randint(0, 12), r.choice([-1, 1, 2, None]), r.choice(["t", "", None])) for _ in range(30)] for k in range(11)}
    want = {k: plain(v, log.get(k, [])) for k, v in lists.items()}
    frame = spark.createDataFrame(list(lists.items()), "doc_id long, units array<struct<unit: long, kind: string, title: string>>")
    rows = [(k, s, *e, None) for k, es in log.items() for s, e in enumerate(es, 1)]
    events = spark.createDataFrame(rows, f"doc_id long, seq long, {M.OPERATION}")
    got = {x.doc_id: [tuple(u) for u in x.units] for x in M.replayed(frame, events.drop("units")).collect()}
    assert got == want
    start = spark.createDataFrame([(k, 0, "set", None, None, None, v) for k, v in lists.items()], events.schema)
    for cuts in ([15], [3, 4, 22]):
        store = stores.Store(str(tmp_path / f"s{len(cuts)}"), M.UNIT, M.layout_step, "doc_id", "long", 2)
        for version, (lo, hi) in enumerate(zip([-1, *cuts], [*cuts, 99], strict=True)):
            stores.merge(store, events.unionByName(start).where(f"seq > {lo} and seq <= {hi}"), version)
        assert {x.doc_id: [tuple(u) for u in x.entries] for x in stores.read(spark, store).collect()} == want


def test_units_and_blocks(spark):
    kinds = [("heading", "section"), ("caption", "table"), ("table", None), ("sourceNote", None), ("paragraph", None), ("image", None), ("caption", "figure"), ("sourceNote", None), ("caption", "table"), ("paragraph", None), ("docTable", None), ("image", None)]
    blocks = spark.createDataFrame([(1, i, t, k, f"t{i}" if t == "caption" else None, f"x{i}", None) for i, (t, k) in enumerate(kinds, 1)], BLOCK)
    lists = M.unit_lists(blocks)
    assert [(u.unit, u.kind) for u in lists.first().units] == [(1, "heading"), (2, "table"), (5, None), (6, "figure"), (9, None), (10, None), (11, "table"), (12, "figure")]
    log = spark.createDataFrame([(1, 1, "move", 6, -1, None), (1, 2, "move", 2, -1, None), (1, 3, "caption", 11, None, "new"), (1, 4, "caption", 2, None, "old"), (1, 5, "caption", 12, None, "below")], "doc_id long, seq long, op string, unit long, direction int, title string")
    got = M.arranged(blocks, M.replayed(lists, log)).orderBy("pos").collect()
    assert [x.pos for x in got] == list(range(1, 15))
    assert [(x.type, x.title or x.text) for x in got] == [
        ("heading", "x1"), ("caption", "old"), ("table", "x3"), ("sourceNote", "x4"), ("image", "x6"), ("caption", "t7"), ("sourceNote", "x8"), ("paragraph", "x5"), ("caption", "t9"), ("paragraph", "x10"),
        ("caption", "new"), ("docTable", "x11"), ("image", "x12"), ("caption", "below"),
    ]
