"""Grids of tables against a plain placement of cells."""

import random

from lexiflow.operators import tables as T

CELL = "doc long, row int, at int, col_span int, row_span int, text string"


def plain(cells):
    """(problem, columns by (row, at)): cells put on a grid one by one."""
    rows = {}
    for row, at, cs, rs, _ in sorted(cells):
        rows.setdefault(row, []).append((at, 1 if cs is None else cs, 1 if rs is None else rs))
    n = max(rows) + 1
    if n > 1000 or max(map(len, rows.values())) > 30:
        return "too large", {}
    taken, columns = set(), {}
    for row in sorted(rows):
        x = 0
        for at, cs, rs in rows[row]:
            while (row, x) in taken:
                x += 1
            down = n - row if rs == 0 else rs
            if cs < 1 or down < 1 or x + cs > 30 or row + down > n:
                return "overlap", {}
            new = {(y, z) for y in range(row, row + down) for z in range(x, x + cs)}
            if new & taken:
                return "overlap", {}
            taken |= new
            columns[row, at] = x, down
            x += cs
    width = max(x for _, x in taken) + 1
    return (None, columns) if len(taken) == width * n else ("ragged", {})


def tiled(r):
    """Cells that tile a grid, in source order."""
    h, w = r.randint(1, 7), r.randint(1, 6)
    free, out = {(y, x) for y in range(h) for x in range(w)}, []
    for y in range(h):
        at = 0
        for x in range(w):
            if (y, x) in free:
                cs = rs = 1
                while x + cs < w and (y, x + cs) in free and r.random() < 0.4:
                    cs += 1
                while y + rs < h and all((y + rs, x + k) in free for k in range(cs)) and r.random() < 0.4:
                    rs += 1
                free -= {(y + a, x + b) for a in range(rs) for b in range(cs)}
                out.append((y, at, cs, 0 if y + rs == h and r.random() < 0.3 else rs, f"{y},{x}"))
                at += 1
    return out


def test_cells_find_their_columns(spark):
    r = random.Random(2)
    docs = {k: tiled(r) for k in range(40)}
    for k in range(40, 80):  # and some that fit nowhere
        cells = tiled(r)
        i = r.randrange(len(cells))
        y, at, cs, rs, t = cells[i]
        cells[i] = (y, at, cs + r.choice([0, 1, 40, -1]), r.choice([rs, rs + 1, None, 9]), t)
        docs[k] = cells
    docs |= {80: [(0, i, 1, 1, "x") for i in range(31)], 81: [(0, 0, None, None, None)], 82: [(1001, 0, 1, 1, "far")], 83: [(0, 0, 30, 1, "wide"), (1, 0, 15, 1, "l"), (1, 1, 15, 1, None)]}
    rows = [(k, *c) for k, cells in docs.items() for c in cells]
    got = T.placed(spark.createDataFrame([*rows, (None, 0, 0, 1, 1, "x"), (5, None, 0, 1, 1, "x"), rows[0]], CELL), ["doc"]).collect()
    assert len(got) == len(rows)
    for k, cells in docs.items():
        problem, columns = plain(cells)
        own = [x for x in got if x.doc == k]
        assert {x.problem for x in own} == {problem}, k
        if problem is None:
            assert {(x.row, x.at): (x.column, x.row_span) for x in own} == columns
        else:
            assert all(x.column is None for x in own)
    assert {plain(c)[0] for c in docs.values()} == {None, "overlap", "ragged", "too large"}
    assert T.placed(spark.createDataFrame([], CELL), ["doc"]).count() == 0


def test_matrix(spark):
    cells = [(1, 0, 0, 2, 1, "head"), (1, 0, 1, 1, 2, "tall"), (1, 1, 0, 1, 1, "a"), (1, 1, 1, 1, 1, None), (2, 0, 0, 1, 1, "x"), (2, 1, 0, 2, 1, "ragged")]
    got = T.matrix(T.placed(spark.createDataFrame(cells, CELL), ["doc"]), ["doc"]).orderBy("row").collect()
    assert [(x.doc, x.row, x.values) for x in got] == [(1, 0, ["head", "", "tall"]), (1, 1, ["a", "", ""])]


def test_merged_cells_of_word(spark):
    rows = [
        (1, 0, 0, 1, "restart", "a"), (1, 0, 1, 2, None, "b"), (1, 1, 0, 1, "continue", ""), (1, 1, 1, 2, "restart", "c"), (1, 2, 0, 1, "continue", " "), (1, 2, 1, 2, "continue", None),
        (2, 0, 0, 1, None, "a"), (2, 1, 0, 1, "continue", ""), (3, 0, 0, 1, "restart", "a"), (3, 1, 0, 1, "continue", "text"), (4, 0, 0, 2, None, "a"), (4, 1, 0, None, None, "b"), (5, 0, 0, 1, "restart", "a"), (5, 2, 0, 1, "continue", ""),
    ]
    got = T.merged(spark.createDataFrame(rows, "doc long, row int, at int, col_span int, merge string, text string"), ["doc"]).orderBy("doc", "row", "at").collect()
    assert [(x.column, x.col_span, x.row_span, x.text, x.problem) for x in got if x.doc == 1] == [(0, 1, 3, "a", None), (1, 2, 1, "b", None), (1, 2, 2, "c", None)]
    assert {x.doc: x.problem for x in got if x.doc > 1} == {2: "broken merge", 3: "broken merge", 4: "ragged", 5: "broken merge"}
