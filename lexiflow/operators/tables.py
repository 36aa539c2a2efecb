"""Tables whose cells span columns and rows: the grid they stand on, and what is wrong with it.

Cells come as rows (table columns, ``row``, ``at``, ``col_span``, ``row_span``, ``text``): where they stand in the source, as in HTML. A cell takes the
first column of its row that no cell from above or before it holds. ``placed`` finds these columns by a fold over the rows
of one table, in which each column knows up to which row it is taken. Word tables say their columns outright and mark merged cells from row to
row; ``merged`` reads them by windows alone.

Scale: tables are independent. A table over the limits is refused before its cells are gathered, so no array exceeds ``MOST_ROWS`` by ``MOST_COLUMNS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows and columns of a table at most.
MOST_ROWS, MOST_COLUMNS = 1000, 30

_STATE = "struct<taken: array<int>, rows: array<array<struct<at: int, column: int, col_span: int, row_span: int>>>, clash: boolean>"


def _row_step(state: Column, row: Column, n_rows: Column) -> Column:
    """The next row of a table: its cells in order, each in the first free column."""
    r = row["row"]

    def cell_step(acc: Column, cell: Column) -> Column:
        taken, cells, clash, start = acc["taken"], acc["cells"], acc["clash"], acc["start"]
        free = F.transform(taken, lambda u, i: (u <= r) & (i >= start))
        column = F.array_position(free, True).cast("int") - 1
        # a span of 0 rows goes down to the table's end
        rows = F.when(cell["row_span"] == 0, n_rows - r).otherwise(cell["row_span"])
        end = column + cell["col_span"]
        bad = (column < 0) | (end > MOST_COLUMNS) | (cell["col_span"] < 1) | (rows < 1) | (r + rows > n_rows)
        held = F.exists(F.transform(taken, lambda u, i: (i >= column) & (i < end) & (u > r)), lambda x: x)
        now = F.transform(taken, lambda u, i: F.when((i >= column) & (i < end), F.greatest(u, r + rows)).otherwise(u))
        placed = F.struct(cell["at"].alias("at"), column.alias("column"), cell["col_span"].alias("col_span"), rows.cast("int").alias("row_span"))
        return F.struct(now.alias("taken"), F.concat(cells, F.array(placed)).alias("cells"), (clash | bad | held).alias("clash"), F.when(column < 0, F.lit(MOST_COLUMNS)).otherwise(end).alias("start"))

    none = F.array().cast("array<struct<at: int, column: int, col_span: int, row_span: int>>")
    start = F.struct(state["taken"].alias("taken"), none.alias("cells"), state["clash"].alias("clash"), F.lit(0).alias("start"))
    done = F.aggregate(row["cells"], start, cell_step)
    # the row is folded once and its parts are taken from it
    return F.element_at(F.transform(F.array(done), lambda d: F.struct(d["taken"].alias("taken"), F.concat(state["rows"], F.array(d["cells"])).alias("rows"), d["clash"].alias("clash"))), 1)


def placed(cells: DataFrame, table: list[str]) -> DataFrame:
    """(*table, row, at, column, col_span, row_span, text, problem): each cell with its column, by HTML's rules.

    Null spans count as 1; a row span of 0 reaches the last row that has cells. Rows count from 0. ``problem`` is the table's: ``too large``, ``overlap`` (spans clash or leave
    the grid), ``ragged`` (slots without a cell), or null; with a problem there are no columns. Cells without a table, row or ``at`` are left out;
    of cells that repeat a place one counts. An empty table of cells gives no rows.
    """
    whole = " and ".join(f"{c} is not null" for c in (*table, "row", "at"))
    own = cells.where(whole).select(*table, F.col("row").cast("int").alias("row"), F.col("at").cast("int").alias("at"), F.coalesce(F.col("col_span"), F.lit(1)).cast("int").alias("col_span"), F.coalesce(F.col("row_span"), F.lit(1)).cast("int").alias("row_span"), "text")
    own = own.dropDuplicates([*table, "row", "at"])
    sizes = own.groupBy(*table, "row").agg(F.count("*").alias("n")).groupBy(*table).agg((F.max("row") + 1).alias("n_rows"), F.max("n").alias("widest"))
    sizes = sizes.withColumn("large", (F.col("n_rows") > MOST_ROWS) | (F.col("widest") > MOST_COLUMNS))
    small = own.join(sizes.where("not large").select(*table, "n_rows"), table)
    lines = small.groupBy(*table, "n_rows", "row").agg(F.array_sort(F.collect_list(F.struct("at", "col_span", "row_span"))).alias("cells"))
    tables = lines.groupBy(*table, "n_rows").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("lines"))
    start = F.struct(F.array_repeat(F.lit(0), MOST_COLUMNS).alias("taken"), F.array().alias("rows"), F.lit(False).alias("clash")).cast(_STATE)
    grid = tables.withColumn("_grid", F.aggregate("lines", start, lambda s, x: _row_step(s, x, F.col("n_rows"))))
    flat = F.flatten("_grid.rows")
    area = F.aggregate(flat, F.lit(0).cast("long"), lambda a, c: a + c["col_span"].cast("long") * c["row_span"])
    width = F.array_max(F.transform(flat, lambda c: c["column"] + c["col_span"]))
    problem = F.when(F.col("_grid.clash"), F.lit("overlap")).when(area != width.cast("long") * F.col("n_rows"), F.lit("ragged"))
    found = grid.select(*table, problem.alias("problem"), F.explode(F.arrays_zip(F.col("lines.row").alias("row"), F.col("_grid.rows").alias("cells"))).alias("_r"))
    found = found.select(*table, "problem", F.col("_r.row").alias("row"), F.explode("_r.cells").alias("_c"))
    ok = F.col("problem").isNull()
    found = found.select(*table, "row", F.col("_c.at").alias("at"), F.when(ok, F.col("_c.column")).alias("column"), F.when(ok, F.col("_c.row_span")).alias("rows_down"), "problem")
    large = sizes.where("large").select(*table, F.lit("too large").alias("why"))
    out = own.join(found, [*table, "row", "at"], "left").join(large, table, "left")
    return out.select(*table, "row", "at", "column", "col_span", F.coalesce("rows_down", "row_span").alias("row_span"), "text", F.coalesce("problem", "why").alias("problem"))


def merged(cells: DataFrame, table: list[str]) -> DataFrame:
    """(*table, row, at, column, col_span, row_span, text, problem): cells of Word tables with the rows they go down.

    ``cells``: row, at, col_span, ``merge`` (``restart``, ``continue`` or null), text. Columns are running sums of spans. A cell that goes on from above joins the cell
    over it, which must start or go on there, have the same span, and stand in the row before; it must be empty. ``problem`` is the
    table's: ``broken merge`` or ``ragged`` (rows of unequal width), else null. Cells that go on give no row of their own.
    """
    whole = " and ".join(f"{c} is not null" for c in (*table, "row", "at"))
    own = cells.where(whole).withColumn("col_span", F.coalesce("col_span", F.lit(1)).cast("long"))
    line = Window.partitionBy(*table, "row").orderBy("at")
    ends = F.sum("col_span").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumns({"column": ends - F.col("col_span"), "_width": F.sum("col_span").over(Window.partitionBy(*table, "row"))})
    down = Window.partitionBy(*table, "column").orderBy("row")
    goes_on = F.col("merge").eqNullSafe("continue")
    above = F.lag(F.struct("row", "col_span", "merge")).over(down)
    kept = above.isNotNull() & (above["row"] == F.col("row") - 1) & (above["col_span"] == F.col("col_span")) & above["merge"].isNotNull()
    own = own.withColumn("_broken", goes_on & (~F.coalesce(kept, F.lit(False)) | (F.trim(F.coalesce("text", F.lit(""))) != "")))
    own = own.withColumn("_group", F.sum(F.when(goes_on, 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    every = Window.partitionBy(*table)
    problem = F.when(F.max("_broken").over(every), F.lit("broken merge")).when(F.min("_width").over(every) != F.max("_width").over(every), F.lit("ragged"))
    own = own.withColumns({"problem": problem, "row_span": F.count("*").over(Window.partitionBy(*table, "column", "_group"))})
    return own.where(~goes_on).select(*table, "row", "at", "column", "col_span", "row_span", "text", "problem")


def matrix(placed: DataFrame, table: list[str]) -> DataFrame:
    """(*table, row, values): the rows of tables without a problem, empty where a cell reaches from elsewhere."""
    own = placed.where("problem is null")
    width = own.groupBy(*table).agg(F.max(F.col("column") + F.col("col_span")).cast("int").alias("width"), F.max(F.col("row") + F.col("row_span")).cast("int").alias("height"))
    rows = width.select(*table, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    texts = own.groupBy(*table, "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("column").cast("int").alias("column"), F.coalesce("text", F.lit("")).alias("text")))).alias("_by"))
    value = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("_by", c), F.lit("")))
    return rows.join(texts, [*table, "row"], "left").select(*table, "row", value.alias("values"))
