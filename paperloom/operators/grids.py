"""SRC-16, LAY-06: the grid of tables: where cells stand, over how many columns and rows, and how wide they are.

Cells are rows (table keys, row, cell, span, merged, ...); a cell's column is the sum of the spans before it in its row,
and a cell that goes on over rows below gathers those that continue it, by windows over a row and over a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Twips of a column that nothing else is said of.
CELL_WIDTH = 1800


def cells_of(blocks: DataFrame, keys: tuple[str, ...] = ("paper_id", "block_pos")) -> DataFrame:
    """A row for each cell of tables read (column grid)."""
    cells = blocks.where("grid is not null").select(*keys, F.col("grid.cols").alias("cols"), F.col("grid.bordered").alias("table_bordered"), F.explode("grid.cells").alias("c"))
    return cells.select(*keys, "cols", "c.row", "c.cell", "c.span", "c.merged", F.coalesce("c.bordered", "table_bordered").alias("bordered"), "c.paragraphs")


def widths(declared: Column, n: Column, most: Column | int) -> Column:
    """Declared column widths where there is one for each column, or else even ones; narrowed to what there is room for."""
    even = F.array_repeat(F.round(F.least(F.lit(most).cast("double") if isinstance(most, int) else most.cast("double"), (n * CELL_WIDTH).cast("double")) / n).cast("int"), n.cast("int"))
    own = F.when(F.size(declared) == n, declared).otherwise(even)
    total = F.aggregate(own, F.lit(0), lambda a, w: a + w)
    return F.when(total > most, F.transform(own, lambda w: F.round(w * most / total).cast("int"))).otherwise(own)


def placed(cells: DataFrame, keys: tuple[str, ...], most: int, declared: str | None = None) -> DataFrame:
    """cells with col, down (rows that it covers; 0 for one that continues another) and width."""
    by_row, table = Window.partitionBy(*keys, "row"), Window.partitionBy(*keys)
    rows = cells.withColumn("__end", F.sum("span").over(by_row.orderBy("cell"))).withColumn("col", (F.col("__end") - F.col("span")).cast("int"))
    rows = rows.withColumn("__n", F.max("__end").over(table))
    given = F.col(declared) if declared else F.array().cast("array<int>")
    rows = rows.withColumn("__widths", widths(F.coalesce(given, F.array().cast("array<int>")), F.col("__n"), most))
    continues = F.coalesce(F.col("merged") == "continue", F.lit(False))
    column = Window.partitionBy(*keys, "col").orderBy("row")
    rows = rows.withColumn("__island", F.sum(F.when(continues, 0).otherwise(1)).over(column))
    down = F.count("*").over(Window.partitionBy(*keys, "col", "__island")).cast("int")
    width = F.aggregate(F.slice("__widths", F.col("col") + 1, F.col("span")), F.lit(0), lambda a, w: a + w)
    return rows.withColumn("down", F.when(continues, 0).otherwise(down)).withColumn("width", width).drop("__end", "__n", "__widths", "__island")


def rebuilt(cells: DataFrame, keys: tuple[str, ...] = ("paper_id", "block_pos")) -> DataFrame:
    """A grid for each table of cells (row, cell, span, merged, bordered, paragraphs), as the writer takes it."""
    cell = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (("row", "int"), ("cell", "int"), ("span", "int"), ("merged", "string"), ("bordered", "boolean"))), "paragraphs")
    cols = F.first("cols") if "cols" in cells.columns else F.array().cast("array<int>")
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(cell), lambda a, b: F.when(a["row"] * 100_000 + a["cell"] < b["row"] * 100_000 + b["cell"], -1).otherwise(1)).alias("cells"), F.bool_or(F.coalesce("bordered", F.lit(False))).alias("bordered"), cols.alias("cols")).select(*keys, F.struct("cols", "bordered", "cells").alias("grid"))
