"""Square cells as two integers. A point finds its cell by arithmetic, without an index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: cell edge in metres.
CELL_STEP = 100.0


class Bounds(NamedTuple):
    min_x: float
    min_y: float
    max_x: float
    max_y: float


def total_bounds(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"),
        F.max(x).alias("max_x"), F.max(y).alias("max_y"),
    )


def bounds_of(df: DataFrame, x: str = "x", y: str = "y") -> Bounds:
    """The four numbers, on the driver: they fix a grid's origin and size."""
    return Bounds(*total_bounds(df, x, y).first())


def bbox_filter(df: DataFrame, b: Bounds, min_x="x", max_x="x", min_y="y", max_y="y") -> DataFrame:
    """Rows whose box meets the given one; plain comparisons, which reach the file scan."""
    return df.where(
        (F.col(max_x) >= b.min_x) & (F.col(min_x) <= b.max_x)
        & (F.col(max_y) >= b.min_y) & (F.col(min_y) <= b.max_y)
    )


def cell_no(v: Column | str, origin: float, step: float) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.floor((v - F.lit(origin)) / F.lit(step)).cast("int")


def with_cell(
    df: DataFrame, x: str, y: str, x0: float, y0: float, step: float = CELL_STEP,
    closed: bool = False, out: tuple[str, str] = ("ix", "iy"),
) -> DataFrame:
    """Add the cell of each point. Cells are half-open: a shared edge belongs to the upper one.

    With `closed=True` a point on an edge gives one row for every cell that touches it.
    """
    if not closed:
        return df.withColumns({out[0]: cell_no(x, x0, step), out[1]: cell_no(y, y0, step)})

    def touched(v: str, origin: float) -> Column:
        pos = (F.col(v) - origin) / step
        return F.explode(F.sequence((F.ceil(pos) - 1).cast("int"), F.floor(pos).cast("int")))

    return df.withColumn(out[0], touched(x, x0)).withColumn(out[1], touched(y, y0)).where(
        F.col(out[0]).isNotNull() & F.col(out[1]).isNotNull()
    )


def cell_geometry(df: DataFrame, x0: float, y0: float, step: float = CELL_STEP) -> DataFrame:
    """Lower-left corner and centre of each cell."""
    return df.withColumns({
        "x0": F.lit(x0) + F.col("ix") * step,
        "y0": F.lit(y0) + F.col("iy") * step,
    }).withColumns({"cx": F.col("x0") + step / 2, "cy": F.col("y0") + step / 2})


def number_cells(cells: DataFrame, first_ix: int = 0) -> DataFrame:
    """Add `grid_id`: 0, 1, 2, ... by column, then by row.

    Rows are ranked inside their column only; the columns' offsets come from one small table.
    """
    per_column = cells.groupBy("ix").agg(F.count(F.lit(1)).alias("_n"))
    # One row per column of the grid: bounded by its extent.
    before = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_column.select(
        F.col("ix").alias("_ix"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    in_column = Window.partitionBy("ix").orderBy("iy")
    return (
        cells.withColumn("_rank", F.row_number().over(in_column))
        .join(offsets, F.col("ix") == F.col("_ix"))
        .withColumn("grid_id", (F.col("_offset") + F.col("_rank") - 1).cast("int"))
        .drop("_rank", "_ix", "_offset")
    )


def join_cells(points: DataFrame, grid: DataFrame, how: str = "inner") -> DataFrame:
    """Points with cells to the grid's `grid_id`, by equality of the cell numbers."""
    return points.join(grid.select("ix", "iy", "grid_id"), ["ix", "iy"], how)
