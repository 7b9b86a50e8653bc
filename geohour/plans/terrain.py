"""Static layers per cell: grid, elevation, river flag, distance class."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geohour.functions.projection import reproject
from geohour.functions.values import distance_class, distance_label
from geohour.operators.cells import (
    CELL_STEP, Bounds, cell_geometry, join_cells, number_cells, with_cell,
)
from geohour.operators.nearest import nearest_distance
from geohour.operators.shapes import covering_grid, polygon_cells, segment_bounds
from geohour.operators.tables import fill_with_aggregate
from geohour.session import materialize


def grid_generate(segments: DataFrame, step: float = CELL_STEP, b: Bounds | None = None,
                  feature: str = "feature_id") -> DataFrame:
    """Numbered cells that meet the polygons, with corner and centre."""
    b = b or segment_bounds(segments)
    numbered = number_cells(covering_grid(segments, b, step, feature))
    return cell_geometry(numbered, b.min_x, b.min_y, step)


def grid_lonlat(grid: DataFrame, epsg: int = 5179) -> DataFrame:
    """Add the centre's lon and lat."""
    return reproject(grid, "cx", "cy", epsg, 4326, ("lon", "lat"))


def cell_elevation(
    points: DataFrame, grid: DataFrame, x0: float, y0: float, step: float = CELL_STEP,
    closed: bool = False,
) -> DataFrame:
    """Mean elevation of the contour points in each cell.

    Cells without points get the mean of the cell means, not of the points.
    """
    placed = with_cell(points, "x", "y", x0, y0, step, closed)
    # Means per (ix, iy) first: points are reduced before they meet the grid.
    means = placed.groupBy("ix", "iy").agg(F.avg("elevation").alias("elevation"))
    cells = join_cells(means, grid).select("grid_id", "elevation")
    all_cells = materialize(grid.select("grid_id").join(cells, "grid_id", "left"), "elevation")
    return fill_with_aggregate(all_cells, "elevation", F.avg("elevation"))


def intersects_flag(
    grid: DataFrame, segments: DataFrame, x0: float, y0: float, step: float = CELL_STEP,
    feature: str = "feature_id", out: str = "is_river",
) -> DataFrame:
    """1 for cells that meet any of the polygons, else 0."""
    hit = polygon_cells(segments, feature, x0, y0, step).select("ix", "iy").distinct()
    flagged = grid.join(hit.withColumn("_hit", F.lit(1)), ["ix", "iy"], "left")
    return flagged.select("grid_id", F.coalesce("_hit", F.lit(0)).cast("tinyint").alias(out))


def river_distance_class(
    grid: DataFrame, segments: DataFrame, step: float = CELL_STEP, feature: str = "feature_id",
) -> DataFrame:
    """Class and label of the distance from each cell's centre to the nearest bank.

    The distance is to the boundary: it is not 0 inside the river.
    """
    centres = grid.select("grid_id", "cx", "cy")
    near = materialize(
        nearest_distance(centres, "grid_id", "cx", "cy", segments, feature, step), "bank-distance"
    )
    near = fill_with_aggregate(near, "distance", F.max("distance"))
    return near.select(
        "grid_id", "distance", distance_class("distance").alias("distance_class"),
        distance_label("distance").alias("distance_label"),
    )
