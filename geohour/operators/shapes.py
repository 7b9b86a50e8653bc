"""Lines and polygons as rows of segments, and the cells they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geohour.operators.cells import CELL_STEP, Bounds

LINE_TYPES = ("LineString", "MultiLineString")
POLYGON_TYPES = ("Polygon", "MultiPolygon")

POINT = "struct<x:double,y:double>"
LINES_TYPE = f"array<array<{POINT}>>"
PARTS_TYPE = f"array<{LINES_TYPE}>"


def geometry_filter(df: DataFrame, types: tuple[str, ...], geom_type: str, coords: str):
    """Rows of the given geometry types with coordinates."""
    return df.where(F.col(geom_type).isin(*types) & (F.size(coords) > 0))


def explode_vertices(df: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    """One row per vertex of an array of lines."""
    return (
        df.select(*keep, F.posexplode(lines).alias("line", "_line"))
        .select(*keep, "line", F.posexplode("_line").alias("seq", "_p"))
        .select(*keep, "line", "seq", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    )


def _pairs(ring: Column) -> Column:
    n = F.size(ring)
    heads = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
    ))


def ring_segments(df: DataFrame, feature: str, parts: str, keep: list[str] | None = None):
    """Boundary of polygons (array of parts, each an array of closed rings) as segments.

    Empty rings give no rows.
    """
    keep = [feature, *(keep or [])]
    return (
        df.select(*keep, F.posexplode(parts).alias("part", "_rings"))
        .select(*keep, "part", F.posexplode("_rings").alias("ring", "_ring"))
        .select(*keep, "part", "ring", F.posexplode(_pairs(F.col("_ring"))).alias("seq", "_s"))
        .select(*keep, "part", "ring", "seq", "_s.*")
    )


def _first_touching(v: Column, origin: float, step: float) -> Column:
    return (F.ceil((v - origin) / step) - 1).cast("int")


def _last_touching(v: Column, origin: float, step: float) -> Column:
    return F.floor((v - origin) / step).cast("int")


def edge_cells(segments: DataFrame, x0: float, y0: float, step: float = CELL_STEP) -> DataFrame:
    """Add the closed cells each segment touches: one row per segment and cell.

    A segment is cut at the columns of the grid it crosses, so the number of candidates grows
    with its length and not with the area of its box. Every candidate is then tested exactly.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    columns = segments.withColumn("ix", F.explode(F.sequence(
        _first_touching(left, x0, step), _last_touching(right, x0, step)
    )))
    slab = F.lit(x0) + F.col("ix") * step
    slope = (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))
    at_left = y1 + (F.greatest(left, slab) - x1) * slope
    at_right = y1 + (F.least(right, slab + step) - x1) * slope
    cut_low = F.coalesce(F.least(at_left, at_right), low)
    cut_high = F.coalesce(F.greatest(at_left, at_right), high)
    # One row of slack for rounding at the cuts; the exact test below removes what is too much.
    first = F.greatest(_first_touching(cut_low, y0, step) - 1, _first_touching(low, y0, step))
    last = F.least(_last_touching(cut_high, y0, step) + 1, _last_touching(high, y0, step))
    cells = columns.withColumns({"_first": first, "_last": last}).where(
        F.col("_first") <= F.col("_last")
    ).withColumn("iy", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    bottom = F.lit(y0) + F.col("iy") * step

    def side(px: Column, py: Column) -> Column:
        return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)

    sides = [side(px, py) for px in (slab, slab + step) for py in (bottom, bottom + step)]
    return cells.where((F.least(*sides) <= 0) & (F.greatest(*sides) >= 0))


def interior_cells(
    segments: DataFrame, group: list[str], x0: float, y0: float, step: float = CELL_STEP
) -> DataFrame:
    """Cells whose centre lies inside, by even-odd crossings along each row of centres.

    Runs of cells between a crossing and the next one are generated, never tested one by one.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    low, high = F.least(y1, y2), F.greatest(y1, y2)

    def first_row(v: Column) -> Column:
        return F.ceil((v - y0) / step - 0.5).cast("int")

    rows = segments.withColumns({"_first": first_row(low), "_last": first_row(high) - 1}).where(
        F.col("_first") <= F.col("_last")
    ).withColumn("iy", F.explode(F.sequence("_first", "_last")))
    centre = F.lit(y0) + (F.col("iy") + 0.5) * step
    crossing = x1 + (centre - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
    along = Window.partitionBy(*group, "iy").orderBy("_x")
    runs = (
        rows.select(*group, "iy", crossing.alias("_x"))
        .withColumns({"_rn": F.row_number().over(along), "_next": F.lead("_x").over(along)})
        .where((F.col("_rn") % 2 == 1) & F.col("_next").isNotNull())
        .withColumns({
            "_from": F.ceil((F.col("_x") - x0) / step - 0.5).cast("int"),
            "_to": F.floor((F.col("_next") - x0) / step - 0.5).cast("int"),
        })
        .where(F.col("_from") <= F.col("_to"))
    )
    return runs.select(*group, F.explode(F.sequence("_from", "_to")).alias("ix"), "iy")


def polygon_cells(
    segments: DataFrame, feature: str, x0: float, y0: float, step: float = CELL_STEP
) -> DataFrame:
    """(feature, ix, iy) for every closed cell that meets the polygon; touching counts."""
    touched = edge_cells(segments, x0, y0, step).select(feature, "ix", "iy")
    inside = interior_cells(segments, [feature, "part"], x0, y0, step).select(feature, "ix", "iy")
    return touched.unionByName(inside).distinct()


def covering_grid(
    segments: DataFrame, b: Bounds, step: float = CELL_STEP, feature: str = "feature_id"
) -> DataFrame:
    """Cells of the grid over the bounds that meet any polygon: (ix, iy), distinct.

    The grid starts at the lower-left bound and stops before the upper one.
    """
    hit = polygon_cells(segments, feature, b.min_x, b.min_y, step)
    corner_x = F.lit(b.min_x) + F.col("ix") * step
    corner_y = F.lit(b.min_y) + F.col("iy") * step
    return hit.where(
        (F.col("ix") >= 0) & (F.col("iy") >= 0) & (corner_x < b.max_x) & (corner_y < b.max_y)
    ).select("ix", "iy").distinct()


def segment_bounds(segments: DataFrame) -> Bounds:
    row = segments.agg(
        F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")),
        F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2")),
    ).first()
    return Bounds(*row)


def point_segment_distance2(x: Column, y: Column) -> Column:
    """Squared distance from a point to the segment (x1, y1)-(x2, y2)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = ((x - x1) * dx + (y - y1) * dy) / F.nullif(length2, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return ex * ex + ey * ey
