"""Exact nearest joins over a tree of cells (`quadtree`), and k-nearest joins over a pyramid of cells.

Level k has cells of edge step * 2**k. For each cell that holds points, the lowest level is taken
at which the 3 x 3 cells around it hold enough targets. That bounds the distance of the k-th
target by the diagonal of two cells, so all candidates lie in the 7 x 7 cells around. Of those,
cells that are farther than the bound are dropped before any point meets any target. Dense areas
end up on fine cells and empty ones on coarse cells; no candidate is left out by a cap.
All joins are equality joins on (level, cell).
"""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from geohour.operators import quadtree
from geohour.operators.cells import Bounds, bounds_of, with_cell
from geohour.operators.shapes import segment_bounds


def _union_bounds(a: Bounds, b: Bounds) -> Bounds:
    return Bounds(min(a.min_x, b.min_x), min(a.min_y, b.min_y),
                  max(a.max_x, b.max_x), max(a.max_y, b.max_y))


def _levels_to_cover(b: Bounds, step: float) -> int:
    extent = max(b.max_x - b.min_x, b.max_y - b.min_y, step)
    return max(math.ceil(math.log2(extent / step)), 0) + 1


def _lift(df: DataFrame, top: int, x: str = "ix", y: str = "iy") -> DataFrame:
    """Repeat each level-0 cell for all levels: (level, cx, cy)."""
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumns({
        "cx": F.expr(f"shiftright({x}, level)"), "cy": F.expr(f"shiftright({y}, level)"),
    })


def _around(df: DataFrame, reach: int, keep: list[str]) -> DataFrame:
    """Repeat each cell for the square of cells around it: (ox, oy) and the offsets."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        df.select(*keep, "level", "cx", "cy", F.explode(span).alias("_dx"))
        .withColumn("_dy", F.explode(span))
        .withColumns({"ox": F.col("cx") + F.col("_dx"), "oy": F.col("cy") + F.col("_dy")})
    )


def _same(left: list[str], right: list[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & (F.col(a) == F.col(b))
    return cond


def _candidate_cells(
    points: DataFrame, targets: DataFrame, need: int, top: int, step: float,
    radius: float | None, within: list[str],
) -> tuple[DataFrame, DataFrame]:
    """Level of each level-0 point cell, and the target cells that can matter for it.

    `points` holds (within, ix, iy); `targets` holds (within, ix, iy, n), n counting targets.
    Returns (within, ix, iy, level, cx, cy) and (within, level, cx, cy, ox, oy).
    """
    other = [f"_o{i}" for i in range(len(within))]
    renamed = [F.col(c).alias(o) for c, o in zip(within, other)]
    occupied = (
        _lift(targets, top).groupBy(*within, "level", "cx", "cy").agg(F.sum("n").alias("n"))
    )
    enough = (
        _around(occupied, 1, [*within, "n"])
        .groupBy(*within, "level", F.col("ox").alias("ex"), F.col("oy").alias("ey"))
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= need)
        .select(*renamed, F.col("level").alias("el"), "ex", "ey")
    )
    asked = points.select(*within, "ix", "iy").distinct()
    hits = _lift(asked, top).join(
        enough, _same([*within, "level", "cx", "cy"], [*other, "el", "ex", "ey"]), "left"
    )
    # Without enough targets on any level the top one is searched.
    chosen = hits.groupBy(*within, "ix", "iy").agg(
        F.coalesce(F.min(F.when(F.col("el").isNotNull(), F.col("level"))), F.lit(top))
        .alias("level")
    ).withColumns({
        "cx": F.expr("shiftright(ix, level)"), "cy": F.expr("shiftright(iy, level)"),
    })
    offsets = (F.abs("_dx"), F.abs("_dy"))
    near2 = sum((F.pow(F.greatest(o - 1, F.lit(0)), 2) for o in offsets), F.lit(0.0))
    far2 = sum((F.pow(o + 1, 2) for o in offsets), F.lit(0.0))
    found = (
        _around(chosen.select(*within, "level", "cx", "cy").distinct(), 3, within)
        .join(occupied.select(*renamed, F.col("level").alias("tl"), F.col("cx").alias("tx"),
                              F.col("cy").alias("ty"), "n"),
              _same([*within, "level", "ox", "oy"], [*other, "tl", "tx", "ty"]))
        .withColumns({"_near2": near2, "_far2": far2})
    )
    # At most 49 rows per cell.
    by_cell = Window.partitionBy(*within, "level", "cx", "cy")
    found = found.withColumn(
        "_seen", F.sum("n").over(by_cell.orderBy("_far2"))
    ).withColumn(
        "_bound2", F.min(F.when(F.col("_seen") >= need, F.col("_far2"))).over(by_cell)
    )
    keep: Column = F.col("_bound2").isNull() | (F.col("_near2") <= F.col("_bound2"))
    if radius is not None:
        edge = F.pow(F.lit(2.0), F.col("level")) * step
        keep = keep & (F.col("_near2") * edge * edge < radius * radius)
    return chosen, found.where(keep).select(*within, "level", "cx", "cy", "ox", "oy")


def _meet(points: DataFrame, chosen: DataFrame, candidates: DataFrame, placed: DataFrame,
          within: list[str]) -> DataFrame:
    """Points with the targets in their candidate cells."""
    return (
        points.join(chosen, [*within, "ix", "iy"])
        .join(candidates, [*within, "level", "cx", "cy"])
        .drop("ix", "iy", "cx", "cy")
        .join(placed, [*within, "level", "ox", "oy"])
        .drop("level", "ox", "oy")
    )


def nearest_distance(
    points: DataFrame, point_id: str, x: str, y: str, segments: DataFrame, feature: str,
    step: float = 100.0, out: str = "distance",
) -> DataFrame:
    """Distance of each point to the nearest segment, with that segment's feature.

    One row per point; of features equally near the one with the smallest id is taken. Without
    any segment the distance is NULL. Crowded places are cut into cells of down to a thousandth
    of `step` (`quadtree`); only the work depends on it, not the result.
    """
    b = bounds_of(points, x, y)
    s = segment_bounds(segments)
    if b.min_x is None or s.min_x is None:
        none = F.lit(None).cast(segments.schema[feature].dataType)
        return points.withColumns({out: F.lit(None).cast("double"), feature: none})
    best = quadtree.nearest(points, point_id, x, y, segments, feature, _union_bounds(b, s), step / 1024)
    best = best.select(F.col(point_id).alias("_id"), F.sqrt("d2").alias(out), feature)
    return points.join(best, F.col(point_id) == F.col("_id"), "left").drop("_id")


def _splits(targets: DataFrame, within: list[str], b: Bounds, radius: float, crowd: int) -> int:
    """How often to halve the radius until no cell holds more than `crowd` targets.

    One number per try comes back. Places closer than the finest cell stay together.
    """
    extent = max(b.max_x - b.min_x, b.max_y - b.min_y, radius)
    finest = int(math.log2(2**30 * radius / extent))
    for splits in (4, 8, 12, 16, 20):
        cells = with_cell(targets, "x", "y", b.min_x, b.min_y, radius / 2**min(splits, finest))
        fullest = cells.groupBy(*within, "ix", "iy").count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= crowd or splits >= finest:
            break
    return min(splits, finest)


# Neighbours per cell and search radius in metres.
NEIGHBOURS = 5
RADIUS = 10_000.0


def knn_radius(
    points: DataFrame, point_id: str, targets: DataFrame, target_id: str,
    k: int = NEIGHBOURS, radius: float = RADIUS, within: list[str] | None = None,
    small_targets: int = 2000,
) -> DataFrame:
    """The k nearest targets of each point at a distance strictly below the radius.

    Both tables hold x and y. `within` names columns (such as a period) both tables share and
    in which they must agree. Equally near targets are ranked by id. Returns the point id, the
    `within` columns, the target id, `distance` and `rank`.

    Where no group of targets is larger than `small_targets`, which is checked, points meet all
    targets of the radius-sized cells around them: so many at most. Longer lists go over the
    pyramid, whose cells get finer where targets are dense.
    """
    within = within or []
    # Of targets at one place only the first k can be among anyone's k nearest.
    here = Window.partitionBy(*within, "x", "y").orderBy(target_id)
    targets = (
        targets.select(*within, target_id, "x", "y").dropna()
        .withColumn("_rn", F.row_number().over(here)).where(F.col("_rn") <= k).drop("_rn")
    )
    points = points.select(*within, point_id, "x", "y").dropna()
    spots = targets.select(*within, target_id, F.col("x").alias("tx"), F.col("y").alias("ty"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    distance = F.sqrt(dx * dx + dy * dy)

    largest = targets.groupBy(*within).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= small_targets:
        reach = F.sequence(F.lit(-1), F.lit(1))
        spread = (
            with_cell(spots, "tx", "ty", 0.0, 0.0, radius)
            .withColumn("ix", F.explode(F.transform(reach, lambda i: F.col("ix") + i)))
            .withColumn("iy", F.explode(F.transform(reach, lambda i: F.col("iy") + i)))
        )
        pairs = with_cell(points, "x", "y", 0.0, 0.0, radius).join(spread, [*within, "ix", "iy"])
    else:
        b = _union_bounds(bounds_of(points), bounds_of(targets))
        splits = _splits(targets, within, b, radius, 16 * k)
        step = radius / 2**splits
        located = with_cell(points, "x", "y", b.min_x, b.min_y, step)
        placed = with_cell(spots, "tx", "ty", b.min_x, b.min_y, step)
        occupied = placed.groupBy(*within, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
        chosen, candidates = _candidate_cells(located, occupied, k, splits, step, radius, within)
        placed = _lift(placed, splits).drop("ix", "iy").withColumnsRenamed(
            {"cx": "ox", "cy": "oy"}
        )
        pairs = _meet(located, chosen, candidates, placed, within)
    nearest = Window.partitionBy(*within, point_id).orderBy("distance", target_id)
    return (
        pairs.withColumn("distance", distance)
        .where(F.col("distance") < radius)
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select(*within, point_id, target_id, "distance", "rank")
    )


def within_radius(
    points: DataFrame, point_id: str, targets: DataFrame, target_id: str, radius: float,
) -> DataFrame:
    """Every (point, target) closer than the radius, with `distance`; x and y of both tables.

    Only targets are repeated, into the radius-sized cells around their own.
    """
    spots = targets.select(target_id, F.col("x").alias("tx"), F.col("y").alias("ty")).dropna().distinct()
    reach = F.sequence(F.lit(-1), F.lit(1))
    spread = (
        with_cell(spots, "tx", "ty", 0.0, 0.0, radius)
        .withColumn("ix", F.explode(F.transform(reach, lambda i: F.col("ix") + i)))
        .withColumn("iy", F.explode(F.transform(reach, lambda i: F.col("iy") + i)))
    )
    asked = with_cell(points.select(point_id, "x", "y").dropna(), "x", "y", 0.0, 0.0, radius)
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    return (
        asked.join(spread, ["ix", "iy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
        .where(F.col("distance") < radius).select(point_id, target_id, "tx", "ty", "distance")
    )


def nearest_over_time(candidates: DataFrame, point_id: str, target_id: str, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of the targets present at each step, as stretches [first, last] of steps.

    `candidates` holds (point, target, distance, first, last): a target is near a point from
    step first to step last; its stretches do not overlap. Openings and closings are sorted by
    point and step and swept once, so a stretch is cut only where the point's own k nearest
    change. Held at a time are the targets present around one point.
    """
    opens = candidates.select(point_id, F.col("first").alias("step"), F.lit(1).alias("kind"), "distance", target_id)
    closes = candidates.select(
        point_id, (F.col("last") + 1).alias("step"), F.lit(0).alias("kind"), "distance", target_id)
    events = opens.unionByName(closes).repartition(point_id).sortWithinPartitions(point_id, "step", "kind")

    def sweep(batches):
        point = step = None
        present: list[tuple] = []
        since: dict[tuple, int] = {}
        out: list[tuple] = []

        def settle():
            top = set(present[:k])
            for t in [t for t in since if t not in top]:
                out.append((point, t[1], t[0], since.pop(t), step - 1))
            for t in top:
                since.setdefault(t, step)

        for batch in batches:
            for p, at, kind, distance, target in zip(*(c.to_pylist() for c in batch.columns)):
                if point is not None and (p, at) != (point, step):
                    settle()
                point, step = p, at
                if kind:
                    bisect.insort(present, (distance, target))
                else:
                    present.remove((distance, target))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                out = []
        if point is not None:
            settle()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    kinds = candidates.select(point_id, target_id, "distance", "first", "last").schema
    names, schema = kinds.names, to_arrow_schema(kinds)
    return events.mapInArrow(sweep, kinds)
