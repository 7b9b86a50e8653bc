"""Nearest segments over a tree of cells that is as deep as each place needs.

A cell with more than CROWD pieces of segments is cut into FACTOR by FACTOR cells; others stay
whole. So one crowded spot is cut finely and the map around it is not. Segments are cut at cell
borders level by level, only inside crowded cells. The points' cells and the segments' cells are
then followed down together: a pair is dropped when some other cell is surely nearer. What is
left meets as points and segments. All joins are equality joins on cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geohour.operators.cells import Bounds
from geohour.operators.shapes import point_segment_distance2
from geohour.session import materialize

FACTOR = 8
CROWD = 64
SLACK = 1e-9  # share by which bounds may be off through rounding
_CELL = ["level", "cx", "cy"]
_BOX = ("x_lo", "y_lo", "x_hi", "y_hi")


def _edge(square: float, level: int) -> float:
    return square / FACTOR**level


def _cut(pieces: DataFrame, keep: list[str], level: int, origin: tuple[float, float], square: float) -> DataFrame:
    """Pieces of cells of `level` as pieces of the cells below; `t0` to `t1` is the part of the segment."""
    fine = _edge(square, level + 1)

    def crossings(a: str, b: str, cell: str, o: float) -> Column:
        """Where a segment crosses the inner lines of its cell; never for one along them."""
        run = F.nullif(F.col(b) - F.col(a), F.lit(0.0))
        return F.transform(F.sequence(F.lit(1), F.lit(FACTOR - 1)), lambda j: (
            F.lit(o) + (F.col(cell) * FACTOR + j) * fine - F.col(a)) / run)

    inner = F.filter(F.concat(crossings("x1", "x2", "cx", origin[0]), crossings("y1", "y2", "cy", origin[1])),
                     lambda t: (t > F.col("t0")) & (t < F.col("t1")))
    cuts = pieces.withColumn("_cuts", F.array_sort(F.concat(F.array("t0", "t1"), inner)))
    parts = cuts.select(*keep, "cx", "cy", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("_cuts") - 2), lambda i: F.struct(
            F.get("_cuts", i).alias("t0"), F.get("_cuts", i + 1).alias("t1")))).alias("_p"))
    middle = (F.col("_p.t0") + F.col("_p.t1")) / 2

    def below(a: str, b: str, cell: str, o: float) -> Column:
        at = F.floor((F.col(a) + middle * (F.col(b) - F.col(a)) - o) / fine)
        first = F.col(cell) * FACTOR  # rounding must not leave the cell
        return F.least(F.greatest(at, first), first + FACTOR - 1)

    return parts.select(
        *keep, "_p.t0", "_p.t1", F.lit(level + 1).alias("level"),
        below("x1", "x2", "cx", origin[0]).alias("cx"), below("y1", "y2", "cy", origin[1]).alias("cy"))


def _boxes(pieces: DataFrame) -> list[Column]:
    """The box around the pieces of a cell."""
    def ends(a: str, b: str) -> list[Column]:
        return [F.col(a) + F.col(t) * (F.col(b) - F.col(a)) for t in ("t0", "t1")]

    x, y = ends("x1", "x2"), ends("y1", "y2")
    return [F.min(F.least(*x)).alias("x_lo"), F.min(F.least(*y)).alias("y_lo"),
            F.max(F.greatest(*x)).alias("x_hi"), F.max(F.greatest(*y)).alias("y_hi")]


def build(segments: DataFrame, feature: str, b: Bounds, finest: float, crowd: int = CROWD) -> tuple[DataFrame, list[DataFrame], float]:
    """(pieces by leaf, child cells by level, edge of the whole square) of the tree over segments.

    A cell is not cut below `finest`, nor where its pieces lie on top of each other, so that cutting
    it makes many more pieces and leaves the fullest cell as full.
    """
    square = max(b.max_x - b.min_x, b.max_y - b.min_y, finest) * (1 + 1e-6)
    shape = [feature, "x1", "y1", "x2", "y2"]
    same = segments.groupBy("x1", "y1", "x2", "y2").agg(F.min(feature).alias(feature)).dropna(subset=shape[1:])
    zero = F.lit(0).cast("long")
    open_pieces = same.select(*shape, F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.lit(0).alias("level"),
                              zero.alias("cx"), zero.alias("cy"))
    open_pieces = materialize(open_pieces, "quadtree-0")
    leaves, children, level = [], [], 0
    crowded = materialize(open_pieces.groupBy(*_CELL).agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowded-0")
    while _edge(square, level + 1) >= finest and not crowded.isEmpty():
        leaves.append(open_pieces.join(crowded.select(*_CELL), _CELL, "left_anti"))
        cut = materialize(_cut(open_pieces.join(crowded.select(*_CELL), _CELL), shape, level, (b.min_x, b.min_y), square), "cut")
        cells = cut.groupBy(*_CELL).agg(F.count("*").alias("n"), *_boxes(cut))
        cells = cells.withColumns({"px": F.shiftright("cx", 3), "py": F.shiftright("cy", 3)})
        # Pieces on top of each other: what a cut does not part.
        gain = cells.groupBy("px", "py").agg(F.sum("n").alias("total"), F.max("n").alias("most")).join(
            crowded.select(F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("n").alias("whole")), ["px", "py"])
        useless = (F.col("total") > 4 * F.col("whole")) & (F.col("most") > 0.9 * F.col("whole"))
        kept = materialize(gain.where(~useless).select("px", "py"), "split-cells")
        back = gain.where(useless).select(F.lit(level).alias("level"), F.col("px").alias("cx"), F.col("py").alias("cy"))
        leaves.append(open_pieces.join(back, _CELL, "left_semi"))
        cells = materialize(cells.join(kept, ["px", "py"]), f"cells-{level + 1}")
        children.append(cells.drop("n"))
        open_pieces = cut.join(cells.select(*_CELL), _CELL, "left_semi")
        crowded = cells.where(F.col("n") > crowd).select(*_CELL, "n")
        level += 1
    leaves.append(open_pieces)
    whole = leaves[0]
    for more in leaves[1:]:
        whole = whole.unionByName(more)
    return materialize(whole, "leaf-pieces"), children, square


def _gap(near: bool) -> Column:
    """Squared distance between the nearest or farthest places of two boxes."""
    out = F.lit(0.0)
    for d in "xy":
        ahead, behind = F.col(f"{d}_lo") - F.col(f"q{d}_hi"), F.col(f"q{d}_lo") - F.col(f"{d}_hi")
        one = F.greatest(ahead, behind, F.lit(0.0)) if near else F.greatest(
            F.col(f"{d}_hi") - F.col(f"q{d}_lo"), F.col(f"q{d}_hi") - F.col(f"{d}_lo"))
        out = out + one * one
    return out


def nearest(points: DataFrame, point_id: str, x: str, y: str, segments: DataFrame, feature: str, b: Bounds,
            finest: float, crowd: int = CROWD) -> DataFrame:
    """(point_id, d2, feature) of the nearest segment of each point that has both coordinates."""
    pieces, children, square = build(segments, feature, b, finest, crowd)
    depth = len(children)

    def cell(v: str, o: float, level: int) -> Column:
        return F.floor((F.col(v) - o) / _edge(square, level)).cast("long")

    places = points.select(F.col(point_id).alias("_id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).dropna(subset=["px", "py"])
    places = places.withColumns({"qx": cell("px", b.min_x, depth), "qy": cell("py", b.min_y, depth)})
    asked = materialize(places.groupBy("qx", "qy").agg(
        F.min("px").alias("qx_lo"), F.min("py").alias("qy_lo"), F.max("px").alias("qx_hi"), F.max("py").alias("qy_hi")), "asked-cells")
    zero = F.lit(0).cast("long")
    root = segments.sparkSession.range(1)
    pairs = root.select(zero.alias("qx"), zero.alias("qy"), F.lit(0).alias("level"), zero.alias("cx"), zero.alias("cy"),
                        *[F.lit(0.0).alias(c) for c in _BOX])
    q_box = ["qx_lo", "qy_lo", "qx_hi", "qy_hi"]
    for level, cells in enumerate(children):
        shift = 3 * (depth - level - 1)
        mine = asked.groupBy(F.shiftright("qx", shift).alias("qx"), F.shiftright("qy", shift).alias("qy")).agg(
            *[(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in q_box])
        mine = mine.withColumns({"ux": F.shiftright("qx", 3), "uy": F.shiftright("qy", 3)})
        both = pairs.withColumnsRenamed({"qx": "ux", "qy": "uy"}).join(mine, ["ux", "uy"]).drop("ux", "uy")
        # A cell that was cut is replaced by the cells below that hold pieces.
        split = cells.select(F.lit(level).alias("level"), F.col("px").alias("cx"), F.col("py").alias("cy"), F.struct(
            F.col("level"), "cx", "cy", *_BOX).alias("_below"))
        down = both.join(split, _CELL, "left")
        now = F.coalesce("_below", F.struct(*_CELL, *_BOX))
        down = down.withColumn("_now", now).select("qx", "qy", *q_box, "_now.*")
        down = down.withColumn("_bound", F.min(_gap(near=False)).over(Window.partitionBy("qx", "qy")))
        pairs = materialize(down.where(_gap(near=True) <= F.col("_bound") * (1 + SLACK) + (square * SLACK) ** 2)
                            .select("qx", "qy", *_CELL, *_BOX), "cell-pairs")
    met = places.join(pairs.select("qx", "qy", *_CELL), ["qx", "qy"]).drop("qx", "qy").join(pieces.drop("t0", "t1"), _CELL)
    d2 = point_segment_distance2(F.col("px"), F.col("py"))
    return met.groupBy("_id").agg(F.min(F.struct(d2.alias("d2"), feature)).alias("_best")).select(
        F.col("_id").alias(point_id), "_best.d2", F.col(f"_best.{feature}").alias(feature))
