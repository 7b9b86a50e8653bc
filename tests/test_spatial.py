import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from geohour.operators.cells import Bounds, join_cells, number_cells, with_cell
from geohour.operators.idw import idw_interpolate, idw_over_time
from geohour.operators import quadtree
from geohour.operators.nearest import knn_radius, nearest_distance, nearest_over_time
from geohour.operators.shapes import PARTS_TYPE, covering_grid, polygon_cells, ring_segments
from geohour.plans.terrain import cell_elevation, grid_generate, intersects_flag, river_distance_class

POLYGON = f"feature_id int, parts {PARTS_TYPE}"


def polygons(spark, *shapes):
    return ring_segments(spark.createDataFrame(list(enumerate(shapes)), POLYGON), "feature_id", "parts")


def ring(*points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x0, y1), (x1, y1), (x1, y0))


def cells_of(spark, *shapes):
    return {tuple(r) for r in polygon_cells(polygons(spark, *shapes), "feature_id", 0.0, 0.0).collect()}


def test_point_on_an_edge(spark):
    df = spark.createDataFrame([(100.0, 50.0), (99.9, 200.0), (-0.1, 0.0)], "x double, y double")
    assert rows(with_cell(df, "x", "y", 0.0, 0.0).select("ix", "iy")) == [(-1, 0), (0, 2), (1, 0)]
    closed = with_cell(df, "x", "y", 0.0, 0.0, closed=True).select("ix", "iy")
    assert rows(closed) == sorted([(0, 0), (1, 0), (0, 1), (0, 2), (-1, -1), (-1, 0)], key=str)


def test_hole_cells_are_left_out(spark):
    got = cells_of(spark, [[box(50, 50, 850, 850), box(150, 150, 750, 750)]])
    inside = {(0, x, y) for x in range(2, 7) for y in range(2, 7)}
    assert got == {(0, x, y) for x in range(9) for y in range(9)} - inside


def test_polygon_inside_one_cell_and_touching_corner(spark):
    assert cells_of(spark, [[ring((110, 110), (120, 110), (115, 120))]]) == {(0, 1, 1)}
    touching = cells_of(spark, [[ring((100, 150), (150, 180), (150, 120))]])
    assert touching == {(0, 0, 1), (0, 1, 1)}


def test_parts_of_one_feature(spark):
    got = cells_of(spark, [[box(10, 10, 20, 20)], [box(310, 10, 320, 20)]])
    assert got == {(0, 0, 0), (0, 3, 0)}


def clip_hits(p, q, x, y, s):
    t0, t1 = 0.0, 1.0
    for a, d, lo, hi in ((p[0], q[0] - p[0], x, x + s), (p[1], q[1] - p[1], y, y + s)):
        if d == 0:
            if a < lo or a > hi:
                return False
            continue
        u, v = sorted(((lo - a) / d, (hi - a) / d))
        t0, t1 = max(t0, u), min(t1, v)
        if t0 > t1 + 1e-12:
            return False
    return True


def contains(r, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(r, r[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def random_shapes(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        cx, cy, k = rnd.randrange(0, 2000), rnd.randrange(0, 2000), rnd.randrange(3, 9)
        angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(k))
        out.append(ring(*[
            (round(cx + rnd.randrange(20, 400) * math.cos(a), -1),
             round(cy + rnd.randrange(20, 400) * math.sin(a), -1)) for a in angles]))
    return out


def test_polygon_cells_match_brute_force(spark):
    shapes = random_shapes(25)
    want = {
        (i, ix, iy)
        for i, r in enumerate(shapes) for ix in range(-6, 26) for iy in range(-6, 26)
        if any(clip_hits(p, q, ix * 100.0, iy * 100.0, 100.0) for p, q in zip(r, r[1:]))
        or contains(r, ix * 100.0 + 50, iy * 100.0 + 50)
    }
    assert cells_of(spark, *[[[r]] for r in shapes]) == want


def test_grid_ids_are_dense_and_in_scan_order(spark):
    segments = polygons(spark, [[ring((5, 5), (905, 205), (405, 805))]])
    grid = grid_generate(segments).collect()
    assert [r.grid_id for r in sorted(grid, key=lambda r: (r.ix, r.iy))] == list(range(len(grid)))
    assert min(r.x0 for r in grid) == 5 and all(r.x0 < 905 and r.y0 < 805 for r in grid)


def test_grid_stops_before_the_upper_bound(spark):
    segments = polygons(spark, [[box(0, 0, 300, 200)]])
    assert covering_grid(segments, Bounds(0.0, 0.0, 300.0, 200.0)).count() == 6


def distance(x, y, s):
    (x1, y1), (x2, y2) = s
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / n))
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


def test_nearest_matches_brute_force(spark):
    shapes = random_shapes(30, seed=5)
    segments = polygons(spark, *[[[r]] for r in shapes])
    rnd = random.Random(8)
    points = [(i, rnd.uniform(-3000, 9000), rnd.uniform(-3000, 9000)) for i in range(200)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {r.id: r.distance for r in
           nearest_distance(df, "id", "x", "y", segments, "feature_id", 50.0).collect()}
    edges = [e for r in shapes for e in zip(r, r[1:])]
    for i, x, y in points:
        assert got[i] == pytest.approx(min(distance(x, y, e) for e in edges), abs=1e-9)


def test_nearest_is_to_the_boundary_also_inside(spark):
    segments = polygons(spark, [[box(0, 0, 1000, 1000)]])
    df = spark.createDataFrame([(1, 500.0, 300.0), (2, None, 1.0)], "id int, x double, y double")
    out = nearest_distance(df, "id", "x", "y", segments, "feature_id").select("id", "distance")
    assert rows(out) == [(1, 300.0), (2, None)]


def test_nearest_with_many_copies_of_a_segment(spark):
    copies = spark.range(400).select(
        F.col("id").alias("feature_id"), *[F.lit(v).alias(c) for c, v in
                                           (("x1", 0.0), ("y1", 0.0), ("x2", 0.0), ("y2", 0.0))])
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, 0.0)], "id int, x double, y double")
    out = nearest_distance(df, "id", "x", "y", copies, "feature_id")
    assert rows(out.select("id", "distance", "feature_id")) == [(1, 5.0, 0), (2, 0.0, 0)]


def test_nearest_on_a_sparse_map_with_a_crowded_spot(spark, tmp_path):
    rnd = random.Random(11)
    spot = [(50_000 + rnd.uniform(0, 3), 20_000 + rnd.uniform(0, 3)) for _ in range(3000)]
    lines = [(x, y, x + rnd.uniform(-0.02, 0.02), y + rnd.uniform(-0.02, 0.02)) for x, y in spot]
    lines += [(rnd.uniform(0, 1e5), rnd.uniform(0, 1e5), rnd.uniform(0, 1e5), rnd.uniform(0, 1e5)) for _ in range(12)]
    lines += [(100.0, 5.0, 90_000.0, 70_005.0 + i / 1e6) for i in range(150)]  # on top of each other along the map
    points = [(50_000 + rnd.uniform(-5, 8), 20_000 + rnd.uniform(-5, 8)) for _ in range(150)]
    points += [(rnd.uniform(-1e4, 1.2e5), rnd.uniform(-1e4, 1.2e5)) for _ in range(150)]
    segments = spark.createDataFrame([(i, *e) for i, e in enumerate(lines)], "feature_id int, x1 double, y1 double, x2 double, y2 double")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, x double, y double")
    got = {r.id: (r.distance, r.feature_id) for r in nearest_distance(df, "id", "x", "y", segments, "feature_id").collect()}
    for i, (x, y) in enumerate(points):
        near = sorted((distance(x, y, ((a, b), (c, d))), j) for j, (a, b, c, d) in enumerate(lines))
        assert got[i][0] == pytest.approx(near[0][0], rel=1e-9, abs=1e-9)
        assert got[i][1] in {j for v, j in near if v <= near[0][0] * (1 + 1e-9) + 1e-9}
    b = Bounds(-1e4, -1e4, 1.2e5, 1.2e5)
    pieces, children, _ = quadtree.build(segments, "feature_id", b, 0.01)
    sizes = pieces.groupBy("level", "cx", "cy").agg(F.count("*").alias("n"), F.min("feature_id").alias("first")).collect()
    # Depth follows the place: the spot is cut finely, most cells of the map are not.
    assert max(r.level for r in sizes if r.first < 3000) >= 5 and all(r.n <= quadtree.CROWD for r in sizes if r.first < 3000)
    assert len(sizes) < 3000 and pieces.count() < 12 * len(lines) and len(children) <= 8


def test_nearest_takes_the_smallest_feature_of_equals(spark):
    sides = [(7, 0.0, 1.0, 9.0, 1.0), (3, 0.0, -1.0, 9.0, -1.0), (5, 0.0, 1.0, 9.0, 1.0), (9, 4.0, 5.0, 4.0, 5.0)]
    segments = spark.createDataFrame(sides + [(8, None, 1.0, 2.0, 3.0)], "feature_id int, x1 double, y1 double, x2 double, y2 double")
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, 4.0, 5.0), (3, 4.0, 1.0)], "id int, x double, y double")
    out = nearest_distance(df, "id", "x", "y", segments, "feature_id").select("id", "distance", "feature_id")
    assert rows(out) == [(1, 1.0, 3), (2, 0.0, 9), (3, 0.0, 5)]


def test_nearest_without_features(spark):
    df = spark.createDataFrame([(1, 500.0, 300.0)], "id int, x double, y double")
    none = polygons(spark, [[box(0, 0, 1, 1)]]).where("feature_id = 5")
    assert nearest_distance(df, "id", "x", "y", none, "feature_id").first().distance is None


@pytest.mark.parametrize("small", [2000, 0])
def test_knn_matches_brute_force(spark, small):
    rnd = random.Random(2)
    points = [(i, rnd.uniform(0, 6000), rnd.uniform(0, 6000)) for i in range(150)]
    # A sparse set, a dense strip and many targets at one place.
    targets = ([(rnd.uniform(0, 6000), rnd.uniform(0, 6000)) for _ in range(120)]
               + [(rnd.uniform(0, 6000), 3000 + rnd.random()) for _ in range(200)] + [(1000.0, 1000.0)] * 40)
    targets = [(j, p, x, y) for j, (x, y) in enumerate(targets) for p in ("a", "b") if j % 3 or p == "a"]
    left = spark.createDataFrame([(p, i, x, y) for i, x, y in points for p in ("a", "b")],
                                 "p string, id int, x double, y double")
    right = spark.createDataFrame(targets, "gid int, p string, x double, y double")
    got = {tuple(r) for r in knn_radius(left, "id", right, "gid", 5, 1500.0, ["p"], small)
           .select("p", "id", "rank", "gid").collect()}
    want = set()
    for p in ("a", "b"):
        for i, x, y in points:
            near = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, q, a, b in targets if q == p)
            near = [n for n in near if n[0] < 1500.0][:5]
            want |= {(p, i, r + 1, j) for r, (_, j) in enumerate(near)}
    assert got == want


@pytest.mark.parametrize("small", [2000, 0])
def test_radius_is_strict(spark, small):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    b = spark.createDataFrame([(1, 10.0, 0.0), (2, 0.0, 9.0)], "gid int, x double, y double")
    assert rows(knn_radius(a, "id", b, "gid", 5, 10.0, small_targets=small).select("gid")) == [(2,)]


def test_idw_rules(spark):
    near = spark.createDataFrame(
        [(1, 10, 0.0), (1, 11, 5.0), (2, 11, 5.0), (2, 12, 5.0), (3, 13, 1.0)],
        "cell int, station int, distance double")
    values = spark.createDataFrame([(10, 4.0), (11, 8.0), (12, None)], "station int, v double")
    got = dict(rows(idw_interpolate(near, values, "cell", "station", ("v",))))
    assert got[1] == pytest.approx(4.0, abs=1e-9)  # a gauge at the very place
    assert got[2] == 8.0  # a missing value loses its weight
    assert got[3] is None


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_idw_over_time_keeps_every_cell_and_hour(spark, broadcast_rows):
    from datetime import datetime as dt

    t1, t2 = dt(2020, 7, 1, 1), dt(2020, 7, 1, 2)
    near = spark.createDataFrame([("p", 1, 10, 1.0), ("p", 1, 11, 1.0), ("p", 2, 11, 2.0)],
                                 "period string, cell int, station int, distance double")
    cells = spark.createDataFrame([("p", c) for c in (1, 2, 3)], "period string, cell int")
    values = spark.createDataFrame([(t1, "p", 10, 2.0), (t1, "p", 11, 4.0), (t2, "p", 10, 6.0)],
                                   "time timestamp_ntz, period string, station int, v double")
    out = idw_over_time(near, values, cells, "cell", "station", "time", "period", ("v",),
                        broadcast_rows=broadcast_rows, group_rows=1)
    assert rows(out) == [(1, t1, 3.0), (1, t2, 6.0), (2, t1, 4.0), (2, t2, None), (3, t1, None),
                         (3, t2, None)]


def test_cell_elevation_fills_with_mean_of_cell_means(spark):
    grid = number_cells(spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "ix int, iy int"))
    points = spark.createDataFrame([(10.0, 10.0, 1.0), (20.0, 10.0, 3.0), (110.0, 1.0, 10.0),
                                    (999.0, 1.0, 99.0)], "x double, y double, elevation double")
    assert rows(cell_elevation(points, grid, 0.0, 0.0)) == [(0, 2.0), (1, 10.0), (2, 6.0)]


def test_left_join_keeps_points_outside(spark):
    grid = number_cells(spark.createDataFrame([(0, 0)], "ix int, iy int"))
    points = with_cell(spark.createDataFrame([(1, 5.0, 5.0), (2, 500.0, 5.0)], "id int, x double, y double"),
                       "x", "y", 0.0, 0.0)
    assert rows(join_cells(points, grid, "left").select("id", "grid_id")) == [(1, 0), (2, None)]


def test_river_layers(spark):
    grid = grid_generate(polygons(spark, [[box(0, 0, 1200, 100)]]))
    river = polygons(spark, [[box(110, 10, 190, 90)]])
    flags = dict(rows(intersects_flag(grid, river, 0.0, 0.0)))
    assert [flags[i] for i in range(12)] == [0, 1] + [0] * 10
    classes = river_distance_class(grid, river)
    got = {r.grid_id: (r.distance, r.distance_class) for r in classes.collect()}
    assert got[0] == (60.0, 0) and got[1] == (40.0, 0) and got[2] == (60.0, 0)
    assert got[3] == (160.0, 1) and got[7] == (560.0, 2)


def test_nearest_over_time_equals_a_search_at_each_step(spark):
    import random

    rnd = random.Random(3)
    rows_, steps = [], 40
    for cell in range(6):
        for station in range(12):
            at, distance = 0, float(rnd.randint(1, 6))
            while at < steps:
                first = at + rnd.randint(0, 6)
                last = min(first + rnd.randint(0, 9), steps - 1)
                if first < steps:
                    rows_.append((cell, station, distance, first, last))
                at = last + 1 + rnd.randint(0, 3)
    df = spark.createDataFrame(rows_, "cell int, station int, distance double, first int, last int")
    got = set()
    for c, s, d, first, last in rows(nearest_over_time(df, "cell", "station", 3)):
        got |= {(c, t, s, d) for t in range(first, last + 1)}
    want = set()
    for cell in range(6):
        for t in range(steps):
            here = sorted((d, s) for c, s, d, a, b in rows_ if c == cell and a <= t <= b)[:3]
            want |= {(cell, t, s, d) for d, s in here}
    assert got == want
