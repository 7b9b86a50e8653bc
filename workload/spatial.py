"""Cells, polygons, nearest and k-nearest joins, interpolation, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from geohour.functions import projection as proj
from geohour.operators.cells import Bounds, bbox_filter as keep_in_box, join_cells
from geohour.operators.cells import total_bounds as bounds_table, with_cell
from geohour.operators.idw import idw_interpolate
from geohour.operators.nearest import knn_radius, nearest_distance
from geohour.operators.shapes import (
    LINE_TYPES, LINES_TYPE, explode_vertices, geometry_filter, polygon_cells,
)
from geohour.plans.terrain import grid_lonlat
from geohour.plans.water import sensor_cells
from workload import stage
from workload.registry import query, table
from workload.stage import STEP

POINTS_SQL = f"(SELECT c_custkey, c_custkey * {stage.CUSTOMER_GAP}::DOUBLE AS x, c_acctbal AS y FROM customer)"
GAUGES_SQL = f"(SELECT s_suppkey, s_suppkey * {stage.SUPPLIER_GAP}::DOUBLE AS x, s_acctbal AS y FROM supplier)"


@query("total_bounds", f"""
    SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM {POINTS_SQL}""")
def total_bounds(spark, d):
    return bounds_table(stage.customer_points(spark, d))


@query("bbox_filter", """
    SELECT c_custkey, c_nationkey, c_acctbal FROM customer
    WHERE c_nationkey BETWEEN 5 AND 15 AND c_acctbal BETWEEN 1000 AND 4000""")
def bbox_filter(spark, d):
    # On the stored columns themselves, so that the box reaches the file scan.
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    box = Bounds(5, 1000.0, 15, 4000.0)
    return keep_in_box(rows, box, "c_nationkey", "c_nationkey", "c_acctbal", "c_acctbal")


@query("spatial_point_cell", f"""
    WITH {stage.CITY_SQL}
    SELECT c_custkey, grid_id FROM {POINTS_SQL} p, bounds, grid
    WHERE grid.ix = floor((p.x - min_x) / {STEP}) AND grid.iy = floor((p.y - min_y) / {STEP})""")
def spatial_point_cell(spark, d):
    grid, b = stage.city(spark, d)
    points = with_cell(stage.customer_points(spark, d), "x", "y", b.min_x, b.min_y, STEP)
    return join_cells(points, grid).select("c_custkey", "grid_id")


@query("spatial_point_cell_left", f"""
    WITH {stage.CITY_SQL}
    SELECT s_suppkey, grid_id FROM {GAUGES_SQL} p CROSS JOIN bounds LEFT JOIN grid
    ON grid.ix = floor((p.x - 60 - min_x) / {STEP}) AND grid.iy = floor((p.y - min_y) / {STEP})""")
def spatial_point_cell_left(spark, d):
    grid, b = stage.city(spark, d)
    moved = stage.supplier_points(spark, d).withColumn("x", F.col("x") - 60)
    points = with_cell(moved, "x", "y", b.min_x, b.min_y, STEP)
    return join_cells(points, grid, "left").select("s_suppkey", "grid_id")


@query("spatial_polygon_cell", f"""
    WITH {stage.SHAPES_SQL}
    SELECT feature_id, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy
    FROM ({stage.DISTRICT_CELLS_SQL})""")
def spatial_polygon_cell(spark, d):
    edges = stage.segments(stage.district_polygons(spark, d))
    return polygon_cells(edges, "feature_id", 0.0, 0.0, STEP)


@query("grid_generate", f"WITH {stage.CITY_SQL} SELECT * FROM grid")
def grid(spark, d):
    return stage.city(spark, d)[0]


@query("explode_vertices", """
    SELECT vec_id, CAST(0 AS INTEGER) AS line, CAST(i - 1 AS INTEGER) AS seq,
           CAST(i - 1 AS DOUBLE) AS x, CAST(embedding[i] AS DOUBLE) AS y
    FROM embeddings, unnest(generate_series(1, len(embedding))) t(i)""")
def vertices(spark, d):
    line = F.transform("embedding", lambda v, i: F.struct(
        i.cast("double").alias("x"), v.cast("double").alias("y")
    ))
    lines = table(spark, d, "embeddings").select("vec_id", F.array(line).cast(LINES_TYPE).alias("lines"))
    return explode_vertices(lines, "lines", ["vec_id"])


@query("geom_type_filter", """
    SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'LineString' ELSE 'MultiLineString' END AS geom_type
    FROM supplier WHERE s_nationkey % 5 IN (0, 1) AND s_suppkey % 3 > 0""")
def geom_type_filter(spark, d):
    # Lines, surfaces, points and no type; a third of each has no coordinates: none, or an empty list.
    types = F.array(*[F.lit(t) for t in (*LINE_TYPES, "Polygon", "Point", None)])
    point = F.struct(F.col("s_acctbal").alias("x"), F.col("s_acctbal").alias("y"))
    some = F.array(F.array(point, point))
    coords = F.when(F.col("s_suppkey") % 3 > 0, some).when(F.col("s_suppkey") % 6 == 0, F.array().cast(LINES_TYPE))
    rows = table(spark, d, "supplier").withColumns({
        "geom_type": F.get(types, (F.col("s_nationkey") % 5).cast("int")), "lines": coords.cast(LINES_TYPE)})
    return geometry_filter(rows, LINE_TYPES, "geom_type", "lines").select("s_suppkey", "geom_type")


SEGMENT_ROWS_SQL = f"""
    {stage.side_rows("(SELECT feature_id, cx, cy, r FROM poly WHERE s_nationkey < 13)", "d")}
    UNION ALL {stage.side_rows(
        f"(SELECT feature_id, cx + 2 * r AS cx, cy, {stage.SIDE_ARM}::DOUBLE AS r FROM poly WHERE s_nationkey < 13)",
        "d", part="1")}
    UNION ALL {stage.side_rows("frame", "s")} UNION ALL {stage.side_rows("frame", "s", "h", ring="1")}"""


@query("polygon_segments", f"WITH {stage.SHAPES_SQL}, {stage.SEGMENTS_SQL} {SEGMENT_ROWS_SQL}")
def polygon_segments(spark, d):
    return stage.segments(stage.district_polygons(spark, d))


DISTANCE_SQL = """
    sqrt((px - x1 - t * (x2 - x1)) * (px - x1 - t * (x2 - x1))
         + (py - y1 - t * (y2 - y1)) * (py - y1 - t * (y2 - y1)))"""
CLAMP_SQL = """
    least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1))
          / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1)"""


@query("nearest_distance", f"""
    WITH {stage.SHAPES_SQL}, {stage.SEGMENTS_SQL}, seg AS ({SEGMENT_ROWS_SQL}),
         pairs AS (SELECT c_custkey, feature_id, {DISTANCE_SQL} AS dist FROM
                   (SELECT *, {CLAMP_SQL} AS t FROM
                    (SELECT c_custkey, x AS px, y AS py FROM {POINTS_SQL}), seg))
    SELECT c_custkey, round(min(dist), 6) AS distance,
           arg_min(feature_id, {{'dist': dist, 'feature_id': feature_id}}) AS feature_id
    FROM pairs GROUP BY c_custkey""")
def nearest(spark, d):
    edges = stage.segments(stage.district_polygons(spark, d))
    near = nearest_distance(stage.customer_points(spark, d), "c_custkey", "x", "y", edges,
                            "feature_id", STEP)
    return near.select("c_custkey", F.round("distance", 6).alias("distance"), "feature_id")


KNN_SQL = f"""
    SELECT * FROM (SELECT c_custkey, s_suppkey, dist AS distance,
                          row_number() OVER (PARTITION BY c_custkey ORDER BY dist, s_suppkey) AS rank
                   FROM (SELECT c_custkey, s_suppkey,
                                sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS dist
                         FROM {POINTS_SQL} p, {GAUGES_SQL} g) WHERE dist < {stage.KNN_RADIUS})
    WHERE rank <= 5"""


def neighbours(spark, d):
    return knn_radius(stage.customer_points(spark, d), "c_custkey",
                      stage.supplier_points(spark, d), "s_suppkey", 5, stage.KNN_RADIUS)


@query("knn_radius", f"""
    SELECT c_custkey, s_suppkey, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
    FROM ({KNN_SQL})""")
def knn(spark, d):
    return neighbours(spark, d).withColumn("distance", F.round("distance", 6))


@query("idw_interpolate", f"""
    WITH v AS (SELECT l_suppkey AS s_suppkey, avg(l_quantity) AS quantity,
                      avg(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 AND l_tax > 0.07
                               THEN l_discount END) AS returned
               FROM lineitem GROUP BY l_suppkey)
    SELECT c_custkey, round(sum(w * quantity) / sum(w), 6) AS quantity,
           round(sum(w * returned) / nullif(sum(w) FILTER (returned IS NOT NULL), 0), 6) AS returned
    FROM (SELECT *, 1.0 / (distance * distance + 1e-12) AS w FROM ({KNN_SQL})) LEFT JOIN v USING (s_suppkey)
    GROUP BY c_custkey""")
def idw(spark, d):
    late = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45) & (F.col("l_tax") > 0.07)
    values = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.avg("l_quantity").alias("quantity"),
        F.avg(F.when(late, F.col("l_discount"))).alias("returned"),
    )
    out = idw_interpolate(neighbours(spark, d), values, "c_custkey", "s_suppkey",
                          ("quantity", "returned"))
    return out.withColumns({c: F.round(c, 6) for c in ("quantity", "returned")})


# ---- projections ----------------------------------------------------------------------------

def _grid_sql(source: str, grid: proj.TransverseMercator, out: str) -> str:
    """Snyder 8-9, 8-10 and 3-21 over a source with (id, lon, lat), in the textbook's form."""
    e2, ep2, a, k0 = proj.E2, proj.EP2, proj.SEMI_MAJOR, grid.k0
    m0, m2, m4, m6 = proj.meridian_coefficients()

    def arc(phi):
        return (f"{a} * ({m0} * {phi} - {m2} * sin(2 * {phi}) + {m4} * sin(4 * {phi}) "
                f"- {m6} * sin(6 * {phi}))")

    return f"""
    SELECT id, {grid.false_east} + {k0} * n * (a1 + (1 - t + c) * a1**3 / 6
               + (5 - 18 * t + t * t + 72 * c - 58 * {ep2}) * a1**5 / 120) AS {out}_x,
           {grid.false_north} + {k0} * (m - {proj.meridian_arc(proj.math.radians(grid.lat0))}
               + n * tan(phi) * (a1**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a1**4 / 24
               + (61 - 58 * t + t * t + 600 * c - 330 * {ep2}) * a1**6 / 720)) AS {out}_y
    FROM (SELECT id, phi, {a} / sqrt(1 - {e2} * sin(phi)**2) AS n, tan(phi)**2 AS t,
                 {ep2} * cos(phi)**2 AS c, radians(lon - {grid.lon0}) * cos(phi) AS a1,
                 {arc('phi')} AS m
          FROM (SELECT id, lon, radians(lat) AS phi FROM {source}))"""


LONLAT_SQL = """(SELECT c_custkey AS id, 126.0 + (c_custkey % 1000) / 500.0 AS lon,
                        37.0 + (c_acctbal + 1000) / 11000 AS lat FROM customer)"""


@query("reproject", f"""
    WITH lonlat AS {LONLAT_SQL},
         a AS ({_grid_sql("lonlat", proj.GRIDS[5179], "k")}),
         b AS ({_grid_sql("lonlat", proj.GRIDS[5186], "m")})
    SELECT id, round(k_x, 3) AS k_x, round(k_y, 3) AS k_y, round(m_x, 3) AS m_x,
           round(m_y, 3) AS m_y, true AS back_agrees,
           round({proj.SEMI_MAJOR} * radians(lon), 3) AS web_x,
           round({proj.SEMI_MAJOR} * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS web_y
    FROM lonlat JOIN a USING (id) JOIN b USING (id)""")
def reproject(spark, d):
    df = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.lit(126.0) + (F.col("c_custkey") % 1000) / 500.0).alias("lon"),
        (F.lit(37.0) + (F.col("c_acctbal") + 1000) / 11000).alias("lat"),
    )
    df = proj.reproject(df, "lon", "lat", 4326, 5179, ("k_x", "k_y"))
    df = proj.reproject(df, "lon", "lat", 4326, 5186, ("m_x", "m_y"))
    # A file that names no reference system is in 5186; this goes back through lon/lat.
    df = proj.reproject(df, "m_x", "m_y", None, 5179, ("back_x", "back_y"))
    df = proj.reproject(df, "lon", "lat", 4326, 3857, ("web_x", "web_y"))
    agrees = (F.abs(F.col("back_x") - F.col("k_x")) < 1e-3) & (
        F.abs(F.col("back_y") - F.col("k_y")) < 1e-3)
    return df.select("id", agrees.alias("back_agrees"), *[F.round(c, 3).alias(c) for c in (
        "k_x", "k_y", "m_x", "m_y", "web_x", "web_y")])


PLACE_SQL = """(SELECT {key} AS id, 126.0 + ({key} % 1000) / 500.0 AS lon, 37.0 + ({value} + 1000) / 11000 AS lat
    FROM {table})"""
MAP_STEP = 10_000.0


def placed(spark, d, name, key, value):
    return table(spark, d, name).select(
        F.col(key).cast("string").alias("sensor_id"), (F.lit(126.0) + (F.col(key) % 1000) / 500.0).alias("lon"),
        (F.lit(37.0) + (F.col(value) + 1000) / 11000).alias("lat"))


@query("sensor_map", f"""
    WITH c AS {PLACE_SQL.format(key="c_custkey", value="c_acctbal", table="customer")},
         s AS {PLACE_SQL.format(key="s_suppkey", value="s_acctbal", table="supplier")},
         cm AS ({_grid_sql("c", proj.GRIDS[5179], "k")}), sm AS ({_grid_sql("s", proj.GRIDS[5179], "k")}),
         grid AS (SELECT DISTINCT floor(k_x / {MAP_STEP}) AS ix, floor(k_y / {MAP_STEP}) AS iy FROM sm)
    SELECT CAST(c.id AS VARCHAR) AS sensor_id, round(lat, 9) AS lat, round(lon, 9) AS lon,
           CAST(ix * 1000 + iy AS BIGINT) AS grid_id
    FROM c JOIN cm USING (id)
         LEFT JOIN grid ON ix = floor(k_x / {MAP_STEP}) AND iy = floor(k_y / {MAP_STEP})""")
def sensor_map(spark, d):
    """Cells that hold a supplier, and the sensors (customers) that lie in them."""
    points = proj.reproject(placed(spark, d, "supplier", "s_suppkey", "s_acctbal"), "lon", "lat", 4326, 5179, ("x", "y"))
    cells = with_cell(points, "x", "y", 0.0, 0.0, MAP_STEP).select("ix", "iy").distinct()
    grid = cells.withColumn("grid_id", F.col("ix").cast("long") * 1000 + F.col("iy"))
    sensors = placed(spark, d, "customer", "c_custkey", "c_acctbal")
    out = sensor_cells(sensors, grid, 0.0, 0.0, MAP_STEP)
    return out.withColumns({c: F.round(c, 9) for c in ("lat", "lon")})


@query("grid_lonlat", f"WITH {stage.CITY_SQL} SELECT grid_id, true AS in_korea, true AS back_agrees FROM grid")
def cell_lonlat(spark, d):
    """Lon and lat of each cell's centre, with the way back."""
    grid = stage.city(spark, d)[0].withColumns({"cx": F.col("cx") + 955_000.0, "cy": F.col("cy") + 1_944_000.0})
    back = proj.reproject(grid_lonlat(grid), "lon", "lat", 4326, 5179, ("bx", "by"))
    agrees = (F.abs(F.col("bx") - F.col("cx")) < 1e-3) & (F.abs(F.col("by") - F.col("cy")) < 1e-3)
    inside = F.col("lon").between(120, 135) & F.col("lat").between(30, 45)
    return back.select("grid_id", inside.alias("in_korea"), agrees.alias("back_agrees"))
