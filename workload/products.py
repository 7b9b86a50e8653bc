"""Composite data products on the stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from geohour.operators.cells import with_cell
from geohour.plans import dataset, flood, rain, terrain, water
from geohour.session import materialize
from workload import stage
from workload.registry import query, table
from workload.stage import STEP

YEARS, MONTHS = (2024, 2024), (1, 1)
LOCATED_SQL = """
    located AS (SELECT r.time, r.station, r.rain_1h, s.lat, s.lon
                FROM rain0 r ASOF JOIN
                     (SELECT user_id AS station, ts AS start_date, ts + INTERVAL 24 HOUR AS expired_date,
                             37 + value / 1000 AS lat, 127 + value / 500 AS lon
                      FROM events WHERE event_type = 'view') s
                     ON r.station = s.station AND r.time >= s.start_date
                WHERE month(r.time) BETWEEN 1 AND 1 AND year(r.time) BETWEEN 2024 AND 2024
                  AND r.time < s.expired_date)"""
RAIN0_SQL = """
    rain0 AS (SELECT user_id AS station, date_trunc('hour', ts) AS time,
                     CAST(greatest(max(value) - 30, 0) AS FLOAT) AS rain_1h FROM events GROUP BY ALL)"""


def located(spark, d):
    views = table(spark, d, "events").where(F.col("event_type") == "view").select(
        F.col("user_id").alias("station"), F.col("ts").alias("start_date"),
        (F.col("ts") + F.expr("INTERVAL 24 HOUR")).alias("expired_date"),
        (37 + F.col("value") / 1000).alias("lat"), (127 + F.col("value") / 500).alias("lon"),
    )
    return rain.rain_located(stage.hourly_rain(spark, d), views, MONTHS, YEARS)


@query("rain_located", f"WITH {RAIN0_SQL}, {LOCATED_SQL} SELECT * FROM located")
def rain_located(spark, d):
    return located(spark, d)


@query("rain_features", f"""
    WITH {RAIN0_SQL}, {LOCATED_SQL}
    SELECT time, station, rain_1h, lat, lon,
           CAST(sum(rain_1h::DOUBLE) {stage.hours_back(3)} AS FLOAT) AS rain_3h,
           CAST(sum(rain_1h::DOUBLE) {stage.hours_back(6)} AS FLOAT) AS rain_6h,
           CAST(sum(rain_1h::DOUBLE) {stage.hours_back(12)} AS FLOAT) AS rain_12h,
           CAST(sum(rain_1h::DOUBLE) {stage.hours_back(24)} AS FLOAT) AS rain_24h,
           CAST(avg(rain_1h::DOUBLE) {stage.hours_back(3)} AS FLOAT) AS rain_intensity,
           max(rain_1h) {stage.hours_back(3)} AS rain_max_3h FROM located""")
def rain_features(spark, d):
    return rain.rain_with_features(located(spark, d))


def history_of(spark, d, grid, b):
    history = flood.flood_history(stage.flood_polygons(spark, d), grid, b.min_x, b.min_y, STEP)
    return materialize(history, "flood-history")


@query("flood_history", f"WITH {stage.CITY_SQL}, {stage.FLOOD_CELLS_SQL} SELECT * FROM history")
def flood_history(spark, d):
    grid, b = stage.city(spark, d)
    return history_of(spark, d, grid, b)


def grid_rain_of(spark, d, grid, history):
    cells = grid.select("grid_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return rain.gridded_rain(stage.rain_with_features(spark, d), stage.stations(spark, d), cells,
                             history, radius=stage.KNN_RADIUS)


ALL_RAIN_SQL = (f"{stage.CITY_SQL}, {stage.FLOOD_CELLS_SQL}, {stage.RAIN_SQL}, "
                f"{stage.GRID_RAIN_SQL}")


@query("gridded_rain", f"WITH {ALL_RAIN_SQL} SELECT * FROM grid_rain")
def gridded_rain(spark, d):
    grid, b = stage.city(spark, d)
    return grid_rain_of(spark, d, grid, history_of(spark, d, grid, b))


SENSOR_SQL = f"""
    sensor AS (SELECT s_suppkey, grid_id FROM
               (SELECT s_suppkey, s_suppkey * {stage.SUPPLIER_GAP}::DOUBLE + 100 AS x, s_acctbal AS y FROM supplier)
               CROSS JOIN bounds LEFT JOIN grid
               ON ix = floor((x - min_x) / {STEP}) AND iy = floor((y - min_y) / {STEP})),
    water AS (SELECT date_trunc('hour', ts) AS time, CAST(grid_id AS BIGINT) AS grid_id,
                     CAST(max(CAST(value - 20 AS FLOAT)) AS FLOAT) AS water_level
              FROM events JOIN sensor ON user_id = s_suppkey
              WHERE grid_id IS NOT NULL AND CAST(value - 20 AS FLOAT) >= 0 GROUP BY 1, 2)"""


def sensor_map(spark, d, grid, b):
    moved = stage.supplier_points(spark, d).withColumn("x", F.col("x") + 100)
    placed = with_cell(moved, "x", "y", b.min_x, b.min_y, STEP)
    cells = grid.select("ix", "iy", "grid_id")
    return placed.join(cells, ["ix", "iy"], "left").select(
        F.col("s_suppkey").cast("string").alias("sensor_id"), "grid_id"
    )


def water_of(spark, d, grid, b):
    records = table(spark, d, "events").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("unq_no"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("msrmt_ymd"),
        (F.col("value") - 20).cast("string").alias("msrmt_watl"),
    )
    return water.water_hourly(records, sensor_map(spark, d, grid, b))


@query("water_hourly", f"WITH {stage.CITY_SQL}, {SENSOR_SQL} SELECT * FROM water")
def water_hourly(spark, d):
    grid, b = stage.city(spark, d)
    return water_of(spark, d, grid, b)


ELEVATION_SQL = f"""
    cell_mean AS (SELECT ix, iy, avg(y / 10) AS elevation FROM
                  (SELECT y, floor((x - min_x) / {STEP}) AS ix, floor((y - min_y) / {STEP}) AS iy
                   FROM (SELECT c_custkey * {stage.CUSTOMER_GAP}::DOUBLE AS x, c_acctbal AS y FROM customer),
                        bounds) GROUP BY ix, iy),
    elevation0 AS (SELECT grid_id, elevation FROM grid LEFT JOIN cell_mean USING (ix, iy)),
    elevation AS (SELECT grid_id, round(coalesce(elevation, (SELECT avg(elevation) FROM elevation0)), 6)
                         AS elevation FROM elevation0)"""


def elevation_of(spark, d, grid, b):
    points = stage.customer_points(spark, d).withColumn("elevation", F.col("y") / 10)
    out = terrain.cell_elevation(points, grid, b.min_x, b.min_y, STEP)
    return out.withColumn("elevation", F.round("elevation", 6))


@query("cell_elevation", f"WITH {stage.CITY_SQL}, {ELEVATION_SQL} SELECT * FROM elevation")
def cell_elevation(spark, d):
    grid, b = stage.city(spark, d)
    return elevation_of(spark, d, grid, b)


RIVER_SQL = f"""
    wet_cell AS ({stage.diamond_cells("river", stage.ORIGIN_X, stage.ORIGIN_Y, "ix, iy")}),
    river_flag AS (SELECT grid_id, CAST(wet_cell.ix IS NOT NULL AS TINYINT) AS is_river
                   FROM grid LEFT JOIN wet_cell USING (ix, iy))"""


def river_of(spark, d, grid, b):
    edges = stage.segments(stage.river_polygons(spark, d))
    return terrain.intersects_flag(grid, edges, b.min_x, b.min_y, STEP)


@query("intersects_flag", f"WITH {stage.CITY_SQL}, {RIVER_SQL} SELECT * FROM river_flag")
def intersects_flag(spark, d):
    grid, b = stage.city(spark, d)
    return river_of(spark, d, grid, b)


# Distance of a point to the boundary of the diamond |x| + |y| = r, in closed form: fold to the
# first quadrant, then distance to one edge.
DISTANCE_CLASS_SQL = """
    bank AS (SELECT grid_id, min(sqrt((px - t * r) * (px - t * r)
                                      + (py - (1 - t) * r) * (py - (1 - t) * r))) AS dist
             FROM (SELECT *, least(greatest((px - py + r) / (2 * r), 0), 1) AS t FROM
                   (SELECT grid_id, r, abs(grid.cx - river.cx) AS px, abs(grid.cy - river.cy) AS py
                    FROM grid, river)) GROUP BY grid_id),
    distance AS (SELECT grid_id, round(dist, 6) AS distance,
                        CASE WHEN dist > 500 THEN 2 WHEN dist > 100 THEN 1 ELSE 0 END AS distance_class,
                        CASE WHEN dist > 500 THEN '500m+' WHEN dist > 100 THEN '100-500m'
                             ELSE '0-100m' END AS distance_label FROM bank)"""


def distance_of(spark, d, grid):
    edges = stage.segments(stage.river_polygons(spark, d))
    return terrain.river_distance_class(grid, edges, STEP)


@query("distance_class", f"WITH {stage.CITY_SQL}, {DISTANCE_CLASS_SQL} SELECT * FROM distance")
def distance_class(spark, d):
    grid, _ = stage.city(spark, d)
    return distance_of(spark, d, grid).withColumn("distance", F.round("distance", 6))


@query("assemble_dataset", f"""
    WITH {ALL_RAIN_SQL}, {SENSOR_SQL}, {ELEVATION_SQL}, {RIVER_SQL},
         flood_hour AS (SELECT DISTINCT grid_id, unnest(generate_series(
                            date_trunc('hour', start_ts), date_trunc('hour', end_ts), INTERVAL 1 HOUR)) AS time
                        FROM history WHERE end_ts >= start_ts)
    SELECT grid_rain.*, CAST(flood_hour.grid_id IS NOT NULL AS TINYINT) AS flood, water_level,
           elevation, is_river
    FROM grid_rain LEFT JOIN flood_hour USING (grid_id, time) LEFT JOIN water USING (grid_id, time)
         LEFT JOIN elevation USING (grid_id) LEFT JOIN river_flag USING (grid_id)""")
def assemble_dataset(spark, d):
    grid, b = stage.city(spark, d)
    history = history_of(spark, d, grid, b)
    return dataset.assemble_dataset(
        grid_rain_of(spark, d, grid, history), history, water_of(spark, d, grid, b),
        elevation_of(spark, d, grid, b), river_of(spark, d, grid, b),
    )


@query("assemble_dataset_district", f"""
    WITH {ALL_RAIN_SQL}, {SENSOR_SQL}, {ELEVATION_SQL}, {DISTANCE_CLASS_SQL},
         closed AS (SELECT grid_id, start_ts,
                           coalesce(end_ts, date_trunc('day', start_ts) + INTERVAL 1 DAY) AS end_ts
                    FROM history WHERE is_flooded = 1),
         flood_hour AS (SELECT DISTINCT grid_id, unnest(generate_series(
                            date_trunc('hour', start_ts), date_trunc('hour', end_ts), INTERVAL 1 HOUR)) AS time
                        FROM closed WHERE end_ts >= start_ts)
    SELECT grid_rain.*, CAST(flood_hour.grid_id IS NOT NULL AS TINYINT) AS is_flooded, water_level,
           elevation, distance_class
    FROM grid_rain LEFT JOIN flood_hour USING (grid_id, time) LEFT JOIN water USING (grid_id, time)
         LEFT JOIN elevation USING (grid_id) LEFT JOIN distance USING (grid_id)""")
def assemble_dataset_district(spark, d):
    grid, b = stage.city(spark, d)
    history = history_of(spark, d, grid, b)
    classes = distance_of(spark, d, grid).select("grid_id", "distance_class")
    return dataset.assemble_dataset_district(
        grid_rain_of(spark, d, grid, history), history, water_of(spark, d, grid, b),
        elevation_of(spark, d, grid, b), classes,
    )


@query("flood_clean", """
    SELECT event_id, user_id AS "ADDRESS", value AS "AREA",
           date_trunc('hour', ts) AS start_ts,
           date_trunc('day', ts) + CAST(json_extract(props, '$.k') AS INTEGER) * INTERVAL 1 HOUR AS end_ts
    FROM events WHERE event_type = 'error'""")
def flood_clean(spark, d):
    is_flood = F.col("event_type") == "error"
    day = F.when(is_flood, F.date_format("ts", "yyyyMMdd")).when(
        F.col("event_type") == "view", F.lit("unknown"))
    raw = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("F_ZONE_NM"), F.col("value").alias("F_AREA"),
        F.lit(None).cast("double").alias("F_SHIM"),
        day.alias("F_SAT_YMD"), F.hour("ts").alias("F_SAT_TM"),
        F.date_format("ts", "yyyy-MM-dd").alias("F_END_YMD"),
        F.from_json("props", "k int")["k"].alias("F_END_TM"),
    )
    return flood.flood_clean(raw)


@query("registry_refresh", """
    WITH known AS (SELECT CAST(s_suppkey AS VARCHAR) AS sensor_id, s_name AS location,
                          CASE WHEN s_acctbal > 2000 THEN s_acctbal END AS lat,
                          CASE WHEN s_acctbal > 1000 THEN s_acctbal / 2 END AS lon FROM supplier),
         fresh AS (SELECT CAST(c_custkey AS VARCHAR) AS sensor_id,
                          c_name || ', ' || c_mktsegment AS location FROM customer),
         merged AS (SELECT * FROM known UNION ALL
                    SELECT sensor_id, location, NULL, NULL FROM fresh
                    WHERE sensor_id NOT IN (SELECT sensor_id FROM known)),
         cleaned AS (SELECT *, split_part(location, ',', 1) AS address FROM merged)
    SELECT sensor_id, location,
           CASE WHEN lat IS NULL OR lon IS NULL THEN 37 + length(address) / 100.0::DOUBLE ELSE lat END AS lat,
           CASE WHEN lat IS NULL OR lon IS NULL THEN 127.0::DOUBLE ELSE lon END AS lon FROM cleaned""")
def registry_refresh(spark, d):
    known = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("sensor_id"), F.col("s_name").alias("location"),
        F.when(F.col("s_acctbal") > 2000, F.col("s_acctbal")).alias("lat"),
        F.when(F.col("s_acctbal") > 1000, F.col("s_acctbal") / 2).alias("lon"),
    )
    found = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("sensor_id"),
        F.concat_ws(", ", "c_name", "c_mktsegment").alias("location"),
        F.col("c_custkey").alias("seq"),
    )

    def geocode(address):
        # Stands in for the injected client: a place made of the cleaned address.
        return 37 + len(address) / 100.0, 127.0

    return water.registry_refresh(known, found, geocode)
