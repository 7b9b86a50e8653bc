"""One small city made of the driver's tables, for the spatial and composite queries.

Customers and suppliers lie in a plane whose width grows with their number, so that densities
stay the same at every scale factor. Each supplier owns a district polygon (two diamonds, or a
square frame with a hole) and a river diamond; each error event is a flooded diamond. The oracle
tests these shapes in closed form, not by edges and crossings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geohour.functions.temporal import floor_hour
from geohour.operators.cells import Bounds
from geohour.operators.rolling import RAIN_FEATURES, rain_features
from geohour.operators.shapes import PARTS_TYPE, ring_segments, segment_bounds
from geohour.plans.terrain import grid_generate
from geohour.session import materialize
from workload.registry import table

CUSTOMER_GAP, SUPPLIER_GAP, STATION_GAP = 7.0, 105.0, 70.0
STEP = 100.0
KNN_RADIUS = 2000.0
RIVER_REACH, FLOOD_REACH, SIDE_ARM = 90.0, 20.0, 40.0


def customer_points(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        "c_custkey", (F.col("c_custkey") * CUSTOMER_GAP).alias("x"), F.col("c_acctbal").alias("y")
    )


def supplier_points(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") * SUPPLIER_GAP).alias("x"), F.col("s_acctbal").alias("y")
    )


def _ring(*points: tuple[Column, Column]) -> Column:
    closed = [*points, points[0]]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in closed])


def _diamond(cx: Column, cy: Column, r: Column) -> Column:
    return _ring((cx - r, cy), (cx, cy + r), (cx + r, cy), (cx, cy - r))


def _square(cx: Column, cy: Column, r: Column) -> Column:
    return _ring((cx - r, cy - r), (cx - r, cy + r), (cx + r, cy + r), (cx + r, cy - r))


def district_polygons(spark, d) -> DataFrame:
    cx = F.col("s_suppkey") * SUPPLIER_GAP
    cy = F.floor("s_acctbal").cast("double")
    r = (60 + 5 * F.col("s_nationkey")).cast("double")
    pair = F.array(
        F.array(_diamond(cx, cy, r)), F.array(_diamond(cx + 2 * r, cy, F.lit(SIDE_ARM)))
    )
    frame = F.array(F.array(_square(cx, cy, 2 * r), _square(cx, cy, r)))
    parts = F.when(F.col("s_nationkey") < 13, pair).otherwise(frame)
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("feature_id"), "s_nationkey", parts.cast(PARTS_TYPE).alias("parts")
    )


def river_polygons(spark, d) -> DataFrame:
    cx = F.col("s_suppkey") * SUPPLIER_GAP + 300
    cy = F.floor("s_acctbal").cast("double") - 200
    parts = F.array(F.array(_diamond(cx, cy, F.lit(RIVER_REACH))))
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("feature_id"), parts.cast(PARTS_TYPE).alias("parts")
    )


def flood_polygons(spark, d) -> DataFrame:
    errors = table(spark, d, "events").where(F.col("event_type") == "error")
    cx = F.col("user_id") * STATION_GAP
    cy = F.floor(F.col("value") * 20).cast("double")
    k = F.from_json("props", "k int")["k"]
    end = F.col("ts") + F.make_dt_interval(F.lit(0), k - 10)
    return errors.select(
        F.col("event_id").alias("feature_id"), F.col("ts").alias("start_ts"),
        F.when(k < 90, end).alias("end_ts"),
        F.array(F.array(_diamond(cx, cy, F.lit(FLOOD_REACH)))).cast(PARTS_TYPE).alias("parts"),
    )


def segments(polygons: DataFrame) -> DataFrame:
    return ring_segments(polygons, "feature_id", "parts")


def city(spark, d) -> tuple[DataFrame, Bounds]:
    """Numbered grid over the districts and its bounds."""
    edges = segments(district_polygons(spark, d))
    b = segment_bounds(edges)
    return materialize(grid_generate(edges, STEP, b), "grid"), b


def stations(spark, d) -> DataFrame:
    """Periods of each station: 48 hours from each view, at the place of the like-numbered customer."""
    views = table(spark, d, "events").where(F.col("event_type") == "view").select(
        F.col("user_id").alias("station"), F.col("ts").alias("start_date"),
        (F.col("ts") + F.expr("INTERVAL 48 HOUR")).alias("expired_date"),
    )
    place = table(spark, d, "customer").select(
        F.col("c_custkey").alias("station"), F.col("c_acctbal").alias("y")
    )
    return views.join(place, "station").withColumn("x", F.col("station") * STATION_GAP)


def hourly_rain(spark, d) -> DataFrame:
    """(station, time) with its largest value above 30 as rain."""
    rain = F.greatest(F.max("value") - 30, F.lit(0.0)).cast("float")
    return table(spark, d, "events").groupBy(
        F.col("user_id").alias("station"), floor_hour("ts").alias("time")
    ).agg(rain.alias("rain_1h"))


def rain_with_features(spark, d) -> DataFrame:
    return materialize(rain_features(hourly_rain(spark, d)), "rain")


# ---- the same stage as oracle SQL ----------------------------------------------------------

SHAPES_SQL = f"""
    poly AS (SELECT s_suppkey AS feature_id, s_nationkey, s_suppkey * {SUPPLIER_GAP}::DOUBLE AS cx,
                    floor(s_acctbal) AS cy, (60 + 5 * s_nationkey)::DOUBLE AS r FROM supplier),
    diamond AS (SELECT feature_id, cx, cy, r FROM poly WHERE s_nationkey < 13
                UNION ALL SELECT feature_id, cx + 2 * r, cy, {SIDE_ARM}::DOUBLE FROM poly
                WHERE s_nationkey < 13),
    frame AS (SELECT feature_id, cx, cy, 2 * r AS r, r AS h FROM poly WHERE s_nationkey >= 13),
    river AS (SELECT feature_id, cx + 300 AS cx, cy - 200 AS cy, {RIVER_REACH}::DOUBLE AS r FROM poly),
    flood AS (SELECT event_id AS feature_id, user_id * {STATION_GAP}::DOUBLE AS cx,
                     floor(value * 20) AS cy, {FLOOD_REACH}::DOUBLE AS r, ts AS start_ts,
                     CASE WHEN k < 90 THEN ts + (k - 10) * INTERVAL 1 HOUR END AS end_ts
              FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
                    WHERE event_type = 'error'))"""


def box_cells(shape: str, x0: str, y0: str) -> str:
    """Candidate cells of the boxes around shapes with centre (cx, cy) and reach r."""
    def span(c: str, o: str) -> str:
        return (f"unnest(generate_series(CAST(floor(({c} - r - {o}) / {STEP}) AS INTEGER) - 1, "
                f"CAST(floor(({c} + r - {o}) / {STEP}) AS INTEGER) + 1))")

    return (f"(SELECT *, {x0} + ix * {STEP} AS lx, {y0} + iy * {STEP} AS ly FROM "
            f"(SELECT *, {span('cy', y0)} AS iy FROM (SELECT *, {span('cx', x0)} AS ix FROM {shape})))")


GAP_X = f"greatest(lx - cx, 0, cx - lx - {STEP})"
GAP_Y = f"greatest(ly - cy, 0, cy - ly - {STEP})"


def diamond_cells(shape: str, x0: str, y0: str, columns: str = "feature_id, ix, iy") -> str:
    return f"SELECT DISTINCT {columns} FROM {box_cells(shape, x0, y0)} WHERE {GAP_X} + {GAP_Y} <= r"


def frame_cells(x0: str, y0: str) -> str:
    in_hole = (f"lx > cx - h AND lx + {STEP} < cx + h AND ly > cy - h AND ly + {STEP} < cy + h")
    return (f"SELECT DISTINCT feature_id, ix, iy FROM {box_cells('frame', x0, y0)} "
            f"WHERE {GAP_X} <= r AND {GAP_Y} <= r AND NOT ({in_hole})")


DISTRICT_CELLS_SQL = f"{diamond_cells('diamond', '0', '0')} UNION {frame_cells('0', '0')}"

ORIGIN_X, ORIGIN_Y = "(SELECT min_x FROM bounds)", "(SELECT min_y FROM bounds)"
CITY_SQL = f"""{SHAPES_SQL},
    bounds AS (SELECT min(cx - r) AS min_x, min(cy - r) AS min_y, max(cx + r) AS max_x,
                      max(cy + r) AS max_y
               FROM (SELECT cx, cy, r FROM diamond UNION ALL SELECT cx, cy, r FROM frame)),
    hit AS (SELECT DISTINCT ix, iy FROM
            ({diamond_cells('diamond', ORIGIN_X, ORIGIN_Y)} UNION {frame_cells(ORIGIN_X, ORIGIN_Y)})),
    grid AS (SELECT CAST(row_number() OVER (ORDER BY ix, iy) - 1 AS INTEGER) AS grid_id,
                    CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy,
                    min_x + ix * {STEP} AS x0, min_y + iy * {STEP} AS y0,
                    min_x + ix * {STEP} + {STEP} / 2 AS cx, min_y + iy * {STEP} + {STEP} / 2 AS cy
             FROM hit, bounds
             WHERE ix >= 0 AND iy >= 0 AND min_x + ix * {STEP} < max_x
               AND min_y + iy * {STEP} < max_y)"""

# Corners of the diamonds and squares, joined to segments.
SEGMENTS_SQL = """
    corner AS (SELECT * FROM (VALUES ('d', 0, -1, 0), ('d', 1, 0, 1), ('d', 2, 1, 0), ('d', 3, 0, -1),
                                     ('s', 0, -1, -1), ('s', 1, -1, 1), ('s', 2, 1, 1), ('s', 3, 1, -1))
               t(kind, seq, ux, uy)),
    side AS (SELECT a.kind, a.seq, a.ux, a.uy, b.ux AS vx, b.uy AS vy
             FROM corner a JOIN corner b ON a.kind = b.kind AND b.seq = (a.seq + 1) % 4)"""


def side_rows(shape: str, kind: str, reach: str = "r", part: str = "0", ring: str = "0") -> str:
    return (f"SELECT feature_id, {part} AS part, {ring} AS ring, seq, cx + ux * {reach} AS x1, "
            f"cy + uy * {reach} AS y1, cx + vx * {reach} AS x2, cy + vy * {reach} AS y2 "
            f"FROM {shape}, side WHERE side.kind = '{kind}'")


FLOOD_CELLS_SQL = f"""
    flooded AS (SELECT DISTINCT grid_id, start_ts, end_ts, feature_id
                FROM ({diamond_cells('flood', ORIGIN_X, ORIGIN_Y,
                                     'feature_id, ix, iy, start_ts, end_ts')}) JOIN grid USING (ix, iy)),
    once AS (SELECT grid_id, start_ts, end_ts FROM flooded
             QUALIFY row_number() OVER (PARTITION BY grid_id, start_ts ORDER BY feature_id) = 1),
    history AS (SELECT grid_id, start_ts, end_ts, CASE WHEN once.grid_id IS NULL THEN 0 ELSE 1 END
                       AS is_flooded FROM grid LEFT JOIN once USING (grid_id))"""


def hours_back(hours: int) -> str:
    return (f"OVER (PARTITION BY station ORDER BY time RANGE BETWEEN INTERVAL '{hours - 1} hours 59 "
            "minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)")


RAIN_SQL = f"""
    rain0 AS (SELECT user_id AS station, date_trunc('hour', ts) AS time,
                     CAST(greatest(max(value) - 30, 0) AS FLOAT) AS rain_1h FROM events GROUP BY ALL),
    rain AS (SELECT station, time, rain_1h,
                    CAST(sum(rain_1h::DOUBLE) {hours_back(3)} AS FLOAT) AS rain_3h,
                    CAST(sum(rain_1h::DOUBLE) {hours_back(6)} AS FLOAT) AS rain_6h,
                    CAST(sum(rain_1h::DOUBLE) {hours_back(12)} AS FLOAT) AS rain_12h,
                    CAST(sum(rain_1h::DOUBLE) {hours_back(24)} AS FLOAT) AS rain_24h,
                    CAST(avg(rain_1h::DOUBLE) {hours_back(3)} AS FLOAT) AS rain_intensity,
                    max(rain_1h) {hours_back(3)} AS rain_max_3h FROM rain0)"""


def weighted(name: str) -> str:
    return (f"CAST(sum(w * {name}::DOUBLE) / nullif(sum(w) FILTER ({name} IS NOT NULL), 0) AS FLOAT) "
            f"AS {name}")


GRID_RAIN_SQL = f"""
    station AS (SELECT user_id AS station, ts AS start_date, ts + INTERVAL 48 HOUR AS expired_date,
                       user_id * {STATION_GAP}::DOUBLE AS x, c_acctbal AS y
                FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'view'),
    wet AS (SELECT DISTINCT grid_id FROM history WHERE start_ts IS NOT NULL AND end_ts IS NOT NULL),
    cell AS (SELECT grid_id, cx AS x, cy AS y FROM grid SEMI JOIN wet USING (grid_id)),
    hour0 AS (SELECT time FROM rain WHERE rain_1h > 0
              UNION SELECT unnest(generate_series(date_trunc('hour', start_ts),
                                                  date_trunc('hour', end_ts), INTERVAL 1 HOUR))
              FROM history WHERE end_ts >= start_ts),
    bp AS (SELECT start_date AS t FROM station UNION SELECT expired_date FROM station),
    active AS (SELECT DISTINCT t, station, x, y FROM bp JOIN station
               ON start_date <= t AND expired_date > t),
    slot AS (SELECT h.time, p.t AS period FROM (SELECT DISTINCT time FROM rain SEMI JOIN hour0 USING (time)) h
             ASOF JOIN (SELECT DISTINCT t FROM active) p ON h.time >= p.t),
    near AS (SELECT period, grid_id, station, 1.0 / (dist * dist + 1e-12) AS w FROM
             (SELECT t AS period, grid_id, station,
                     sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y)) AS dist
              FROM (SELECT * FROM active SEMI JOIN slot ON t = period) a JOIN cell c
              ON abs(c.x - a.x) < {KNN_RADIUS} AND abs(c.y - a.y) < {KNN_RADIUS})
             WHERE dist < {KNN_RADIUS}
             QUALIFY row_number() OVER (PARTITION BY period, grid_id ORDER BY dist, station) <= 5),
    grid_rain AS (SELECT cell.grid_id, slot.time, {", ".join(weighted(f) for f in RAIN_FEATURES)}
                  FROM slot CROSS JOIN cell
                  LEFT JOIN near ON near.period = slot.period AND near.grid_id = cell.grid_id
                  LEFT JOIN rain ON rain.station = near.station AND rain.time = slot.time
                  GROUP BY ALL)"""
