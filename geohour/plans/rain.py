"""Rain products: located hourly rain, rolling features, rain on the flooded cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from geohour.operators.asof import active_at, asof_join, breakpoints, located_asof
from geohour.operators.idw import idw_over_time
from geohour.operators.intervals import expand_hours
from geohour.operators.nearest import NEIGHBOURS, RADIUS, nearest_over_time, within_radius
from geohour.operators.rolling import RAIN_FEATURES, rain_features
from geohour.operators.tables import cross_skeleton
from geohour.session import materialize

# The season and the years of the study.
MONTHS = (5, 10)
YEARS = (2010, 2024)
# Periods in one slot, the key by which readings meet the stretches of their station.
SLOT_STEPS = 64


def season(df: DataFrame, time: str = "time", months: tuple[int, int] = MONTHS,
           years: tuple[int, int] = YEARS) -> DataFrame:
    return df.where(F.month(time).between(*months) & F.year(time).between(*years))


def rain_located(
    obs: DataFrame, stations: DataFrame, months: tuple[int, int] = MONTHS,
    years: tuple[int, int] = YEARS,
) -> DataFrame:
    """Gauge rows of the season with the place their station had at that time."""
    rows = season(obs, "time", months, years).select("time", "station", "rain_1h")
    hit = located_asof(rows, stations, "station", "time", "start_date", "expired_date",
                       ["lat", "lon"])
    return hit.select("time", "station", "rain_1h", "lat", "lon")


def rain_with_features(located: DataFrame) -> DataFrame:
    return rain_features(located, "station", "time", "rain_1h", unique=True)


def relevant_hours(rain: DataFrame, flood: DataFrame) -> DataFrame:
    """Hours with a flood somewhere or with rain at any station."""
    wet = rain.where(F.col("rain_1h") > 0).select("time").distinct()
    flooded = expand_hours(flood.dropna(subset=["start_ts", "end_ts"]), "start_ts", "end_ts")
    return wet.union(flooded.select("time").distinct()).distinct()


def gridded_rain(
    rain: DataFrame, stations: DataFrame, cells: DataFrame, flood: DataFrame,
    k: int = NEIGHBOURS, radius: float = RADIUS, features: tuple[str, ...] = RAIN_FEATURES,
    bucket_hours: int = 1, bucket_days: int = 1,
) -> DataFrame:
    """Rain features on every cell that was ever flooded, at every relevant hour with readings.

    `rain` holds (station, time, features); `stations` (station, start_date, expired_date, x, y)
    and `cells` (grid_id, x, y) share one metric reference system; `flood` holds (grid_id,
    start_ts, end_ts).
    """
    flood = flood.dropna(subset=["start_ts", "end_ts"])
    cells = materialize(cells.join(flood.select("grid_id"), "grid_id", "left_semi"), "wet-cells")
    meta = stations.join(rain.select("station"), "station", "left_semi")
    rows = rain.join(relevant_hours(rain, flood), "time", "left_semi")

    # Hours before the first period have no row; an hour keeps the latest period with anyone in it.
    hours = materialize(asof_join(
        rows.select("time").distinct(),
        breakpoints(meta, "start_date", "expired_date", bucket_hours),
        [], "time", "period_start", ["n_active"], bucket_hours, "inner",
    ).select("time", "period_start"), "hour-periods")
    # One number per period: as many as hours at most, so the calendar bounds them.
    steps = hours.withColumn("step", F.dense_rank().over(Window.orderBy("period_start")))
    periods = steps.select("period_start", "step").distinct()
    active = active_at(periods, "period_start", meta, "start_date", "expired_date", "station",
                       bucket_days).select("period_start", "station", "x", "y").join(periods, "period_start")
    # Stations stay at a place over many periods: the search is by place, the rest by stretches.
    place = ["station", "x", "y"]
    in_a_row = F.col("step") - F.row_number().over(Window.partitionBy(*place).orderBy("step"))
    stays = active.withColumn("_run", in_a_row).groupBy(*place, "_run").agg(
        F.min("step").alias("first"), F.max("step").alias("last"))
    near = within_radius(cells, "grid_id", stays.select(*place), "station", radius)
    candidates = near.join(stays.withColumnsRenamed({"x": "tx", "y": "ty"}), ["station", "tx", "ty"])
    neighbours = materialize(nearest_over_time(
        candidates.select("grid_id", "station", "distance", "first", "last"), "grid_id", "station", k),
        "neighbours")
    slot = F.floor(F.col("step") / SLOT_STEPS)
    slots = F.explode(F.sequence(F.floor(F.col("first") / SLOT_STEPS), F.floor(F.col("last") / SLOT_STEPS)))
    values = rows.join(steps, "time").select("time", "step", slot.alias("slot"), "station", *features)
    cell_slots = cross_skeleton(steps.select(slot.alias("slot")).distinct(), cells.select("grid_id"))
    return idw_over_time(neighbours.withColumn("slot", slots), values, cell_slots, "grid_id", "station", "time",
                         "slot", features, step="step").select(
        "grid_id", "time", *[F.col(c).cast("float").alias(c) for c in features]
    )

