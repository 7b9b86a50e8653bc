"""Flood products: cleaned footprints and the flood history of each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geohour.functions.temporal import parse_time, plus_hours
from geohour.functions.values import safe_cast
from geohour.operators.shapes import polygon_cells, ring_segments
from geohour.operators.tables import dedup_first, drop_all_null_columns

# Column names of the footprint files and ours.
FOOTPRINT_RENAMES = {"F_ZONE_NM": "ADDRESS", "F_AREA": "AREA", "F_SHIM": "DEPTH"}
START_DAY, START_HOUR, END_DAY, END_HOUR = "F_SAT_YMD", "F_SAT_TM", "F_END_YMD", "F_END_TM"


def flood_clean(raw: DataFrame) -> DataFrame:
    """Footprints with `start_ts` and `end_ts` made of date text and hour columns.

    Rows without a readable start or end and columns without any value are dropped.
    """
    df = raw.withColumnsRenamed(FOOTPRINT_RENAMES).dropna(subset=[START_DAY, END_DAY])
    df = df.withColumns({
        "start_ts": plus_hours(parse_time(START_DAY), safe_cast(START_HOUR, "int")),
        "end_ts": plus_hours(parse_time(END_DAY), safe_cast(END_HOUR, "int")),
    }).dropna(subset=["start_ts", "end_ts"])
    return drop_all_null_columns(df).drop(START_DAY, START_HOUR, END_DAY, END_HOUR)


def flood_history(
    footprints: DataFrame, grid: DataFrame, x0: float, y0: float, step: float,
    feature: str = "feature_id", parts: str = "parts",
) -> DataFrame:
    """Flood intervals per cell: one row per (cell, start), and one for cells never flooded.

    Of footprints with the same start the first one, by feature id, gives the end.
    """
    segments = ring_segments(footprints, feature, parts)
    hit = polygon_cells(segments, feature, x0, y0, step)
    touched = (
        hit.join(grid.select("ix", "iy", "grid_id"), ["ix", "iy"])
        .join(footprints.select(feature, "start_ts", "end_ts"), feature)
        .select("grid_id", "start_ts", "end_ts", feature)
    )
    once = dedup_first(touched, ["grid_id", "start_ts"], [feature]).drop(feature)
    once = once.withColumn("is_flooded", F.lit(1))
    return grid.select("grid_id").join(once, "grid_id", "left").withColumn(
        "is_flooded", F.coalesce("is_flooded", F.lit(0)).cast("int")
    )
