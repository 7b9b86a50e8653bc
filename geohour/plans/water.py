"""Water-level products: hourly levels from archives, sensor cells, sensor registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from geohour.functions.projection import reproject
from geohour.functions.values import clean_address, normalize_id
from geohour.operators.cells import join_cells, with_cell
from geohour.operators.tables import dedup_first
from geohour.streaming.levels import enrich, to_hourly

ARCHIVE_MIN_LEVEL = 0.0


def water_hourly(records: DataFrame, sensor_map: DataFrame) -> DataFrame:
    """Hourly maximum level per cell from archive records in standard columns."""
    located = enrich(records, sensor_map, "unq_no")
    return to_hourly(located, "msrmt_ymd", "msrmt_watl", "grid_id", ARCHIVE_MIN_LEVEL)


def sensor_cells(
    sensors: DataFrame, grid: DataFrame, x0: float, y0: float, step: float, grid_epsg: int = 5179,
) -> DataFrame:
    """Cell of each sensor from its lon/lat; sensors outside the grid have no cell."""
    placed = reproject(sensors, "lon", "lat", 4326, grid_epsg, ("_x", "_y"))
    placed = with_cell(placed, "_x", "_y", x0, y0, step)
    return join_cells(placed, grid, "left").select("sensor_id", "lat", "lon", "grid_id")


def registry_refresh(
    registry: DataFrame, found: DataFrame,
    geocode: Callable[[str], tuple[float | None, float | None]],
) -> DataFrame:
    """Registry and newly seen sensors; known rows win; only rows without a place are looked up.

    `found` holds (sensor_id, location) with a `seq` that orders its rows.
    """
    rows = registry.select(
        normalize_id("sensor_id").alias("sensor_id"), "location", "lat", "lon",
        F.lit(0).alias("_src"), F.lit(0).cast("long").alias("seq"),
    ).unionByName(found.select(
        normalize_id("sensor_id").alias("sensor_id"), "location",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.lit(1).alias("_src"), F.col("seq").cast("long").alias("seq"),
    ))
    merged = dedup_first(rows, ["sensor_id"], ["_src", "seq", "location"]).drop("_src", "seq")
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = [geocode(a) if a else (None, None) for a in batch["_address"]]
            batch["lat"] = pd.Series([p[0] for p in places], dtype="float64", index=batch.index)
            batch["lon"] = pd.Series([p[1] for p in places], dtype="float64", index=batch.index)
            yield batch.drop(columns="_address")

    missing = merged.where(~placed).withColumn("_address", clean_address("location"))
    looked_up = missing.mapInPandas(look_up, merged.schema)
    return merged.where(placed).unionByName(looked_up)
