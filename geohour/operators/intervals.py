"""Intervals to hourly rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geohour.functions.temporal import floor_hour, next_midnight


def fill_interval_end(df: DataFrame, start: str, end: str) -> DataFrame:
    """An open end becomes the midnight after the start."""
    return df.withColumn(end, F.coalesce(F.col(end), next_midnight(start)))


def expand_hours(df: DataFrame, start: str, end: str, out: str = "time") -> DataFrame:
    """One row per hour from the start's hour to the end's hour, both included.

    Open intervals and those that end before they start give no rows.
    """
    return (
        df.withColumns({"_from": floor_hour(start), "_to": floor_hour(end)})
        .where(F.col("_from") <= F.col("_to"))
        .withColumn(out, F.explode(F.sequence("_from", "_to", F.expr("INTERVAL 1 HOUR"))))
        .drop("_from", "_to")
    )
