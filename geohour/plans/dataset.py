"""The hourly table per cell that all layers meet in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geohour.operators.intervals import expand_hours, fill_interval_end

KEYS = ["grid_id", "time"]


def flood_hours(history: DataFrame, open_end_to_midnight: bool) -> DataFrame:
    """Flooded (cell, hour) pairs, each once: overlapping intervals must not multiply rain rows."""
    rows = history.where(F.col("start_ts").isNotNull())
    if open_end_to_midnight:
        rows = fill_interval_end(rows.where(F.col("is_flooded") == 1), "start_ts", "end_ts")
    return expand_hours(rows.select("grid_id", "start_ts", "end_ts"), "start_ts", "end_ts").select(
        *KEYS
    ).distinct()


def _assemble(rain: DataFrame, history: DataFrame, water: DataFrame, static: list[DataFrame],
              flag: str, open_end_to_midnight: bool) -> DataFrame:
    wet = flood_hours(history, open_end_to_midnight).withColumn(flag, F.lit(1).cast("tinyint"))
    # The rain table is by far the largest and may lie by grid_id. It stays where it is: the hours
    # come to it by grid_id, and are hashed, so that it needs no sort; the static layers are joined
    # by AQE's measure of their size. Planned later, so the setting stays until the next `configure`.
    rain.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    kind = rain.schema["grid_id"].dataType  # another one would have the rain's own ids cast, and shuffled
    wet, water, *static = [
        t.withColumn("grid_id", F.col("grid_id").try_cast(kind)) if t.schema["grid_id"].dataType != kind else t
        for t in (wet, water.select(*KEYS, "water_level"), *static)]
    out = rain.join(wet.hint("shuffle_hash"), KEYS, "left").join(water.hint("shuffle_hash"), KEYS, "left")
    for layer in static:
        out = out.join(layer, "grid_id", "left")
    return out.withColumn(flag, F.coalesce(flag, F.lit(0).cast("tinyint")))


def assemble_dataset(rain: DataFrame, history: DataFrame, water: DataFrame,
                     elevation: DataFrame, river: DataFrame) -> DataFrame:
    """City layout: flood flag, level, elevation, river flag. Open intervals give no hours."""
    return _assemble(rain, history, water, [elevation, river], "flood", False)


def assemble_dataset_district(rain: DataFrame, history: DataFrame, water: DataFrame,
                              elevation: DataFrame, distance: DataFrame) -> DataFrame:
    """District layout: distance class; open intervals last until the midnight after."""
    return _assemble(rain, history, water, [elevation, distance], "is_flooded", True)


def write_dataset(df: DataFrame, path: str) -> None:
    """Store the dataset sorted by cell and hour, in folders by month."""
    month = F.date_format("time", "yyyy-MM")
    (
        df.withColumn("month", month)
        .repartitionByRange("month", *KEYS).sortWithinPartitions("month", *KEYS)
        .write.option("compression", "snappy").partitionBy("month").parquet(path)
    )
