"""Inverse-distance weighting over precomputed neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geohour.functions.temporal import day_bucket

# Fixed value: guard against a gauge at the very place of a cell.
WEIGHT_GUARD = 1e-12


def weight(distance: Column | str) -> Column:
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.lit(1.0) / (d * d + F.lit(WEIGHT_GUARD))


def idw_aggregates(features: tuple[str, ...], w: str = "_w") -> list[Column]:
    """One weighted mean per feature; a missing value loses its weight, none left gives NULL."""
    out = []
    for name in features:
        v = F.col(name).cast("double")
        total = F.sum(F.when(v.isNotNull(), F.col(w)))
        out.append((F.sum(v * F.col(w)) / F.nullif(total, F.lit(0.0))).alias(name))
    return out


def idw_interpolate(
    neighbours: DataFrame, values: DataFrame, cell: str, station: str, features: tuple[str, ...],
) -> DataFrame:
    """Weighted means per cell from (cell, station, distance) and one value row per station.

    Neighbours are ranked before values are looked at: a station without a value takes its
    place and is not replaced by the next one.
    """
    weighted = neighbours.withColumn("_w", weight("distance"))
    joined = weighted.join(values.select(station, *features), station, "left")
    return joined.groupBy(cell).agg(*idw_aggregates(features))


def idw_over_time(
    neighbours: DataFrame, values: DataFrame, cell_periods: DataFrame, cell: str, station: str,
    time: str, period: str, features: tuple[str, ...], blocks: int = 16,
    broadcast_rows: int = 2_000_000, group_rows: int = 10_000, slot_days: int = 10,
    step: str | None = None, task_rows: int = 500_000,
) -> DataFrame:
    """Weighted means for every cell at every time of `values`.

    `values` holds (time, period, station, features); `neighbours` holds (period, cell, station,
    distance); `cell_periods` lists every cell of every period. Each (time, cell) gets a row, with
    NULL features for cells without neighbours, and in hours in which none of them reports.

    With `step`, a column of `values`, neighbours hold only for the steps from their column first
    to their column last; `period` then is any coarser key that both tables share.

    Readings are few compared with the (time, cell) rows made of them. While the neighbour table
    is small enough to be broadcast, which is counted first, readings are spread by time and
    block of cells, and all that follows stays in that partitioning without a shuffle; a reading
    without a station meets a neighbour without a weight and keeps each row alive. A larger
    neighbour table meets the readings by (period, slot of days, station, block), with as many
    blocks as keep one such group small. What meets is shuffled to its cell, and only there
    each period of a cell becomes a row per hour. That result lies by cell, with `task_rows` rows
    or fewer in most tasks.
    """
    stretch, steps = (["first", "last"], [step]) if step else ([], [])
    weighted = neighbours.select(period, cell, station, weight("distance").alias("_w"), *stretch)
    listed = cell_periods.select(period, cell)
    n, largest = weighted.groupBy(period, station).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))
    ).first()
    hours = values.select(time, period, *steps).distinct()
    readings = values.select(time, period, *steps, station, *features)
    small = n + listed.count() <= broadcast_rows
    if small:
        weighted = weighted.unionByName(listed, allowMissingColumns=True)
        readings = readings.unionByName(hours, allowMissingColumns=True)
    else:
        blocks = 1 + largest // group_rows
    readings = readings.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    weighted = weighted.select(
        F.col(period).alias("_p"), F.col(station).alias("_st"), cell, "_w",
        F.pmod(F.xxhash64(cell), F.lit(blocks)).cast("int").alias("_b2"), *stretch
    )
    same = (
        (F.col(period) == F.col("_p")) & F.col(station).eqNullSafe(F.col("_st"))
        & (F.col("_block") == F.col("_b2"))
    )
    if step:
        same = same & (F.col("first").isNull() | F.col(step).between(F.col("first"), F.col("last")))
    if small:
        pairs = readings.repartition(time, "_block").join(F.broadcast(weighted), same)
        return pairs.groupBy(time, "_block", cell).agg(*idw_aggregates(features)).select(cell, time, *features)
    slots = hours.select(
        F.col(period).alias("_sp"), day_bucket(time, slot_days).alias("_s2")
    ).distinct()
    weighted = weighted.join(F.broadcast(slots), F.col("_p") == F.col("_sp"))
    readings = readings.withColumn("_slot", day_bucket(time, slot_days))
    pairs = readings.join(weighted, same & (F.col("_slot") == F.col("_s2")))
    # A period of a cell travels as one row without a time.
    of_period = hours.groupBy(F.col(period).alias("_p")).agg(F.collect_set(F.struct(time)).alias("_times"))
    rows = listed.groupBy(F.col(period).alias("_p")).agg(F.count(F.lit(1)).alias("n")).join(of_period, "_p").agg(
        F.coalesce(F.sum(F.col("n") * F.size("_times")), F.lit(0))).first()[0]
    # Spark shuffles a table again before a join if it has fewer partitions than this.
    least = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = listed.join(F.broadcast(of_period.select(F.col("_p").alias(period))), period, "left_semi")
    met = pairs.select(cell, F.struct(time).alias("_at"), "_w", *features)
    dealt = met.unionByName(every, allowMissingColumns=True).repartition(max(least, 1 + rows // task_rows), cell)
    # All hours once, by their periods: as few as the calendar has.
    dealt = dealt.join(F.broadcast(of_period), F.col(period) == F.col("_p"), "left").withColumn(
        "_at", F.explode(F.when(F.col("_at").isNull(), F.col("_times")).otherwise(F.array("_at"))))
    return dealt.select(cell, F.col(f"_at.{time}").alias(time), "_w", *features).groupBy(cell, time).agg(
        *idw_aggregates(features)).select(cell, time, *features)
