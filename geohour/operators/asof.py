"""As-of and validity-period lookups.

Rows meet per (key, bucket of clock hours), not per key or day. What was in force when a bucket
began is carried into it, so that no task holds more than one bucket of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geohour.functions.temporal import day_bucket, hour_bucket


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    payload: list[str],
    bucket_hours: int = 1,
    how: str = "left",
) -> DataFrame:
    """Backward as-of join: the last right row at or before the left time, exact match allowed.

    Adds `right_time` and `payload` to the left columns. Right rows with equal key and time
    are resolved to the one with the largest payload. With an empty `on` the whole right table
    is one timeline. `how` is "left" or "inner".
    """
    keys = list(on)
    starts = (
        right.where(F.col(right_time).isNotNull())
        .dropna(subset=keys)
        .groupBy(*keys, F.col(right_time).alias("_t"))
        .agg(F.max(F.struct(*payload)).alias("_p"))
        .withColumn("_b", hour_bucket("_t", bucket_hours))
    )
    # Copies of one (key, time) ask the same question: it is answered once.
    asked = (
        left.dropna(subset=[*keys, left_time])
        .select(*keys, F.col(left_time).alias("_t"))
        .distinct()
        .withColumn("_b", hour_bucket("_t", bucket_hours))
    )
    last = starts.groupBy(*keys, "_b").agg(F.max(F.struct("_t", "_p")).alias("_last"))
    no_last = F.lit(None).cast(last.schema["_last"].dataType)
    buckets = (
        last.unionByName(asked.select(*keys, "_b").distinct().withColumn("_last", no_last))
        .groupBy(*keys, "_b")
        .agg(F.max("_last").alias("_last"))
    )
    # One row per non-empty bucket: its number is bounded by the calendar.
    earlier = (
        Window.partitionBy(*keys).orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        buckets.withColumn("_c", F.last("_last", ignorenulls=True).over(earlier))
        .where(F.col("_c").isNotNull())
        .select(*keys, "_b", F.col("_c._t").alias("_t"), F.col("_c").alias("_r"))
    )
    in_force = starts.select(*keys, "_b", "_t", F.struct("_t", "_p").alias("_r"))
    timeline = (
        in_force.unionByName(carried).withColumn("_ask", F.lit(0))
        .unionByName(asked.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    )
    upto = (
        Window.partitionBy(*keys, "_b").orderBy("_t", "_ask")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        timeline.withColumn("_r", F.last("_r", ignorenulls=True).over(upto))
        .where((F.col("_ask") == 1) & F.col("_r").isNotNull())
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_t").alias("_asked"),
            F.col("_r._t").alias(right_time),
            *[F.col(f"_r._p.{c}").alias(c) for c in payload],
        )
    )
    cond = F.col(left_time) == F.col("_asked")
    for i, k in enumerate(keys):
        cond = cond & (F.col(k) == F.col(f"_k{i}"))
    return left.join(answers, cond, how).select(*left.columns, right_time, *payload)


def located_asof(
    obs: DataFrame, meta: DataFrame, key: str, time: str, start: str, expired: str,
    payload: list[str], far_future: str = "2100-01-01 00:00:00",
) -> DataFrame:
    """As-of on the latest start, then the expiry test on that one period.

    A row is dropped when its latest period has expired, also where an older one still covers it.
    """
    end = F.coalesce(F.col(expired), F.lit(far_future).cast("timestamp_ntz"))
    meta = meta.withColumn(expired, end)
    hit = asof_join(obs, meta, [key], time, start, [expired, *payload], how="inner")
    return hit.where(F.col(time) < F.col(expired))


def running_total(df: DataFrame, order: str, value: str, bucket_hours: int, out: str) -> DataFrame:
    """Running sum over one global timeline in two levels: buckets first, then inside each."""
    df = df.withColumn("_b", hour_bucket(order, bucket_hours))
    per_bucket = df.groupBy("_b").agg(F.sum(value).alias("_v"))
    # One row per bucket: bounded by the calendar, so one task may hold them all.
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(
        F.col("_b").alias("_pb"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_b").orderBy(order)
    return (
        df.join(per_bucket, F.col("_b") == F.col("_pb"))
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_b", "_pb", "_before")
    )


def valid_periods(meta: DataFrame, start: str, expired: str) -> DataFrame:
    """Rows that are ever active: an end at or before its start never is."""
    return meta.where(
        F.col(start).isNotNull() & (F.col(expired).isNull() | (F.col(expired) > F.col(start)))
    )


def breakpoints(meta: DataFrame, start: str, expired: str, bucket_hours: int = 1) -> DataFrame:
    """Every start or expiry at which at least one row is active, with the number active.

    A breakpoint with nobody active is left out: the period before it stays in force.
    """
    active = valid_periods(meta, start, expired)
    opens = active.select(F.col(start).alias("period_start"), F.lit(1).alias("_d"))
    closes = active.where(F.col(expired).isNotNull()).select(
        F.col(expired).alias("period_start"), F.lit(-1).alias("_d")
    )
    steps = opens.unionByName(closes).groupBy("period_start").agg(F.sum("_d").alias("_d"))
    total = running_total(steps, "period_start", "_d", bucket_hours, "n_active")
    return total.where(F.col("n_active") > 0).select("period_start", "n_active")


def period_lookup(
    times: DataFrame, time: str, meta: DataFrame, start: str, expired: str,
    bucket_hours: int = 1,
) -> DataFrame:
    """Add the period in force (its start and number of active rows) to each row of `times`.

    Rows before the first period are dropped.
    """
    points = breakpoints(meta, start, expired, bucket_hours)
    return asof_join(times, points, [], time, "period_start", ["n_active"], bucket_hours, "inner")


def active_at(
    points: DataFrame, point: str, meta: DataFrame, start: str, expired: str,
    key: str, bucket_days: int = 30,
) -> DataFrame:
    """Rows of `meta` active at each point in time, one per key (the earliest start wins).

    Intervals are laid over calendar buckets and meet the points by equality of the bucket.
    """
    # Two values: the covered span, to which open intervals are clipped.
    span = points.agg(F.min(point).alias("lo"), F.max(point).alias("hi"))
    lo = span.select(day_bucket("lo", bucket_days)).scalar()
    hi = span.select(day_bucket("hi", bucket_days)).scalar()
    first = F.greatest(day_bucket(start, bucket_days), lo)
    last = F.least(F.coalesce(day_bucket(expired, bucket_days), hi), hi)
    intervals = (
        valid_periods(meta, start, expired)
        .withColumns({"_first": first, "_last": last})
        .where(F.col("_first") <= F.col("_last"))
        .withColumn("_b", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )
    asked = points.select(F.col(point).alias("_at")).distinct()
    asked = asked.withColumn("_pb", day_bucket("_at", bucket_days))
    inside: Column = (F.col(start) <= F.col("_at")) & (
        F.col(expired).isNull() | (F.col(expired) > F.col("_at"))
    )
    order = Window.partitionBy("_at", key).orderBy(start, *[
        c for c in meta.columns if c not in (key, start)
    ])
    return (
        intervals.join(asked, (F.col("_b") == F.col("_pb")) & inside)
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") == 1)
        .withColumnRenamed("_at", point)
        .drop("_b", "_pb", "_rn")
    )
