"""Rolling windows, as-of and period lookups, intervals, date parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from geohour.functions.temporal import LEGACY_LEVEL_FORMAT, parse_time, plus_hours
from geohour.operators.asof import located_asof, period_lookup
from geohour.operators.intervals import expand_hours
from geohour.operators.rolling import RAIN_MAXES, RAIN_MEANS, RAIN_SUMS, rolling_features
from workload.registry import query, table


def _range(hours: int) -> str:
    return (f"(PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '{hours - 1} hours 59 "
            "minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)")


def observations(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value")


@query("rolling_sums", f"""
    SELECT event_id, user_id, ts,
           {", ".join(f"round(sum(value) OVER {_range(h)}, 4) AS {n}" for n, h in RAIN_SUMS.items())}
    FROM events""")
def rolling_sums(spark, d):
    out = rolling_features(observations(spark, d), "user_id", "ts", "value", sums=RAIN_SUMS)
    return out.select("event_id", "user_id", "ts", *[F.round(c, 4).alias(c) for c in RAIN_SUMS])


@query("rolling_intensity", f"""
    SELECT event_id, user_id, ts, round(avg(value) OVER {_range(3)}, 8) AS rain_intensity
    FROM events""")
def rolling_intensity(spark, d):
    out = rolling_features(observations(spark, d), "user_id", "ts", "value", means=RAIN_MEANS)
    return out.select("event_id", "user_id", "ts", F.round("rain_intensity", 8).alias("rain_intensity"))


@query("rolling_max", f"""
    SELECT event_id, user_id, ts, max(value) OVER {_range(3)} AS rain_max_3h FROM events""")
def rolling_max(spark, d):
    out = rolling_features(observations(spark, d), "user_id", "ts", "value", maxes=RAIN_MAXES)
    return out.select("event_id", "user_id", "ts", "rain_max_3h")


def view_periods(spark, d, hours: int):
    views = table(spark, d, "events").where(F.col("event_type") == "view")
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return views.select("user_id", F.col("ts").alias("start_date"), end.alias("expired_date"),
                        F.col("event_id").alias("view_id"))


@query("asof_join", """
    WITH v AS (SELECT user_id, ts AS start_date, ts + INTERVAL 6 HOUR AS expired_date,
                      event_id AS view_id FROM events WHERE event_type = 'view'),
         p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, p.user_id, p.ts, v.start_date, v.expired_date, v.view_id
    FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.ts >= v.start_date
    WHERE p.ts < v.expired_date""")
def asof_join(spark, d):
    events = table(spark, d, "events").where(F.col("event_type") == "purchase")
    purchases = events.select("event_id", "user_id", "ts")
    return located_asof(purchases, view_periods(spark, d, 6), "user_id", "ts", "start_date",
                        "expired_date", ["view_id"])


@query("period_lookup", """
    WITH v AS (SELECT ts AS s, ts + INTERVAL 20 MINUTE AS e FROM events WHERE event_type = 'view'),
         bp AS (SELECT s AS t FROM v UNION SELECT e FROM v),
         n AS (SELECT t AS period_start, count(*) AS n_active FROM bp JOIN v ON v.s <= t AND v.e > t
               GROUP BY t)
    SELECT event_id, ts, period_start, n_active
    FROM events ASOF JOIN n ON ts >= period_start""")
def periods(spark, d):
    views = view_periods(spark, d, 0).withColumn(
        "expired_date", F.col("start_date") + F.expr("INTERVAL 20 MINUTE")
    )
    times = table(spark, d, "events").select("event_id", "ts")
    return period_lookup(times, "ts", views, "start_date", "expired_date")


@query("expand_hours", """
    WITH f AS (SELECT user_id, date_trunc('hour', ts) AS s,
                      date_trunc('hour', ts + (CAST(json_extract(props, '$.k') AS INTEGER) - 10)
                                 * INTERVAL 1 HOUR) AS e
               FROM events WHERE event_type = 'error')
    SELECT DISTINCT user_id, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS time
    FROM f WHERE s <= e""")
def hours(spark, d):
    errors = table(spark, d, "events").where(F.col("event_type") == "error")
    k = F.from_json("props", "k int")["k"]
    rows = errors.select(
        "user_id", F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), k - 10)).alias("end_ts"),
    )
    return expand_hours(rows, "start_ts", "end_ts").select("user_id", "time").distinct()


TEXT_TIMES = """
    SELECT event_id, CASE event_type
        WHEN 'view' THEN strftime(ts, '%d-%b-%y %H:%M:%S')
        WHEN 'click' THEN strftime(ts, '%Y%m%d')
        WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d')
        WHEN 'signup' THEN strftime(ts, '%Y/%m/%d %H:%M')
        ELSE 'bad' || strftime(ts, '%Y') END AS t FROM events"""


@query("parse_dates", f"""
    SELECT event_id, try_strptime(t, '%d-%b-%y %H:%M:%S') AS legacy_time,
           coalesce(try_strptime(t, '%Y%m%d'), try_strptime(t, '%Y-%m-%d'),
                    try_strptime(t, '%Y/%m/%d %H:%M')) AS mixed_time
    FROM ({TEXT_TIMES})""")
def parse_dates(spark, d):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.upper(F.date_format("ts", "dd-MMM-yy HH:mm:ss")))
        .when(kind == "click", F.date_format("ts", "yyyyMMdd"))
        .when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "signup", F.date_format("ts", "yyyy/MM/dd HH:mm"))
        .otherwise(F.concat(F.lit("bad"), F.date_format("ts", "yyyy")))
    )
    rows = table(spark, d, "events").select("event_id", text.alias("t"))
    return rows.select(
        "event_id", parse_time("t", (LEGACY_LEVEL_FORMAT,)).alias("legacy_time"),
        parse_time("t").alias("mixed_time"),
    )


@query("date_plus_hours", """
    SELECT event_id, date_trunc('day', ts) + user_id * INTERVAL 1 HOUR AS shifted FROM events""")
def date_plus_hours(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        plus_hours(F.col("ts").cast("date"), F.col("user_id").cast("int")).alias("shifted"),
    )
