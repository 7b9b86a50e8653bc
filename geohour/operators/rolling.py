"""Time-range rolling features per key.

A window over one key puts that key's whole history into one task, and Spark adds up a sliding
frame anew for each of its rows. Here a frame is put together from whole minutes and running totals
inside its first and last minute. Minutes are cut into calendar chunks, each with the longest
window before it, and the rows of a minute stand for themselves. So a hot key, day or hour is spread
over many tasks, the work of a row does not grow with the rows around it, and every frame is
complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geohour.functions.temporal import day_bucket, floor_hour

# The rain features and their window lengths in hours.
RAIN_SUMS = {"rain_3h": 3, "rain_6h": 6, "rain_12h": 12, "rain_24h": 24}
RAIN_MEANS = {"rain_intensity": 3}
RAIN_MAXES = {"rain_max_3h": 3}
RAIN_FEATURES = ("rain_1h", *RAIN_SUMS, *RAIN_MEANS, *RAIN_MAXES)


def _frame(hours: int) -> str:
    """(t - hours, t], written as a closed frame at microsecond grain."""
    return (
        f"RANGE BETWEEN INTERVAL '{hours - 1}:59:59.999999' HOUR TO SECOND PRECEDING "
        "AND CURRENT ROW"
    )


def rolling_features(
    df: DataFrame,
    key: str,
    time: str,
    value: str,
    sums: dict[str, int] | None = None,
    means: dict[str, int] | None = None,
    maxes: dict[str, int] | None = None,
    chunk_days: int = 16,
    unique: bool = False,
) -> DataFrame:
    """Add rolling sums, means and maxima over (t - hours, t] to every row.

    Nulls are skipped; a frame without any value gives NULL, as does a row without a time; rows
    without a key are a key of their own. Copies of one (key, time) are first reduced to one
    row, and the features are joined back. `unique=True` states that the rows are hourly and
    (key, time) is unique, as in a gauge table: then a frame has a row an hour and is summed directly.
    """
    sums, means, maxes = sums or {}, means or {}, maxes or {}
    longest = max([*sums.values(), *means.values(), *maxes.values()])
    if longest > 24 * chunk_days:
        raise ValueError("chunk_days must cover the longest window")
    if unique:
        rows = df.withColumns({
            "_s": F.col(value).cast("double"),
            "_n": F.col(value).isNotNull().cast("long"),
            "_m": F.col(value),
        })
        return _sliding(rows, key, time, sums, means, maxes, chunk_days)

    rows = df.where(F.col(time).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(time).alias("_t")).agg(
        F.sum(F.col(value).cast("double")).alias("_s"),
        F.count(value).alias("_n"),
        F.max(value).alias("_m"),
    )
    names = [*sums, *means, *maxes]
    out = _by_minutes(rows, sums, means, maxes, chunk_days)
    joined = df.join(out, F.col(key).eqNullSafe(F.col("_k")) & (F.col(time) == F.col("_t")), "left")
    return joined.select(*df.columns, *names)


def _sliding(rows: DataFrame, key: str, time: str, sums: dict[str, int], means: dict[str, int],
             maxes: dict[str, int], chunk_days: int) -> DataFrame:
    longest = max([*sums.values(), *means.values(), *maxes.values()])
    own = day_bucket(time, chunk_days)
    later = day_bucket(F.col(time) + F.make_dt_interval(F.lit(0), F.lit(longest)), chunk_days)
    # A row goes to its own chunk and, when near its end, also to the next one.
    rows = rows.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, later)))

    over = f"OVER (PARTITION BY `{key}`, _chunk ORDER BY `{time}` %s)"
    features: dict[str, Column] = {}
    for name, hours in sums.items():
        features[name] = F.expr(f"sum(_s) {over % _frame(hours)}")
    for name, hours in means.items():
        frame = over % _frame(hours)
        features[name] = F.expr(f"sum(_s) {frame} / nullif(sum(_n) {frame}, 0)")
    for name, hours in maxes.items():
        features[name] = F.expr(f"max(_m) {over % _frame(hours)}")
    return (
        rows.withColumns(features)
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_s", "_n", "_m", "_own", "_chunk")
    )


_TOTALS = {"s": "sum(_s)", "n": "sum(_n)", "m": "max(_m)"}


def _by_minutes(rows: DataFrame, sums: dict[str, int], means: dict[str, int], maxes: dict[str, int],
                chunk_days: int) -> DataFrame:
    """(_k, _t, features): frames as (rest of the first minute) + (minutes between) + (own minute up to t).

    A window is whole hours, so the first minute of a row's frame is its own minute, so many hours
    ago. Rows are sent to their own minute and, with their time moved on, to those that their
    minute begins a frame of; there one running total backwards serves all rows. Nothing is
    subtracted: a dry frame stays 0.
    """
    wanted = {w: {*("s" for x in (*sums.values(), *means.values()) if x == w), *("n" for x in means.values() if x == w),
                  *("m" for x in maxes.values() if x == w)} for w in {*sums.values(), *means.values(), *maxes.values()}}
    rows = rows.withColumn("_minute", floor_hour("_t") + F.make_dt_interval(F.lit(0), F.lit(0), F.minute("_t")))

    # The minutes between: at most so many as the window has, however many rows they hold.
    minutes = rows.groupBy("_k", "_minute").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.max("_m").alias("_m"))
    own = day_bucket("_minute", chunk_days)
    later = day_bucket(F.col("_minute") + F.make_dt_interval(F.lit(0), F.lit(max(wanted))), chunk_days)
    chunked = minutes.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, later)))
    between = chunked.select("_k", "_minute", "_own", "_chunk", *[
        F.expr(f"{_TOTALS[o]} OVER (PARTITION BY _k, _chunk ORDER BY _minute RANGE BETWEEN INTERVAL '{60 * w - 1}' MINUTE "
               "PRECEDING AND INTERVAL '1' MINUTE PRECEDING)").alias(f"_mid_{o}{w}")
        for w, of in wanted.items() for o in of
    ]).where("_chunk = _own").drop("_chunk", "_own")

    moved = rows.select("_k", "_s", "_n", "_m", "_t", "_minute", F.explode(F.array(*[F.lit(w) for w in (0, *wanted)])).alias("_w"))
    moved = moved.withColumns({c: F.col(c) + F.make_dt_interval(F.lit(0), F.col("_w")) for c in ("_t", "_minute")})
    # At one time a row comes before those moved there, which are outside its frame.
    back = "OVER (PARTITION BY _k, _minute ORDER BY _t DESC, _w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    on = "OVER (PARTITION BY _k, _minute ORDER BY _t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    first = moved.select("*", *[
        F.expr(f"{_TOTALS[o].replace('(_', f'(CASE WHEN _w = {w} THEN _').replace(')', ' END)')} {back}").alias(f"_first_{o}{w}")
        for w, of in wanted.items() for o in of
    ]).where("_w = 0")
    ends = first.select("*", *[F.expr(f"{_TOTALS[o]} {on}").alias(f"_own_{o}") for o in sorted(set().union(*wanted.values()))])
    parts = ends.withColumnsRenamed({"_k": "_key", "_minute": "_at"}).join(
        between, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_minute")))

    def terms(w: int, o: str) -> list[Column]:
        return [F.col(f"_first_{o}{w}"), F.col(f"_mid_{o}{w}"), F.col(f"_own_{o}")]

    def total(w: int, o: str) -> Column:
        a, b, c = (F.coalesce(t, F.lit(0)) for t in terms(w, o))
        return F.when(F.coalesce(*terms(w, o)).isNotNull(), a + b + c)

    features = {name: total(w, "s") for name, w in sums.items()}
    features |= {name: total(w, "s") / F.nullif(total(w, "n"), F.lit(0)) for name, w in means.items()}
    features |= {name: F.greatest(*terms(w, "m")) for name, w in maxes.items()}
    return parts.select("_k", "_t", *[c.alias(n) for n, c in features.items()])


def rain_features(df: DataFrame, key: str = "station", time: str = "time",
                  value: str = "rain_1h", unique: bool = True) -> DataFrame:
    """The six derived rain columns as FLOAT."""
    out = rolling_features(df, key, time, value, RAIN_SUMS, RAIN_MEANS, RAIN_MAXES, unique=unique)
    return out.withColumns({c: F.col(c).cast("float") for c in RAIN_FEATURES if c != "rain_1h"})
