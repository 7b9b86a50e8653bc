from datetime import datetime as dt, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from geohour.functions.temporal import (
    hour_bucket,
    LEGACY_LEVEL_FORMAT, floor_hour, next_midnight, parse_time, plus_hours,
)
from geohour.operators.asof import asof_join, breakpoints, located_asof, period_lookup
from geohour.operators.intervals import expand_hours, fill_interval_end
from geohour.operators.rolling import rolling_features

H = [dt(2020, 7, 1, h) for h in range(24)]


def series(spark, values, key=1):
    return spark.createDataFrame(
        [(key, t, v) for t, v in zip(H, values)], "station int, time timestamp_ntz, rain_1h float"
    )


WAYS = [dict(unique=True), dict()]


@pytest.mark.parametrize("way", WAYS)
def test_rolling_frame_is_open_on_the_left(spark, way):
    out = rolling_features(series(spark, [1.0, None, 4.0, 8.0, 16.0]), "station", "time", "rain_1h",
                           {"s": 3}, {"m": 3}, {"x": 3}, **way)
    got = {r.time.hour: (r.s, r.m, r.x) for r in out.collect()}
    assert [got[h][0] for h in range(5)] == [1, 1, 5, 12, 28]
    assert [got[h][1] for h in range(5)] == [1, 1, 2.5, 6, pytest.approx(28 / 3)]
    assert [got[h][2] for h in range(5)] == [1, 1, 4, 8, 16]


@pytest.mark.parametrize("way", WAYS)
def test_rolling_without_values_is_null(spark, way):
    out = rolling_features(series(spark, [None, None]), "station", "time", "rain_1h",
                           {"s": 3}, {"m": 3}, {"x": 3}, **way)
    assert {(r.s, r.m, r.x) for r in out.collect()} == {(None, None, None)}


def test_rolling_crosses_chunk_borders(spark):
    hours = spark.range(0, 24 * 90).select(
        F.lit(7).alias("k"), F.col("id").cast("double").alias("v"),
        (F.lit(dt(2019, 12, 1)).cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("t"),
    )
    out = rolling_features(hours, "k", "t", "v", {"s": 24}, chunk_days=2, unique=True)
    for r in out.collect():
        n = min(int(r.v) + 1, 24)
        assert r.s == sum(int(r.v) - i for i in range(n))


@pytest.mark.parametrize("n, span", [(3000, 400_000), (1500, 3 * 3600), (1500, 90)])
def test_rolling_equals_brute_force_at_every_density(spark, n, span):
    df = spark.range(0, n).select(
        F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 13 > 0, (F.col("id") % 7).cast("double")).alias("v"),
        (F.lit(dt(2020, 1, 1)).cast("timestamp_ntz") + F.expr(
            f"make_dt_interval(0, 0, 0, pmod(xxhash64(id), {span}) + if(id % 2 = 0, 0, 0.000001 * pmod(id, 1000000)))")).alias("t"))
    # on the hour before another row, an exact hour after it, and without a time
    df = df.unionByName(df.where("k = 1").limit(40).select("k", "v", (F.col("t") + F.expr("INTERVAL 3 HOUR")).alias("t"))).unionByName(
        df.limit(1).select("k", "v", F.lit(None).cast("timestamp_ntz").alias("t"))).cache()
    out = rolling_features(df, "k", "t", "v", {"a": 1, "b": 3, "c": 24}, {"d": 3}, {"e": 1, "f": 6}, chunk_days=2).collect()
    data = df.collect()
    assert len(out) == len(data)
    by_key = {}
    for r in data:
        by_key.setdefault(r.k, []).append(r)

    def frame(r, hours):
        return [x.v for x in by_key[r.k] if x.t and x.v is not None and r.t - timedelta(hours=hours) < x.t <= r.t]

    for r in out[::7]:
        if r.t is None:
            assert (r.a, r.d, r.e) == (None, None, None)
            continue
        for name, hours in (("a", 1), ("b", 3), ("c", 24)):
            assert r[name] == (sum(frame(r, hours)) if frame(r, hours) else None)
        got = frame(r, 3)
        assert r.d == (pytest.approx(sum(got) / len(got)) if got else None)
        assert r.e == max(frame(r, 1), default=None) and r.f == max(frame(r, 6), default=None)


def test_rolling_spreads_a_hot_hour(spark):
    df = spark.range(0, 20_000).select(F.lit(1).alias("k"), F.lit(1.0).alias("v"), (
        F.lit(dt(2020, 1, 1)).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id * 0.18)")).alias("t"))
    out = rolling_features(df, "k", "t", "v", {"s": 1})
    assert out.agg(F.max("s"), F.count("s")).first()[:] == (20_000.0, 20_000)
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if " Window [" in x]
    # Frames that slide go over minutes of a key, and rows are ordered within one minute only.
    assert windows and all("_minute" in x or "RangeFrame" in x for x in windows)
    assert all("RowFrame" in x for x in windows if "_minute" in x.rsplit("], [", 2)[1])


def test_rolling_keeps_copies(spark):
    df = spark.createDataFrame([(1, H[0], 2.0), (1, H[0], 2.0), (1, H[1], 5.0)],
                               "k int, t timestamp_ntz, v double")
    out = rolling_features(df, "k", "t", "v", {"s": 3})
    assert rows(out.select("t", "s")) == [(H[0], 4.0), (H[0], 4.0), (H[1], 9.0)]


def test_asof_takes_latest_start_then_expiry(spark):
    meta = spark.createDataFrame(
        [(1, dt(2010, 1, 1), dt(2020, 1, 1), "A"), (1, dt(2012, 1, 1), dt(2013, 1, 1), "B"),
         (2, dt(2012, 1, 1), None, "C")],
        "station int, start timestamp_ntz, expired timestamp_ntz, name string")
    obs = spark.createDataFrame(
        [(1, dt(2011, 1, 1)), (1, dt(2012, 1, 1)), (1, dt(2015, 1, 1)), (1, dt(2009, 1, 1)),
         (2, dt(2050, 1, 1)), (3, dt(2015, 1, 1)), (1, dt(2011, 1, 1))],
        "station int, time timestamp_ntz")
    out = located_asof(obs, meta, "station", "time", "start", "expired", ["name"])
    assert rows(out.select("station", "time", "name")) == [
        (1, dt(2011, 1, 1), "A"), (1, dt(2011, 1, 1), "A"), (1, dt(2012, 1, 1), "B"),
        (2, dt(2050, 1, 1), "C"),
    ]


def test_asof_left_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, H[3]), (1, None), (None, H[3]), (2, H[0])],
                                 "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, H[3], 5), (1, H[3], 6), (1, H[9], 7)],
                                  "k int, s timestamp_ntz, v int")
    out = asof_join(left, right, ["k"], "t", "s", ["v"])
    assert rows(out.select("k", "v")) == [(1, 6), (1, None), (2, None), (None, None)]


def test_periods(spark):
    meta = spark.createDataFrame(
        [(1, dt(2010, 1, 1), dt(2011, 1, 1)), (2, dt(2010, 6, 1), dt(2011, 1, 1)),
         (3, dt(2012, 1, 1), None), (4, dt(2013, 1, 1), dt(2012, 1, 1))],
        "station int, s timestamp_ntz, e timestamp_ntz")
    assert rows(breakpoints(meta, "s", "e")) == [
        (dt(2010, 1, 1), 1), (dt(2010, 6, 1), 2), (dt(2012, 1, 1), 1)]
    times = spark.createDataFrame([(dt(2009, 1, 1),), (dt(2010, 7, 1),), (dt(2011, 6, 1),),
                                   (dt(2030, 1, 1),)], "t timestamp_ntz")
    # Nobody is active in mid-2011: the period before stays in force.
    assert rows(period_lookup(times, "t", meta, "s", "e").select("t", "period_start")) == [
        (dt(2010, 7, 1), dt(2010, 6, 1)), (dt(2011, 6, 1), dt(2010, 6, 1)),
        (dt(2030, 1, 1), dt(2012, 1, 1))]


def test_expand_hours(spark):
    df = spark.createDataFrame(
        [(1, dt(2020, 7, 1, 10, 50), dt(2020, 7, 1, 12, 5)),
         (2, dt(2020, 7, 1, 10), dt(2020, 7, 1, 8)), (3, dt(2020, 7, 1, 22), None)],
        "id int, s timestamp_ntz, e timestamp_ntz")
    out = expand_hours(df, "s", "e").select("id", "time")
    assert rows(out) == [(1, dt(2020, 7, 1, h)) for h in (10, 11, 12)]
    filled = expand_hours(fill_interval_end(df, "s", "e"), "s", "e").where("id = 3")
    assert [r.time for r in filled.orderBy("time").collect()] == [
        dt(2020, 7, 1, 22), dt(2020, 7, 1, 23), dt(2020, 7, 2, 0)]


def test_times(spark):
    df = spark.createDataFrame([(dt(2020, 2, 29, 13, 59, 59, 999999),)], "t timestamp_ntz")
    r = df.select(floor_hour("t").alias("h"), next_midnight("t").alias("m"),
                  plus_hours(F.to_date("t"), F.lit(30)).alias("p")).first()
    assert (r.h, r.m, r.p) == (dt(2020, 2, 29, 13), dt(2020, 3, 1), dt(2020, 3, 1, 6))


def test_floor_hour_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(dt(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(floor_hour("t")).first()[0] == dt(2024, 3, 10, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_parse(spark):
    texts = ["01-MAY-12 00:00:00", "20200801", "2020-08-01", "2020/08/01 05:06", "2020-08-01 05:06",
             "2020-08-01 05:06:07.25", "2020080105", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(parse_time("t", (LEGACY_LEVEL_FORMAT,)), parse_time("t")).collect()]
    assert got == [
        (dt(2012, 5, 1), None), (None, dt(2020, 8, 1)), (None, dt(2020, 8, 1)),
        (None, dt(2020, 8, 1, 5, 6)), (None, dt(2020, 8, 1, 5, 6)),
        (None, dt(2020, 8, 1, 5, 6, 7, 250000)), (None, dt(2020, 8, 1, 5)), (None, None), (None, None)]


def test_asof_on_one_day_and_key_uses_many_tasks(spark):
    """A million times of one key on one day: no task of the windows holds a third of them."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.08)")
    left = spark.range(1_000_000).select(F.lit(1).alias("k"), at.alias("t"))
    right = spark.range(0, 1_000_000, 100).select(F.lit(1).alias("k"), at.alias("s"), F.col("id").alias("v"))
    out = asof_join(left, right, ["k"], "t", "s", ["v"])
    assert out.agg(F.count("v"), F.countDistinct("v")).first()[:] == (1_000_000, 10_000)
    sizes = [r["count"] for r in left.groupBy(hour_bucket("t", 1).alias("b")).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 0.06 * 1_000_000
