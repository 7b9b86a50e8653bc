import json
from datetime import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from geohour.sources import storage
from geohour.streaming import levels

SCHEMA = "sensor_id string, water_level string, time string, location string"


def feed(spark, root, name, *readings):
    spark.createDataFrame([(*r, "x") for r in readings], SCHEMA).coalesce(1).write.json(f"{root}/{name}")


def stream(spark, root):
    return spark.readStream.schema(SCHEMA).json(f"{root}/*")


def run(spark, root, sensors):
    q = levels.start_level_stream(stream(spark, f"{root}/in"), sensors, f"{root}/log",
                                  f"{root}/checkpoint", interval=None)
    q.awaitTermination()
    log = storage.read_log(spark, f"{root}/log")
    return rows(storage.resolve_last(log, ["time", "grid_id"]))


def test_polled_levels(spark, tmp_path):
    root = str(tmp_path)
    sensors = spark.createDataFrame([("1", 7), ("2", 7), ("3", None)], "sensor_id string, grid_id bigint")
    feed(spark, f"{root}/in", "a", (" 1", "5.0", "2024-01-01 10:20"), ("2", "-1", "2024-01-01 10:40"),
         ("3", "9", "2024-01-01 10:40"), ("9", "9", "2024-01-01 10:40"), ("1", "bad", "2024-01-01 11:00"))
    assert run(spark, root, sensors) == [(dt(2024, 1, 1, 10), 7, 5.0)]
    # The repeated reading is known, so the later batch holds only the new, lower one; it wins.
    feed(spark, f"{root}/in", "b", ("1", "5.0", "2024-01-01 10:20"), ("2", "2.0", "2024-01-01 10:50"))
    assert run(spark, root, sensors) == [(dt(2024, 1, 1, 10), 7, 2.0)]
    # Nothing new: nothing changes.
    assert run(spark, root, sensors) == [(dt(2024, 1, 1, 10), 7, 2.0)]


def test_late_rows_reach_the_hourly_maximum(spark, tmp_path):
    root = str(tmp_path)
    parts = [("a", "2024-01-01 10:20", 1.0), ("b", "2024-01-03 10:20", 2.0), ("c", "2024-01-01 10:40", 9.0)]
    for name, at, value in parts:
        spark.createDataFrame([(at, value)], "at string, level double").selectExpr(
            "CAST(at AS timestamp_ntz) AS at", "level", "7 AS cell").write.parquet(f"{root}/in/{name}")
        df = spark.readStream.schema("at timestamp_ntz, level double, cell int").parquet(f"{root}/in/*")
        q = levels.hourly_max_by_event_time(df, "at", "level", "cell").writeStream.outputMode("update").foreachBatch(
            lambda batch, i: storage.append_batch(batch, f"{root}/log", i)
        ).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    out = storage.resolve_last(storage.read_log(spark, f"{root}/log"), ["time", "cell"])
    assert rows(out.select("time", "level")) == [(dt(2024, 1, 1, 10), 9.0), (dt(2024, 1, 3, 10), 2.0)]


def test_level_stream_takes_a_watermark(spark, tmp_path):
    root = str(tmp_path)
    sensors = spark.createDataFrame([("1", 7)], "sensor_id string, grid_id bigint")
    feed(spark, f"{root}/in", "a", ("1", "5.0", "2024-01-01 10:20"), (" 1", "6.0", "2024-01-01 10:20"))
    q = levels.start_level_stream(stream(spark, f"{root}/in"), sensors, f"{root}/log", f"{root}/checkpoint",
                                  interval=None, watermark="2 hours")
    q.awaitTermination()
    log = storage.read_log(spark, f"{root}/log")
    assert storage.resolve_last(log, ["time", "grid_id"]).count() == 1


def test_watermarked_dedup(spark, tmp_path):
    root = str(tmp_path)
    feed(spark, f"{root}/in", "a", ("1", "5", "2024-01-01 10:20"), (" 1", "6", "2024-01-01 10:20"))
    df = stream(spark, f"{root}/in").withColumn("at", F.to_timestamp("time", "yyyy-MM-dd HH:mm"))
    once = levels.dedup_readings(df, event_time="at", watermark="1 hour")
    q = once.writeStream.format("parquet").option("checkpointLocation", f"{root}/c").option(
        "path", f"{root}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 1


def test_archive_drops_negative_levels(spark):
    df = spark.createDataFrame([(dt(2020, 1, 1, 5, 30), "-1", 1), (dt(2020, 1, 1, 5, 10), "2", 1)],
                               "time timestamp_ntz, water_level string, grid_id int")
    assert rows(levels.to_hourly(df.where("water_level < 0"), min_level=0.0)) == []
    assert rows(levels.to_hourly(df.where("water_level < 0"))) == [(dt(2020, 1, 1, 5), 1, -1.0)]
    assert rows(levels.to_hourly(df, min_level=0.0)) == [(dt(2020, 1, 1, 5), 1, 2.0)]


def test_unmatched_sensors(spark):
    readings = spark.createDataFrame([("1 ", "a"), ("2", "b"), ("2", "b")], "sensor_id string, location string")
    sensors = spark.createDataFrame([("1", 5), ("2", None)], "sensor_id string, grid_id int")
    assert rows(levels.unmatched(readings, sensors)) == [("2", "b")]


def test_repeats_of_any_age_are_known_without_state(spark, tmp_path):
    root = str(tmp_path)
    sensors = spark.createDataFrame([("1", 7), ("2", 7)], "sensor_id string, grid_id bigint")
    days = [f"2024-01-{d:02d} 10:20" for d in range(1, 9)]
    for i, at in enumerate(days):
        feed(spark, f"{root}/in", f"d{i}", ("1", "5.0", at), (" 1", "6.0", at), ("2", str(i), at))
        run(spark, root, sensors)
    # The first day again, a week later: a repeat, a late new reading, and a new time text.
    feed(spark, f"{root}/in", "late", ("1 ", "99", days[0]), ("2", "99", days[0]), ("1", "3.0", "2024-01-01 10:50"))
    q = levels.start_level_stream(stream(spark, f"{root}/in"), sensors, f"{root}/log", f"{root}/checkpoint", interval=None)
    q.awaitTermination()
    assert all(not p["stateOperators"] for p in map(json.loads, [x.json for x in q.recentProgress]))  # no state at all
    log = storage.read_log(spark, f"{root}/log")
    last = log.agg(F.max("batch_id")).first()[0]
    assert rows(log.where(F.col("batch_id") == last).select("time", "grid_id", "water_level")) == [(dt(2024, 1, 1, 10), 7, 3.0)]
    seen = storage.read_log(spark, f"{root}/log-seen")
    assert seen.count() == seen.select("sensor", "time").distinct().count() == 2 * len(days) + 1
    # A batch that runs again sees the earlier ones only, and stores the same.
    again = levels.unseen(spark.createDataFrame([("1", "3.0", "2024-01-01 10:50", "x"), (None, "1", None, "x")], SCHEMA), f"{root}/log-seen", last)
    assert again.count() == 2 and storage.read_log(spark, f"{root}/log-seen").count() == 2 * len(days) + 2
    assert levels.unseen(spark.createDataFrame([(None, "2", None, "x")], SCHEMA), f"{root}/log-seen", last + 1).count() == 0
    plan = storage.read_log(spark, f"{root}/log-seen").where(F.col("time").between(days[6], days[7]))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(time," in plan  # the time range reaches the files
