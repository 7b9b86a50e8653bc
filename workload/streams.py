"""Streaming operators and the polled source, driven to completion and read from their sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from geohour.session import run_dir
from geohour.sources import storage
from geohour.sources.payload import readings_from_payload
from geohour.sources.rest import PAYLOAD_ROOT, level_source
from geohour.streaming import levels
from workload.registry import query, table

EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                "value double, props string")


def event_stream(spark, d):
    # As a pattern, so that the table may be one file or a folder of files.
    return spark.readStream.schema(EVENT_SCHEMA).parquet(f"{d}/events.parquet*")


def finish(stream, root, mode="append"):
    """Run a stream over what is there and read its parquet sink."""
    q = stream.writeStream.format("parquet").outputMode(mode).option(
        "checkpointLocation", f"{root}/checkpoint"
    ).option("path", f"{root}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


@query("stream_dedup", """
    SELECT DISTINCT CAST(user_id AS VARCHAR) AS sensor_id, strftime(ts, '%Y-%m-%d %H') AS time
    FROM events""")
def stream_dedup(spark, d):
    readings = event_stream(spark, d).select(
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("sensor_id"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("time"),
    )
    once = levels.dedup_readings(readings)
    once = once.withColumn("sensor_id", F.trim("sensor_id"))
    return finish(once, run_dir(spark, "stream-dedup"))


def sensor_map(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("sensor_id"),
        F.col("s_nationkey").cast("bigint").alias("grid_id"),
    )


@query("stream_enrich", """
    SELECT event_id, CAST(user_id AS VARCHAR) AS sensor_id, CAST(s_nationkey AS BIGINT) AS grid_id
    FROM events LEFT JOIN supplier ON user_id = s_suppkey""")
def stream_enrich(spark, d):
    readings = event_stream(spark, d).select(
        "event_id", F.col("user_id").cast("string").alias("sensor_id")
    )
    return finish(levels.enrich(readings, sensor_map(spark, d)), run_dir(spark, "stream-enrich"))


HOURLY_SQL = """
    SELECT date_trunc('hour', ts) AS time, CAST(s_nationkey AS BIGINT) AS grid_id, max(value) AS water_level
    FROM events JOIN supplier ON user_id = s_suppkey GROUP BY ALL"""
BATCHES = 3


def arrivals(rows, root, run):
    """The rows arrive in BATCHES parts, by event id, so each part has rows older than the last's
    newest. Each part is written and then streamed, as one batch of the same stream.
    """
    for part in range(BATCHES):
        rows.where(F.pmod("event_id", F.lit(BATCHES)) == part).drop("event_id").write.mode("append").parquet(
            f"{root}-in/part={part}")
        run(rows.sparkSession.readStream.schema(rows.drop("event_id").schema).parquet(f"{root}-in/*")).awaitTermination()


@query("stream_hourly_max", HOURLY_SQL)
def stream_hourly_max(spark, d):
    root = run_dir(spark, "stream-hourly")
    rows = table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("sensor_id"), "ts", F.col("value").alias("water_level"))
    sensors = sensor_map(spark, d)

    # Update mode hands out the hours that changed, also by late rows.
    def run(readings):
        located = levels.enrich(readings, sensors).where(F.col("grid_id").isNotNull())
        hourly = levels.hourly_max_by_event_time(located, "ts", "water_level", "grid_id")
        return hourly.writeStream.outputMode("update").foreachBatch(
            lambda batch, batch_id: storage.append_batch(batch, root, batch_id)
        ).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start()

    arrivals(rows, root, run)
    return storage.resolve_last(storage.read_log(spark, root), ["time", "grid_id"])


UPSERT_SQL = """
    SELECT date_trunc('hour', ts) AS time, CAST(s_nationkey AS BIGINT) AS grid_id,
           CAST(max(CAST(value AS FLOAT)) AS FLOAT) AS water_level
    FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL)
         JOIN supplier ON user_id = s_suppkey GROUP BY 1, 2"""


@query("stream_upsert", f"""
    WITH b AS (
      SELECT date_trunc('hour', ts) AS time, CAST(s_nationkey AS BIGINT) AS grid_id, event_id % {BATCHES} AS part,
             max(CAST(value AS FLOAT)) AS water_level
      FROM events JOIN supplier ON user_id = s_suppkey GROUP BY ALL)
    SELECT time, grid_id, CAST(arg_max(water_level, part) AS FLOAT) AS water_level FROM b GROUP BY ALL""")
def stream_upsert(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("sensor_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"),
        F.col("value").cast("string").alias("water_level"),
    )
    root = run_dir(spark, "stream-upsert")
    sensors = sensor_map(spark, d)
    arrivals(rows, root, lambda readings: levels.start_level_stream(
        readings, sensors, root, f"{root}-checkpoint", interval=None))
    return storage.resolve_last(storage.read_log(spark, root), ["time", "grid_id"])


# ---- polled service -------------------------------------------------------------------------

PAGE_ROWS = 25_000


def payload_store(spark, d) -> str:
    """The service's answers, made by Spark of the events: one JSON file per district and page.

    A page covers a fixed span of event ids, so the rows collected into one are bounded.
    """
    root = run_dir(spark, "service")
    record = F.struct(
        F.col("user_id").cast("string").alias("UNQ_NO"), F.col("value").cast("string").alias("MSRMT_WATL"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("MSRMT_YMD"),
        F.col("event_type").alias("PSTN_INFO"),
    )
    district = F.lpad((F.pmod("user_id", F.lit(25)) + 1).cast("string"), 2, "0")
    pages = table(spark, d, "events").groupBy(
        district.alias("district"), F.floor(F.col("event_id") / PAGE_ROWS).alias("page")
    ).agg(F.collect_list(record).alias("row"))
    body = F.to_json(F.struct(F.struct("row").alias(PAYLOAD_ROOT)))
    pages.select("district", "page", body.alias("value")).write.partitionBy(
        "district", "page"
    ).text(root)
    return root


def service(root: str):
    """A client over the stored answers; it is shipped to the tasks."""
    uri = root if "://" in root else f"file://{root}"
    page_rows = PAGE_ROWS

    def listing(path):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        return system, system.get_file_info(fs.FileSelector(f"{base}/{path}", allow_not_found=True))

    def count(district):
        pages = [int(f.base_name.removeprefix("page=")) for f in listing(f"district={district}")[1]
                 if f.base_name.startswith("page=")]
        return page_rows * (max(pages, default=-1) + 1)

    def fetch(district, first, last, start, end):
        system, files = listing(f"district={district}/page={first // page_rows}")
        answer = {PAYLOAD_ROOT: {"row": []}}
        for f in files:
            if f.path.endswith(".txt"):
                with system.open_input_stream(f.path) as body:
                    answer[PAYLOAD_ROOT]["row"] += json.loads(body.read())[PAYLOAD_ROOT]["row"]
        return answer

    return fetch, count


READINGS_SQL = """
    SELECT CAST(user_id AS VARCHAR) AS sensor_id, CAST(value AS VARCHAR) AS water_level,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, event_type AS location FROM events"""


@query("payload_readings", READINGS_SQL)
def payload_readings(spark, d):
    return readings_from_payload(spark.read.text(payload_store(spark, d)), "value")


@query("rest_source", READINGS_SQL)
def rest_source(spark, d):
    fetch, count = service(payload_store(spark, d))
    spark.dataSource.register(level_source("geohour_levels", fetch, count, page_rows=PAGE_ROWS))
    return spark.read.format("geohour_levels").load()


@query("stream_poll", UPSERT_SQL.replace("user_id, ts,", "user_id, date_trunc('second', ts) AS ts,"))
def stream_poll(spark, d):
    # Two polls bring the same readings; the second adds nothing.
    fetch, count = service(payload_store(spark, d))
    spark.dataSource.register(level_source(
        "geohour_level_stream", fetch, count, page_rows=PAGE_ROWS, ticks=2))
    root = run_dir(spark, "stream-poll")
    readings = spark.readStream.format("geohour_level_stream").load()
    q = levels.start_level_stream(readings, sensor_map(spark, d), root, f"{root}-checkpoint",
                                  interval="0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return storage.resolve_last(storage.read_log(spark, root), ["time", "grid_id"])
