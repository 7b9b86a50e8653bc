"""Polled level readings as a stream: deduplicate, enrich, hourly maximum, upsert.

Late data is always accepted unless a watermark is asked for. What has been seen is kept in a
stored log of keys and not in the query's state, so memory does not grow with the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from geohour.functions.temporal import floor_hour, parse_time
from geohour.functions.values import normalize_id, safe_cast
from geohour.operators.tables import hourly_max
from geohour.session import materialize
from geohour.sources.storage import append_batch, path_exists, read_log


def dedup_readings(
    stream: DataFrame, sensor: str = "sensor_id", time: str = "time",
    event_time: str | None = None, watermark: str | None = None,
) -> DataFrame:
    """First sighting of each (trimmed sensor, raw time text).

    Without a watermark every key stays in state; with one, keys older than it are forgotten.
    """
    keyed = stream.withColumn("_sensor", normalize_id(sensor))
    if watermark is None:
        return keyed.dropDuplicates(["_sensor", time]).drop("_sensor")
    if event_time is None:
        raise ValueError("a watermark needs the event_time column")
    # Event time must be TIMESTAMP: a watermark on TIMESTAMP_NTZ is refused.
    timed = keyed.withColumn("_at", F.col(event_time).cast("timestamp"))
    once = timed.withWatermark("_at", watermark).dropDuplicatesWithinWatermark(["_sensor", time])
    return once.drop("_sensor", "_at")


def enrich(stream: DataFrame, sensor_map: DataFrame, sensor: str = "sensor_id",
           key: str = "sensor_id", cell: str = "grid_id") -> DataFrame:
    """Left join with the static map of sensors to cells; it is read anew for every batch."""
    cells = sensor_map.select(normalize_id(key).alias("_key"), cell)
    return stream.join(cells, normalize_id(sensor) == F.col("_key"), "left").drop("_key")


def unmatched(readings: DataFrame, sensor_map: DataFrame, sensor: str = "sensor_id",
              key: str = "sensor_id", cell: str = "grid_id", report: str = "location"):
    """Sensors of a feed that have no cell."""
    known = sensor_map.where(F.col(cell).isNotNull()).select(normalize_id(key).alias("_key"))
    return (
        readings.join(known, normalize_id(sensor) == F.col("_key"), "left_anti")
        .select(sensor, report).distinct()
    )


def to_hourly(
    located: DataFrame, time: str = "time", level: str = "water_level", cell: str = "grid_id",
    min_level: float | None = None,
) -> DataFrame:
    """Hourly maximum per cell; rows without cell, time or level are left out.

    `min_level` drops lower levels: the archives do so with 0, the live feed keeps them.
    """
    dtype = dict(located.dtypes)[time]
    at = parse_time(time) if dtype == "string" else F.col(time).cast("timestamp_ntz")
    rows = located.select(
        floor_hour(at).alias("time"), F.col(cell).cast("bigint").alias("grid_id"),
        safe_cast(level, "float").alias("water_level"),
    ).dropna()
    if min_level is not None:
        rows = rows.where(F.col("water_level") >= min_level)
    return hourly_max(rows, ["time", "grid_id"], "water_level")


def unseen(batch: DataFrame, keys_root: str, batch_id: int, sensor: str = "sensor_id", time: str = "time") -> DataFrame:
    """The first rows of each (trimmed sensor, raw time text) of a batch that no earlier batch had.

    The keys of a batch become a batch of the log at `keys_root`; one that runs again replaces
    its own and is compared with earlier ones only. The log is read between the least and largest
    time text of the batch, which its files are sorted by, so a batch of the present does not
    read the past; a late one reads what it needs. `storage.compact_log` puts the log together.
    """
    spark = batch.sparkSession
    first = batch.withColumn("_sensor", normalize_id(sensor)).dropDuplicates(["_sensor", time])
    if path_exists(spark, keys_root):
        low, high = batch.agg(F.min(time), F.max(time)).first()
        log = read_log(spark, keys_root)
        known = log.where((F.col("batch_id") < batch_id) & (
            F.col("time").isNull() if low is None else F.col("time").isNull() | F.col("time").between(low, high)))
        known = known.select(F.col("sensor").alias("_k"), F.col("time").alias("_t"))
        first = first.join(known, F.col("_sensor").eqNullSafe(F.col("_k")) & F.col(time).eqNullSafe(F.col("_t")), "left_anti")
    first = materialize(first, "unseen")
    keys = first.select(F.col("_sensor").alias("sensor"), F.col(time).alias("time"))
    append_batch(keys.repartitionByRange("time", "sensor").sortWithinPartitions("time", "sensor"), keys_root, batch_id)
    return first.drop("_sensor")


def start_level_stream(
    readings: DataFrame, sensor_map: DataFrame, root: str, checkpoint: str,
    interval: str | None = "300 seconds", watermark: str | None = None,
) -> StreamingQuery:
    """Store the hourly maxima of each micro-batch as one batch of the log at `root`.

    A batch that runs again after a failure replaces itself, so nothing is lost or doubled.
    `interval=None` takes what is there and ends. Late readings are always stored, and repeats of
    any age are known: what has been seen is the log `<root>-seen` (`unseen`), and the query has
    no state. With a `watermark` the keys are in state instead, for so long: a reading that
    comes again later counts anew, which maxima do not feel.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        if watermark is None:
            batch = unseen(batch, f"{root}-seen", batch_id)
        append_batch(to_hourly(enrich(batch, sensor_map)), root, batch_id)

    once = readings
    if watermark is not None:
        once = dedup_readings(readings.withColumn("_event", parse_time("time")), event_time="_event", watermark=watermark)
    writer = once.writeStream.foreachBatch(save).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(
        processingTime=interval
    )
    return writer.start()


def hourly_max_by_event_time(
    located: DataFrame, time: str, level: str, cell: str, watermark: str | None = None,
) -> DataFrame:
    """Hourly maxima in state. Without a watermark late rows count; with one the state is bounded
    and rows older than it are dropped, so it is for feeds that promise not to be later.

    Hours are cut before the cast, so the session's time zone moves none of them.
    """
    at = located.withColumn("_hour", floor_hour(F.col(time).cast("timestamp_ntz")))
    if watermark is None:
        return at.groupBy(F.col("_hour").alias("time"), cell).agg(F.max(level).alias(level))
    # A watermark on TIMESTAMP_NTZ is refused; hour and event time pass the same zone both ways.
    at = at.withColumn("_at", F.col("_hour").cast("timestamp")).withWatermark("_at", watermark)
    hourly = at.groupBy("_at", cell).agg(F.max(level).alias(level))
    return hourly.select(F.col("_at").cast("timestamp_ntz").alias("time"), cell, level)
