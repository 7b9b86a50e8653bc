"""Time columns. The library works on TIMESTAMP_NTZ: naive local wall-clock time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Timestamp spellings found in the feeds, besides ISO dates and times.
LEGACY_LEVEL_FORMAT = "dd-MMM-yy HH:mm:ss"
COMPACT_FORMATS = ("yyyyMMdd", "yyyyMMddHH", "yyyyMMddHHmmss")
SLASH_FORMATS = ("yyyy/MM/dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss")
MIXED_FORMATS = (*COMPACT_FORMATS, *SLASH_FORMATS)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_hour(c: Column | str) -> Column:
    """Start of the hour, NTZ in and out: no detour over the session time zone."""
    c = col(c)
    return c.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(c))


def next_midnight(c: Column | str) -> Column:
    return F.date_add(col(c).cast("date"), 1).cast("timestamp_ntz")


def plus_hours(day: Column | str, hours: Column | str) -> Column:
    """A date plus an integer hour column."""
    return col(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), col(hours))


def hour_stamp(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyyMMddHH")


def hour_range_stamps(now: Column | str) -> tuple[Column, Column]:
    """Request window of the level service: one hour ago and now, as yyyyMMddHH."""
    now = col(now)
    return hour_stamp(now - F.make_dt_interval(F.lit(0), F.lit(1))), hour_stamp(now)


def parse_time(c: Column | str, formats: tuple[str, ...] | None = None) -> Column:
    """First format that fits; NULL when none does. Without formats: ISO, then the mixed ones."""
    text = F.trim(col(c).cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")
             for f in formats or MIXED_FORMATS]
    if formats is None:
        tries.insert(0, text.try_cast("timestamp_ntz"))
    return F.coalesce(*tries)


def day_bucket(c: Column | str, days: int) -> Column:
    """Calendar bucket number of fixed width."""
    since_epoch = F.datediff(col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    return F.floor(since_epoch / F.lit(days)).cast("int")


def hour_bucket(c: Column | str, hours: int) -> Column:
    """Bucket number of so many clock hours, counted from the epoch."""
    at = col(c).cast("timestamp_ntz")
    since_epoch = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(at)
    return F.floor(since_epoch / F.lit(hours)).cast("long")
