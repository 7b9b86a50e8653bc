"""Level service of the districts as a Python data source, batch and stream.

The client is injected: `fetch(district, first, last, start, end)` returns the decoded payload
for the rows first..last of one district. Each (district, page) is a task of its own, so a
district with very many rows is not read by one task.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, InputPartition,
)

# District codes, page size and payload names of the service.
DISTRICTS = tuple(f"{i:02d}" for i in range(1, 26))
PAGE_ROWS = 1000
PAYLOAD_ROOT = "DrainpipeMonitoringInfo"
PAYLOAD_FIELDS = {
    "sensor_id": "UNQ_NO", "water_level": "MSRMT_WATL", "time": "MSRMT_YMD",
    "location": "PSTN_INFO",
}
PAYLOAD_SCHEMA = (
    f"{PAYLOAD_ROOT} struct<row: array<struct<"
    + ", ".join(f"{name}: string" for name in PAYLOAD_FIELDS.values()) + ">>>"
)
READING_SCHEMA = "sensor_id string, water_level string, time string, location string"

Fetch = Callable[[str, int, int, str, str], dict]
ATTEMPTS = 3


def last_hour(tick: int) -> tuple[str, str]:
    """The hour that ends now, in the service's form."""
    now = datetime.now()
    return (now - timedelta(hours=1)).strftime("%Y%m%d%H"), now.strftime("%Y%m%d%H")


def _again(call: Callable, what: str, wait: float):
    """The call's result, after some attempts; the last failure names what failed."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call()
        except Exception as e:
            if attempt == ATTEMPTS:
                raise RuntimeError(f"{what} failed {ATTEMPTS} times: {e}") from e
            time.sleep(wait * attempt)


def level_source(
    name: str, fetch: Fetch, count: Callable[[str], int],
    window: Callable[[int], tuple[str, str]] = last_hour,
    districts: tuple[str, ...] = DISTRICTS, page_rows: int = PAGE_ROWS, ticks: int | None = None,
    wait: float = 0.2, max_rows: int | None = None,
) -> type[DataSource]:
    """A data source class for `spark.dataSource.register`.

    `count(district)` tells the rows of a district, `window(tick)` the requested hours of a poll.
    Calls are repeated before they count as failed. A page that fails fails the poll: it runs
    again from its offset, and no half district is ever stored. `ticks` ends the stream after so
    many polls.

    The stream keeps an offset for each district: the hour from which it is owed. A district that
    cannot be counted, or that does not fit in the `max_rows` of a poll, is left out of that poll
    as a whole, and the next one asks for all hours since. Those owed longest come first, and a
    poll takes at least one district. A batch read leaves out what cannot be counted, with a warning.
    """
    root, fields = PAYLOAD_ROOT, dict(PAYLOAD_FIELDS)

    class Page(InputPartition):
        def __init__(self, district: str, first: int, last: int, start: str = "", end: str = ""):
            self.district, self.first, self.last, self.start, self.end = district, first, last, start, end

    def counted(what: str, of: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Districts with their rows, as far as they answer."""
        for district in of:
            try:
                yield district, _again(lambda: count(district), f"district {district}", wait)
            except RuntimeError as e:
                warnings.warn(f"left out of {what}: {e}", stacklevel=2)

    def pages(of: Iterable[tuple[str, int, str, str]]) -> list[InputPartition]:
        out: list[InputPartition] = [
            Page(district, i, min(i + page_rows - 1, n), start, end)
            for district, n, start, end in of for i in range(1, n + 1, page_rows)]
        return out or [Page("", 1, 0)]

    def rows(page: Page) -> Iterator[pa.RecordBatch]:
        if page.last < page.first:
            return
        payload = _again(
            lambda: fetch(page.district, page.first, page.last, page.start, page.end),
            f"district {page.district}, rows {page.first} to {page.last}", wait)
        records = payload.get(root, {}).get("row", [])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.get(f) for r in records], pa.string()) for f in fields.values()], list(fields))

    class Batch(DataSourceReader):
        def partitions(self):
            start, end = window(0)
            return pages((d, n, start, end) for d, n in counted("the read", districts))

        def read(self, partition):
            return rows(partition)

    class Stream(DataSourceStreamReader):
        """An offset says what its poll reads, and since when each other district is owed."""

        def __init__(self):
            self.offset = self.initialOffset()
            self.planned = 0

        def initialOffset(self):
            return {"tick": 0, "end": "", "read": {}, "owed": {}}

        def latestOffset(self):
            last = self.offset
            if ticks is not None and last["tick"] >= ticks:
                return last
            tick = last["tick"] + 1
            start, end = window(tick - 1)
            owed = dict(last["owed"])
            if last["tick"] > self.planned:  # no batch has taken the last poll yet
                owed |= {d: since for d, (_, since) in last["read"].items()}
            read, size = {}, 0
            for district, n in counted(f"poll {tick}", sorted(districts, key=lambda d: (owed.get(d, start), districts.index(d)))):
                if max_rows is None or not read or size + n <= max_rows:
                    read[district] = [n, owed.get(district, start)]
                    size += n
            self.offset = {"tick": tick, "end": end, "read": read,
                           "owed": {d: owed.get(d, start) for d in districts if d not in read}}
            return self.offset

        def partitions(self, start, end):
            # After a restart the offsets come from the checkpoint; each holds all that its poll needs.
            if end["tick"] >= self.offset["tick"]:
                self.offset = end
            self.planned = max(self.planned, end["tick"])
            return pages((d, n, since, end["end"]) for d, (n, since) in end["read"].items())

        def read(self, partition):
            return rows(partition)

        def commit(self, end):
            pass

    class LevelSource(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return READING_SCHEMA

        def reader(self, schema):
            return Batch()

        def streamReader(self, schema):
            return Stream()

    return LevelSource
