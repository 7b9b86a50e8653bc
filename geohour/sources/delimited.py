"""Text tables: mixed charsets, headered and headerless layouts, malformed lines."""

from __future__ import annotations

import csv
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geohour.functions.temporal import LEGACY_LEVEL_FORMAT, parse_time
from geohour.functions.values import normalize_id, safe_cast
from geohour.session import materialize

# Header spellings of the feeds, and the layout of old files without a header.
KOREAN = "cp949"
GAUGE_STATION, GAUGE_TIME, GAUGE_RAIN = "지점", "일시", "강수량(mm)"
PERIOD_START, PERIOD_END, STATION_LAT, STATION_LON = "시작일", "종료일", "위도", "경도"
LEVEL_HEADERS = {
    "unq_no": ("UNQ_NO", "unq_no", "고유번호", "?고유번호"),
    "se_cd": ("SE_CD", "se_cd", "구분코드"),
    "se_nm": ("SE_NM", "se_nm", "구분명"),
    "msrmt_ymd": ("MSRMT_YMD", "msrmt_ymd", "측정일자"),
    "msrmt_watl": ("MSRMT_WATL", "msrmt_watl", "측정수위"),
    "sgn_stts": ("SGN_STTS", "sgn_stts", "통신상태"),
    "pstn_info": ("PSTN_INFO", "pstn_info", "위치정보"),
}
LEGACY_COLUMNS = (
    "unq_no", "legacy_se_cd", "se_nm", "legacy_time", "msrmt_ymd", "msrmt_watl", "sgn_stts",
)
LAST_LEGACY_YEAR = 2018

BYTE_ORDER_MARK = "\ufeff"


def standardize_columns(df: DataFrame, source: Column | None = None) -> DataFrame:
    """Bring any of the header spellings to the standard columns, in a fixed order.

    Missing columns are NULL. `source` is kept as `source_file`.
    """
    present = {c.lstrip(BYTE_ORDER_MARK).strip(): c for c in df.columns}
    out = []
    for name, spellings in LEVEL_HEADERS.items():
        found = [F.col(f"`{present[s]}`").cast("string") for s in spellings if s in present]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    lineage = source if source is not None else F.lit(None)
    return df.select(*out, lineage.cast("string").alias("source_file"))


def read_gauge_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gauge files below a folder; only the three used columns are parsed."""
    return read_csv_any_charset(spark, path, (GAUGE_STATION, GAUGE_TIME, GAUGE_RAIN)).select(
        parse_time(f"`{GAUGE_TIME}`").alias("time"),
        safe_cast(f"`{GAUGE_STATION}`", "smallint").alias("station"),
        safe_cast(f"`{GAUGE_RAIN}`", "float").alias("rain_1h"),
    )


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """Station periods with their coordinates."""
    return read_csv_any_charset(spark, path).select(
        safe_cast(f"`{GAUGE_STATION}`", "smallint").alias("station"),
        parse_time(f"`{PERIOD_START}`").alias("start_date"),
        parse_time(f"`{PERIOD_END}`").alias("expired_date"),
        safe_cast(f"`{STATION_LAT}`", "double").alias("lat"),
        safe_cast(f"`{STATION_LON}`", "double").alias("lon"),
    )


# Members of archives, plain or compressed.
CSV_FILES = "*.{csv,csv.gz}"


def raw_lines(spark: SparkSession, path: str, files: str = CSV_FILES) -> DataFrame:
    """(file, n, at_start, value): lines below a folder as raw bytes, in splits; blank ones are left out.

    `n` grows along each file, and equal readings number the lines alike. A file that cannot be
    read on ends there; `unreadable_files` names it.
    """
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files)
        .option("ignoreCorruptFiles", True).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"),
                (F.col("_metadata.file_block_start") == 0).alias("at_start"), "value")
        .where(F.trim("value") != "")
    )


def _gzip_fault(data: bytes) -> str | None:
    """What is wrong with a compressed file; its text is unpacked by pieces and not kept."""
    while data:
        unpack = zlib.decompressobj(wbits=31)
        try:
            rest = data
            while rest and not unpack.eof:
                unpack.decompress(rest, 1 << 20)
                rest = unpack.unconsumed_tail
        except zlib.error as e:
            return f"corrupt: {e}"
        if not unpack.eof:
            return "truncated"
        data = unpack.unused_data.lstrip(b"\0")
    return None


def _gzip_faults(batches):
    for batch in batches:
        reasons = [_gzip_fault(c.as_py() or b"") for c in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(reasons, pa.string())], ["file", "reason"])


def unreadable_files(spark: SparkSession, path: str, files: str = CSV_FILES) -> DataFrame:
    """(file, reason) of files below a folder that hold nothing or cannot be read to their end.

    Each file is judged apart, by the task that holds it: no line, bytes that no text has, or a
    damaged compression. Spark lists no file of 0 bytes, so such a file is not named. Only compressed files are opened whole, one at a time (Spark gives up
    to 2 GB of a file as one value); they could not be split anyway.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    every = listed.option("pathGlobFilter", files).load(path).select(F.col("_metadata.file_path").alias("file"))
    packed = listed.option("pathGlobFilter", "*.gz").load(path).select(F.col("_metadata.file_path").alias("file"), "content")
    damaged = packed.mapInArrow(_gzip_faults, "file string, reason string").where("reason IS NOT NULL")
    text = raw_lines(spark, path, files).groupBy("file").agg(F.bool_or(F.contains("value", F.lit("\0"))).alias("binary"))
    found = every.join(damaged, "file", "left").join(text, "file", "left")
    reason = F.coalesce("reason", F.when(F.col("binary").isNull(), "no line").when(F.col("binary"), "no text"))
    return found.select("file", reason.alias("reason")).where("reason IS NOT NULL")


def file_facts(spark: SparkSession, path: str, files: str = CSV_FILES) -> DataFrame:
    """(file, utf8, first_n, head) of each readable file below a folder, stored; a row per file.

    A file is utf-8 when all its lines are sound utf-8, else it is taken for the Korean charset.
    """
    per_file = raw_lines(spark, path, files).groupBy("file").agg(
        F.bool_and(F.expr("is_valid_utf8(value)")).alias("utf8"),
        F.min(F.when(F.col("at_start"), F.col("n"))).alias("first_n"),
        F.min_by("value", F.when(F.col("at_start"), F.col("n"))).alias("head"))
    readable = per_file.join(unreadable_files(spark, path, files), "file", "left_anti")
    return materialize(readable.withColumn("head", _decoded(F.col("head"))), "csv-files")


def _decoded(value: Column) -> Column:
    raw = value.cast("binary")
    return F.when(F.col("utf8"), F.decode(raw, "utf-8")).otherwise(F.decode(raw, KOREAN))


def _fields(head: str) -> tuple[str, ...]:
    """Names of a header line, quoted ones whole. A name that was there before gets a number."""
    names, seen = [], set()
    for raw in next(csv.reader([head.lstrip(BYTE_ORDER_MARK)], skipinitialspace=True), []):
        base = name = raw.strip()
        n = 0
        while name.lower() in seen:
            n += 1
            name = f"{base}.{n}"
        seen.add(name.lower())
        names.append(name)
    return tuple(names)


def _layouts(facts: DataFrame) -> tuple[DataFrame, list[str]]:
    """(head, names) of the different header lines, names in lower case, and the names as first spelled.

    There is one row per layout, however many files have it.
    """
    heads = [r.head for r in facts.select("head").distinct().orderBy("head").toLocalIterator()]
    layouts = [(h, _fields(h)) for h in heads]
    spelled = {n.lower(): n for _, names in reversed(layouts) for n in reversed(names)}
    order = dict.fromkeys(n.lower() for _, names in layouts for n in names)
    table = facts.sparkSession.createDataFrame(
        [(h, [n.lower() for n in names]) for h, names in layouts], "head string, names array<string>")
    return F.broadcast(table), [spelled[n] for n in order]


def parsed_rows(lines: DataFrame, width: int) -> DataFrame:
    """The lines (value, utf8, names) with their fields; those with more fields than names are left out.

    A short line is padded with NULL, as its further fields are.
    """
    columns = [f"c{i}" for i in range(width + 1)]
    options = {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = F.from_csv(_decoded(F.col("value")), ", ".join(f"{c} string" for c in columns), options)
    whole = lines.withColumn("parsed", parsed).withColumn("fields", F.array(*[F.col("parsed")[c] for c in columns]))
    beyond = F.slice("fields", F.size("names") + 1, F.greatest(F.lit(width + 1) - F.size("names"), F.lit(0)))
    return whole.where(~F.exists(beyond, lambda f: f.isNotNull())).drop("parsed")


def field(name: str) -> Column:
    """The field of that name of a parsed row; NULL where its file has none."""
    return F.get("fields", (F.array_position("names", name.lower()) - 1).cast("int"))


def read_layout(spark: SparkSession, path: str, columns: list[str], files: str = CSV_FILES) -> DataFrame:
    """All-string rows of files without a header, with one layout, below a folder; adds `source_file`."""
    lines = raw_lines(spark, path, files).join(file_facts(spark, path, files).select("file", "utf8"), "file")
    rows = parsed_rows(lines.withColumn("names", F.array(*map(F.lit, columns))), len(columns))
    return rows.select(*[field(c).alias(c) for c in columns], F.col("file").alias("source_file"))


def quarantined_files(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """(file, reason) of the files that `read_csv_any_charset` leaves out."""
    bad = unreadable_files(spark, path)
    facts = file_facts(spark, path)
    wanted = F.array(*[F.lit(r.lower()) for r in required]).cast("array<string>")
    lacks = facts.join(_layouts(facts)[0], "head").withColumn("lacking", F.array_except(wanted, "names"))
    return bad.unionByName(lacks.where(F.size("lacking") > 0).select(
        "file", F.concat(F.lit("no column "), F.array_join("lacking", ", ")).alias("reason")))


def read_csv_any_charset(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """Headered csv files of mixed charset and header as one table.

    Files that are empty, damaged, no text, or lack one of the `required` columns are left out;
    `quarantined_files` names them with the reason. The files are a table that the lines of all
    files are joined with, so the driver sees one row per layout and none per file.
    """
    facts = file_facts(spark, path)
    layouts, names = _layouts(facts)
    if not names:
        raise ValueError(f"no csv file with content below {path}")
    wanted = F.array(*[F.lit(r.lower()) for r in required]).cast("array<string>")
    known = facts.join(layouts, "head").where(F.size(F.array_except(wanted, "names")) == 0)
    lines = raw_lines(spark, path).join(known.select("file", "utf8", "first_n", "names"), "file")
    rows = parsed_rows(lines.where(F.col("n") != F.col("first_n")), len(names))
    return rows.select(*[field(n).alias(n) for n in names], F.col("file").alias("source_file"))


def file_year(file: Column) -> Column:
    """Year named by the last folder of a path that names one; NULL without such."""
    found = F.regexp_extract_all(file, F.lit(r"/(\d{4})(?=/)"), F.lit(1))
    return F.get(found, F.size(found) - 1).cast("int")


def read_level_files(spark: SparkSession, path: str) -> DataFrame:
    """Level archives below `path`/<year>/ in standard columns with parsed time and level.

    Up to 2018 files have no header and seven columns by position; later ones have a header.
    Files that are empty, damaged or no text are left out (`unreadable_files`).
    """
    old = F.coalesce(file_year(F.col("file")) <= LAST_LEGACY_YEAR, F.lit(False))
    facts = file_facts(spark, path)
    if facts.isEmpty():
        raise ValueError(f"no level file with content below {path}")
    layouts, names = _layouts(facts.where(~old))
    legacy = F.array(*map(F.lit, LEGACY_COLUMNS))
    known = facts.join(layouts, "head", "left").select(
        "file", "utf8", "first_n", old.alias("old"), F.when(old, legacy).otherwise(F.col("names")).alias("names"))
    lines = raw_lines(spark, path).join(known, "file").where("old OR n != first_n")
    rows = parsed_rows(lines, max(len(LEGACY_COLUMNS), len(names)))
    spelled = {n: F.coalesce(*[field(x) for x in spellings]) for n, spellings in LEVEL_HEADERS.items()}
    spelled["se_cd"] = F.when(F.col("old"), field("legacy_se_cd")).otherwise(spelled["se_cd"])
    out = rows.select("old", *[c.alias(n) for n, c in spelled.items()], F.col("file").alias("source_file"))
    time = F.when(F.col("old"), parse_time("msrmt_ymd", (LEGACY_LEVEL_FORMAT,))).otherwise(parse_time("msrmt_ymd"))
    return out.withColumns({
        "msrmt_ymd": time, "unq_no": normalize_id("unq_no"), "msrmt_watl": safe_cast("msrmt_watl", "float"),
    }).drop("old")
