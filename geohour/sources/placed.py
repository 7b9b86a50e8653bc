"""Tables stored by place: rows near each other share files, so a box reads few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geohour.operators.cells import Bounds, bbox_filter, bounds_of

_BITS = 16  # of each coordinate on the curve
_MANIFEST = "_bounds"  # hidden from whoever reads the folder as a table


def _spread(v: Column) -> Column:
    """The bits of a 16-bit number with a gap behind each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def place_on_curve(x: Column, y: Column, b: Bounds) -> Column:
    """Place of a point on a Z curve over the bounds; NULL without both coordinates."""
    def cell(v: Column, low: float, high: float) -> Column:
        share = (v - F.lit(low)) / F.lit((high - low) or 1.0)
        return F.least(F.greatest(F.floor(share * 2**_BITS), F.lit(0)), F.lit(2**_BITS - 1)).cast("long")

    return _spread(cell(x, b.min_x, b.max_x)).bitwiseOR(F.shiftleft(_spread(cell(y, b.min_y, b.max_y)), 1))


def write_by_place(df: DataFrame, path: str, x: str = "x", y: str = "y", files: int | None = None) -> None:
    """Store a table in the order of a Z curve, and the bounds of each of its files beside it.

    Spark sorts by ranges of the curve, `files` of them if given; a crowded spot falls into
    several ranges, as rows of one place are told apart by their coordinates. The bounds, a row
    per file, are read from the stored files.
    """
    b = bounds_of(df, x, y)
    place = place_on_curve(F.col(x), F.col(y), b) if b.min_x is not None else F.lit(None).cast("long")
    order = [place, F.col(x), F.col(y)]
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("compression", "snappy").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"),
    ).write.parquet(f"{path}/{_MANIFEST}")


def read_box(spark: SparkSession, path: str, box: Bounds, x: str = "x", y: str = "y") -> DataFrame:
    """The rows in a box of a table that `write_by_place` stored; only files that meet it are listed.

    Within these the box is pushed to the scan, which skips row groups by their statistics.
    """
    whole = spark.read.parquet(path)
    names = bbox_filter(spark.read.parquet(f"{path}/{_MANIFEST}"), box, "min_x", "max_x", "min_y", "max_y").select(
        F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("file"))
    found = [r.file for r in names.orderBy("file").collect()]  # as many as meet the box
    if not found:
        return whole.limit(0)
    return bbox_filter(spark.read.schema(whole.schema).parquet(*found), box, x, x, y, y)
