"""Helpers shared by the operators: session settings, row keys, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from geohour.session import configure, materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rows of text that one Python call may hold; Spark also ends a batch at this many bytes.
ARROW_ROWS, ARROW_BYTES = "1000", "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches small enough for very long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def struct_type(fields: str) -> StructType:
    """Simple types by name, as in "a long, b string"; needs no running session."""
    made = StructType()
    for field in fields.split(", "):
        made = made.add(*field.split(" "))
    return made


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(col, UPPER, UPPER.lower())


BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its rows, which are counted, take at most `limit` bytes.

    A row counts 16 bytes a column and the length of its strings and arrays, 8 bytes for each
    number in them and 32 more for a struct. Beyond the limit
    `df` is returned as it is, and the join shuffles.
    """
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            each = 32 + 8 * kind.count(":") if kind.startswith("array<struct") else 8
            width = width + each * F.greatest(F.size(name), F.lit(0))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def free_name(df: DataFrame, base: str) -> str:
    """`base`, or the first of base_1, base_2, ... that is no column of `df` in any case."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): root is the smallest node that each node reaches.

    `edges` has the columns a and b of one ordered type. Alternates large-star and small-star
    steps until no edge changes: each step is one aggregation per node and one join, so a hub
    is an aggregate and no list, and AQE splits the hub's side of the join. The edges are
    written to the shared folder after each round, which cuts the lineage and survives lost
    executors. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    e = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), name,
    )
    before = None
    while True:
        both = e.union(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        # large star: larger neighbours of v link to the smallest of v's neighbourhood
        large = (
            both.where("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m"))
            .distinct()
        )
        # small star: v and its smaller neighbours link to the smallest of them
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = (
            large.join(least, "v").where("m != low").select(F.col("m").alias("v"), F.col("low").alias("m"))
            .union(least.select("v", F.col("low").alias("m"))).where("v != m").distinct()
        )
        e = materialize(small, name)
        state = e.agg(
            F.count("*"), F.bit_xor(F.xxhash64("v", "m")), F.sum(F.pmod(F.xxhash64("m", "v"), F.lit(1 << 31)))
        ).first()
        if before == state:
            break
        before = state
    roots = e.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return roots.union(e.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
