"""Stored tables: plain writes, new versions, and append-only batch logs.

Nothing is rewritten in place. A version becomes visible when its success marker is there; a
batch that runs again replaces only itself. So a lost executor or a failed job leaves the
previous state readable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geohour.operators.tables import hourly_max, keep_last
from geohour.session import materialize


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, encoding: str = "utf-8") -> None:
    df.write.option("header", True).option("encoding", encoding).csv(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("v=") and path_exists(spark, f"{root}/{name}/_SUCCESS"):
            found.append(int(name[2:]))
    return sorted(found)


def write_version(df: DataFrame, root: str) -> str:
    """Write the next version of a table and return its folder."""
    known = versions(df.sparkSession, root)
    path = f"{root}/v={(known[-1] if known else 0) + 1:08d}"
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    known = versions(spark, root)
    if not known:
        raise ValueError(f"no complete version below {root}")
    return spark.read.parquet(f"{root}/v={known[-1]:08d}")


def drop_stored_column(spark: SparkSession, root: str, *columns: str) -> str:
    """New version of a stored table without the given columns."""
    return write_version(read_latest(spark, root).drop(*columns), root)


def append_batch(df: DataFrame, root: str, batch_id: int) -> None:
    """Store one batch of a log; the same batch again replaces itself."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(
        f"{root}/batch_id={batch_id}"
    )


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All batches, with their number as `batch_id`."""
    log = spark.read.option("basePath", root).parquet(f"{root}/batch_id=*")
    return log.withColumn("batch_id", F.col("batch_id").cast("long"))


def resolve_max(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Accumulated table in which the largest value of a key wins."""
    return hourly_max(log, keys, value)


def resolve_last(log: DataFrame, keys: list[str]) -> DataFrame:
    """Accumulated table in which the latest batch of a key wins."""
    return keep_last(log, keys, "batch_id").drop("batch_id")


def compact_log(spark: SparkSession, root: str, keys: list[str], value: str | None = None) -> None:
    """Put the batches of a log together: the largest `value` of a key stays, else its last row.

    The result takes the number of the last batch, so reads that resolve by batch agree before,
    between and after the steps, and a run that broke off can run again.
    """
    log = read_log(spark, root)
    last = log.agg(F.max("batch_id")).first()[0]
    whole = resolve_max(log.drop("batch_id"), keys, value) if value else resolve_last(log, keys)
    append_batch(materialize(whole, "compacted-log"), root, last)
    fs, p = _fs(spark, root)
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name[9:]) < last:
            fs.delete(status.getPath(), True)


def compact_chunks(spark: SparkSession, source: str, target: str, order: list[str],
                   glob: str = "*.parquet") -> None:
    """Merge chunk files into one dataset sorted by `order`.

    Range partitioning spreads also a hot first key, since the later keys take part in it.
    """
    chunks = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .parquet(source)
    )
    chunks.repartitionByRange(*order).sortWithinPartitions(*order).write.option(
        "compression", "snappy"
    ).parquet(target)
