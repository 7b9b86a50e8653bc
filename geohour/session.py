"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the library relies on. AQE picks broadcast or shuffle joins from
# measured sizes and splits skewed join partitions, also where that costs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",  # `plans.dataset` lifts it for its result
    # A union that passes for dealt by a key lets AQE coalesce each of its sides on its own, so that
    # a later step by that key finds the rows of one key in several partitions.
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.legacy.javaCharsets": "true",  # without it cp949 is refused
    "spark.sql.legacy.codingErrorAction": "true",  # a byte that fits no charset is marked, not fatal
}


# Where this package lies; Python workers look for it there, wherever the driver was started.
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session, and let its workers find the package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, PACKAGE_ROOT])
    return spark


def local_session(cores: int = 8, app: str = "geohour") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Where the setting is missing, a temporary folder stands in for it, but only in local
    mode: on a cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="geohour-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for the tables of one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For tables that several later steps read: it cuts their lineage, survives lost executors,
    and gives the planner true sizes. `clear_scratch` deletes it.
    """
    path = run_dir(df.sparkSession, name)
    _scratch.append(path)
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process; only for when no result still reads them."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    n = len(_scratch)
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
