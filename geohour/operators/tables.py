"""Relational helpers: filling, deduplication, data-dependent columns, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hourly_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest value per group; partial maxima are taken before the shuffle."""
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def fill_with_aggregate(df: DataFrame, column: str, aggregate: Column) -> DataFrame:
    """Fill nulls with one aggregate of the same table, as a scalar subquery."""
    return df.withColumn(column, F.coalesce(F.col(column), df.agg(aggregate).scalar()))


def dedup_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key. Spark keeps one row per key and map task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Row with the largest order value per key, by a partial and a final aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def groups_with_many(df: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that occur more than once."""
    many = df.groupBy(key).count().where(F.col("count") > 1).select(key)
    return df.join(many, key, "left_semi")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all: one aggregate of one row decides."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def first_distinct(df: DataFrame, column: str, n: int, order: str) -> DataFrame:
    """The n values of a column that come first by `order`, each with its first order value."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias(order))
    return firsts.orderBy(order, column).limit(n)


def validate(df: DataFrame, required: list[str], name: str = "table", non_empty: bool = True,
             numeric: tuple[str, ...] = (), epsg: str | None = None, wanted_epsg: int | None = None):
    """Raise ValueError for a table that later steps cannot use; else hand the table on.

    Checked are missing columns, an empty table, columns of `numeric` that hold text which is no
    number, and rows whose reference system, in the column `epsg`, is not `wanted_epsg`.
    """
    missing = [c for c in [*required, *numeric, *([epsg] if epsg else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}, has {df.columns}")
    wrong = [F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull()).alias(c) for c in numeric]
    if epsg:
        wrong.append(F.count_if(~F.col(epsg).eqNullSafe(F.lit(wanted_epsg))).alias(epsg))
    if wrong:
        found = {c: n for c, n in df.agg(*wrong).first().asDict().items() if n}
        if found:
            raise ValueError(f"{name}: rows with unusable values {found}")
    if non_empty and df.isEmpty():
        raise ValueError(f"{name}: no rows")
    return df


ROWS_PER_BLOCK = 4_000_000


def cross_skeleton(times: DataFrame, cells: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every time with every cell.

    The product is the result asked for. It is built as an equality join on hash blocks of the
    cells, so that it is spread over tasks: only the list of hours is repeated, once per block.
    By default there are 64 blocks, or as many as keep the rows of one within ROWS_PER_BLOCK, and
    no more than cells.
    """
    if blocks is None:
        n_times, n_cells = times.count(), cells.count()
        blocks = max(1, min(n_cells, max(64, -(-n_times * n_cells // ROWS_PER_BLOCK))))
    left = times.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = cells.withColumn("_block", F.pmod(F.xxhash64(*cells.columns), F.lit(blocks)).cast("int"))
    return left.join(right, "_block").drop("_block")
