"""Data-quality profiles. Each task sees partial counts, never a whole column."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and null percentage per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = counts.select("_n", F.expr(f"stack({len(df.columns)}, {pairs}) AS (column, n_null)"))
    return long.select(
        "column", "n_null", (F.col("n_null") * 100 / F.nullif("_n", F.lit(0))).alias("null_pct")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one; nulls are equal to each other."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def class_balance(df: DataFrame, flag: str) -> DataFrame:
    """Rows, positive rows and their share in percent."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(flag) == 1).alias("n_positive"),
    ).withColumn("positive_pct", F.col("n_positive") * 100 / F.nullif("n_rows", F.lit(0)))


def _literal(v: float) -> str:
    return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"


def _range_of(column: str, cuts: list[float]) -> str:
    """SQL for the number of cuts below a value, as a balanced tree of comparisons."""
    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return (f"CASE WHEN {column} <= {_literal(cuts[mid])} THEN {tree(lo, mid)} "
                f"ELSE {tree(mid + 1, hi)} END")

    return tree(0, len(cuts))


class _Range(NamedTuple):
    low: float  # smallest and largest value in it
    high: float
    n: int


def _narrowed(values: DataFrame, ranges: list[_Range], pivots: int) -> dict[int, list[_Range]]:
    """The parts of each range, in order: a sketch of the range cuts it, and its largest value is apart."""
    which = "CASE " + " ".join(
        f"WHEN _v BETWEEN {_literal(r.low)} AND {_literal(r.high)} THEN {i}" for i, r in enumerate(ranges)) + " END"
    inside = values.withColumn("_range", F.expr(which)).where(F.col("_range").isNotNull())
    shares = F.array(*[F.lit(i / pivots) for i in range(1, pivots)])
    cuts = {r["_range"]: sorted({c for c in r["cuts"] if c < ranges[r["_range"]].high}) for r in inside.groupBy("_range").agg(
        F.percentile_approx("_v", shares, 4 * pivots).alias("cuts")).collect()}
    part = "CASE " + " ".join(
        f"WHEN _range = {i} THEN CASE WHEN _v = {_literal(r.high)} THEN {pivots} ELSE {_range_of('_v', cuts[i])} END"
        for i, r in enumerate(ranges)) + " END"
    counted = inside.groupBy("_range", F.expr(part).alias("_part")).agg(
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n"))
    parts: dict[int, list[_Range]] = {}
    for r in sorted(counted.collect(), key=lambda r: (r["_range"], r["_part"])):
        parts.setdefault(r["_range"], []).append(_Range(r.low, r.high, r.n))
    return parts


def exact_quantiles(
    df: DataFrame, column: str, quantiles: dict[str, float], pivots: int = 256, most: int = 1 << 20
) -> DataFrame:
    """Exact linear-interpolated quantiles as one row.

    Spark's `percentile` gathers all distinct values in one task. Here the ranges that hold a
    wanted rank are cut by a sketch and counted, again and again, until each holds at most `most`
    rows or a single value; only these are sorted. A pass divides a range by about `pivots`, so
    10**13 rows take three. What comes to the driver are at most `pivots` numbers a rank and pass.
    """
    values = df.select(F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    n, low, high = values.agg(F.count("_v"), F.min("_v"), F.max("_v")).first()
    if not n:
        return values.agg(*[F.max("_v").alias(name) for name in quantiles])
    ranks = {f"_{name}_{end}": int(f(q * (n - 1))) for name, q in quantiles.items()
             for end, f in (("lo", math.floor), ("hi", math.ceil))}
    spots = {spot: (_Range(low, high, n), rank) for spot, rank in ranks.items()}  # and the rank in it
    while open_ranges := sorted({r for r, _ in spots.values() if r.n > most and r.low < r.high}):
        parts = _narrowed(values, open_ranges, pivots)
        for spot, (r, rank) in spots.items():
            if r in open_ranges:
                for part in parts[open_ranges.index(r)]:
                    if rank < part.n:
                        break
                    rank -= part.n
                spots[spot] = part, rank
    wanted = sorted({r for r, _ in spots.values() if r.low < r.high})
    picks = [F.lit(r.low).alias(spot) for spot, (r, _) in spots.items() if r.low == r.high]
    row = df.sparkSession.range(1).select(*picks)
    if wanted:
        which = "CASE " + " ".join(
            f"WHEN _v BETWEEN {_literal(r.low)} AND {_literal(r.high)} THEN {i}" for i, r in enumerate(wanted)) + " END"
        inside = Window.partitionBy("_range").orderBy("_v")  # at most `most` rows a range
        ranked = (
            values.withColumn("_range", F.expr(which)).where(F.col("_range").isNotNull())
            .groupBy("_range", "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_end", F.sum("_n").over(inside)))
        sorted_out = ranked.agg(*[
            F.max(F.when((F.col("_range") == wanted.index(r)) & (F.col("_end") - F.col("_n") <= rank) & (F.col("_end") > rank),
                         F.col("_v"))).alias(spot)
            for spot, (r, rank) in spots.items() if r.low < r.high])
        row = sorted_out.select("*", *picks)
    out = []
    for name, q in quantiles.items():
        share = q * (n - 1) - math.floor(q * (n - 1))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        between = F.when((low == high) | (F.lit(share) == 0), low).otherwise(low + (high - low) * F.lit(share))
        out.append(between.alias(name))
    return row.select(*out)


# Quartiles of a description.
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum as one row."""
    v = F.col(column).cast("double")
    head = df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    quartiles = exact_quantiles(df, column, QUARTILES).select(F.struct(*QUARTILES)).scalar()
    head = head.withColumn("_q", quartiles)
    return head.withColumns({q: F.col(f"_q.{q}") for q in QUARTILES}).drop("_q")


def profile_table(df: DataFrame, time: str | None = None, cell: str | None = None) -> DataFrame:
    """Rows, columns, duplicates, null cells, time range and number of cells as one row."""
    nulls = [F.col(f"`{c}`").isNull().cast("long") for c in df.columns]
    total = nulls[0]
    for one in nulls[1:]:
        total = total + one
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.sum(total).alias("n_null_cells")]
    if time:
        aggs += [F.min(time).alias("time_min"), F.max(time).alias("time_max")]
    if cell:
        aggs.append(F.count_distinct(cell).alias("n_cells"))
    out = df.agg(*aggs).withColumn("n_columns", F.lit(len(df.columns)))
    return out.withColumn("n_duplicates", duplicate_rows(df).scalar())


def coverage_report(historical: DataFrame, live: DataFrame, flagged: DataFrame, cell: str):
    """How many cells each feed covers, shares with the other, and misses among the flagged."""
    his = historical.select(cell).dropna().distinct()
    api = live.select(cell).dropna().distinct()
    wet = flagged.select(cell).dropna().distinct()
    flags = (
        his.withColumn("_s", F.lit(1))
        .unionByName(api.withColumn("_s", F.lit(2)))
        .unionByName(wet.withColumn("_s", F.lit(4)))
        .groupBy(cell).agg(F.sum("_s").alias("_s"))
    )

    def has(bit: int):
        return F.col("_s").bitwiseAND(bit) > 0

    row = flags.agg(
        F.count_if(has(1)).alias("historical_cells"),
        F.count_if(has(2)).alias("live_cells"),
        F.count_if(has(1) & has(2)).alias("shared_cells"),
        F.count_if(has(4)).alias("flagged_cells"),
        F.count_if(has(4) & has(1)).alias("flagged_in_historical"),
        F.count_if(has(4) & has(2)).alias("flagged_in_live"),
        F.count_if(has(4) & ~has(1)).alias("flagged_missing_historical"),
        F.count_if(has(4) & ~has(2)).alias("flagged_missing_live"),
    )
    pairs = ", ".join(f"'{c}', {c}" for c in row.columns)
    return row.select(F.expr(f"stack({len(row.columns)}, {pairs}) AS (metric, n)"))
