"""The plans are the ones meant: filters reach the scan, shuffles stay where they belong."""

import os

import pytest
from pyspark.sql import functions as F

from geohour.operators.idw import idw_over_time
from geohour.operators.tables import dedup_first, fill_with_aggregate
from geohour.plans.dataset import assemble_dataset
from geohour.session import configure
from workload import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    box = plan(QUERIES["bbox_filter"](spark, SF_DIR))
    assert "GreaterThanOrEqual(c_nationkey,5)" in box and "LessThanOrEqual(c_acctbal,4000.0)" in box
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in box
    numeric = plan(QUERIES["filter_numeric"](spark, SF_DIR))
    assert "GreaterThanOrEqual(l_discount,0.05)" in numeric and "l_quantity" not in numeric
    assert "l_tax" not in plan(QUERIES["scan_parquet"](spark, SF_DIR))


def test_first_rows_are_picked_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    text = plan(dedup_first(df, ["k"], ["id"]))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Partial")


def test_filling_needs_no_cross_join(spark):
    df = spark.range(10).select(F.nullif("id", F.lit(3)).alias("v"))
    text = plan(fill_with_aggregate(df, "v", F.max("v")))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_interpolation_shuffles_readings_only(spark):
    near = spark.createDataFrame([("p", 1, 10, 1.0)], "period string, cell int, station int, distance double")
    cells = spark.createDataFrame([("p", 1)], "period string, cell int")
    values = spark.createDataFrame([("t", "p", 10, 2.0)], "time string, period string, station int, v double")
    text = plan(idw_over_time(near, values, cells, "cell", "station", "time", "period", ("v",)))
    above = text[:text.index("REPARTITION_BY_COL")]
    assert above.count("Exchange hashpartitioning") == 1  # the repartition itself


def test_interpolation_of_many_neighbours_makes_the_hours_after_the_shuffle(spark):
    near = spark.createDataFrame([("p", 1, 10, 1.0)], "period string, cell int, station int, distance double")
    cells = spark.createDataFrame([("p", c) for c in range(50)], "period string, cell int")
    values = spark.createDataFrame([("t", "p", 10, 2.0)], "time string, period string, station int, v double")
    text = plan(idw_over_time(near, values, cells, "cell", "station", "time", "period", ("v",), broadcast_rows=0, group_rows=10))
    above = text[:text.index("REPARTITION_BY_NUM")]
    assert above.count("Exchange hashpartitioning") == 1  # of what met, and a row for each period of a cell
    assert "[0,1" not in text  # no list of blocks: readings are not copied for cells that have none of them near


def test_the_assembled_rain_stays_where_it_lies(spark):
    layer = spark.range(9).select(F.col("id").cast("int").alias("grid_id"), F.lit(1.0).alias("elevation"))
    hours = layer.select("grid_id", F.expr("TIMESTAMP_NTZ '2024-01-01 05:00:00'").alias("time"))
    history = hours.select("grid_id", F.col("time").alias("start_ts"), F.col("time").alias("end_ts"))
    rain = hours.withColumn("rain_1h", F.lit(1.0)).repartition(9, "grid_id")
    out = assemble_dataset(rain, history,
                           hours.select(F.col("grid_id").cast("long"), "time", F.lit(2.0).alias("water_level")), layer,
                           layer.select("grid_id", F.lit(0).alias("is_river")))
    text = plan(out)
    assert text[:text.index("REPARTITION_BY_NUM")].count("Exchange hashpartitioning") == 1
    assert sorted(r.grid_id for r in out.collect() if r.flood == 1 and r.water_level == 2.0) == list(range(9))
    configure(spark)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["spatial_point_cell", "knn_radius", "idw_interpolate", "asof_join",
                                  "period_lookup", "cross_skeleton", "nearest_distance"])
def test_joins_are_by_equality(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
