from unittest import mock

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from geohour.operators import profile


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=2, max_size=60))
def test_describe_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    r = profile.describe(df, "v").first()
    want = pd.Series(values).describe()
    assert r.n == want["count"]
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"),
                         ("q75", "75%"), ("max", "max")):
        assert r[ours] == pytest.approx(want[theirs], rel=1e-9, abs=1e-7)


def test_quantiles_with_few_pivots_and_hot_value(spark):
    rng = np.random.default_rng(0)
    values = [*rng.normal(size=700).tolist(), *[0.25] * 400]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    shares = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.99, "e": 1.0}
    r = profile.exact_quantiles(df, "v", shares, pivots=8).first()
    for name, q in shares.items():
        assert r[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_empty_describe(spark):
    r = profile.describe(spark.createDataFrame([], "v double"), "v").first()
    assert (r.n, r.q50, r.max) == (0, None, None)


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    assert profile.duplicate_rows(df).first()[0] == 2
    assert rows(profile.null_profile(df)) == [("a", 0, 0.0), ("b", 3, 75.0)]
    assert rows(profile.value_counts(df, "b")) == [("a", 1)]
    assert rows(profile.value_counts(df, "b", dropna=False)) == [(None, 3), ("a", 1)]
    r = profile.profile_table(df, cell="a").first()
    assert (r.n_rows, r.n_null_cells, r.n_cells, r.n_columns, r.n_duplicates) == (4, 3, 2, 2, 2)


def test_quantiles_with_infinities(spark):
    values = [float("inf")] * 20 + [float("-inf")] * 5 + [float(i) for i in range(75)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = profile.exact_quantiles(df, "v", {"q25": 0.25, "q50": 0.5, "q90": 0.9}).first()
    assert row.q50 == 44.5 and row.q90 == float("inf") and 19 <= row.q25 <= 20


@pytest.mark.parametrize("most", [1, 20, 400])
def test_quantiles_narrow_until_few_rows_are_left(spark, most):
    rng = np.random.default_rng(4)
    values = [*rng.normal(size=900).tolist(), *[0.25] * 500, *[3.0] * 300, *[-9.0] * 200, float("inf"), float("-inf")]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = {f"q{i}": i / 40 for i in range(1, 40)}
    r = profile.exact_quantiles(df, "v", shares, pivots=8, most=most).first()
    for name, q in shares.items():
        assert r[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_narrowing_sorts_a_bounded_range(spark):
    df = spark.range(200_000).select((F.col("id") % 50_021).cast("double").alias("v"))
    seen = []
    kept = profile._narrowed
    with mock.patch.object(profile, "_narrowed", side_effect=lambda v, r, p: seen.append([x.n for x in r]) or kept(v, r, p)):
        r = profile.exact_quantiles(df, "v", {"q50": 0.5}, pivots=16, most=1000).first()
    assert r.q50 == np.quantile(np.arange(200_000) % 50_021, 0.5)
    # each pass is far smaller than the one before, and the last one leaves at most 1000 rows
    assert len(seen) == 3 and all(max(b) < max(a) / 4 for a, b in zip(seen, seen[1:]))
