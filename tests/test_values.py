import pytest
from pyspark.sql import functions as F

from geohour.functions.projection import reproject
from geohour.functions.values import clean_address, distance_class, distance_label, safe_cast


def test_distance_bins(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (100.0001,), (500.0,), (501.0,), (None,)], "d double")
    got = [tuple(r) for r in df.select(distance_class("d"), distance_label("d")).collect()]
    assert got == [(0, "0-100m"), (0, "0-100m"), (1, "100-500m"), (1, "100-500m"), (2, "500m+"),
                   (None, None)]


def test_clean_address(spark):
    cases = {
        "서울 강남구 &lt;b&gt;역삼동&lt;/b&gt; 1-2 (지하)": "서울 강남구 역삼동 1-2",
        "강남대로 10 사거리 북측": "강남대로 10",
        "종로 1, 2층": "종로 1",
        "  종로   1\n\t3 ": "종로 1 3",
        "세곡동 12 도로에 위치 맨홀": "세곡동 12",
        "None": "", " none ": "", "": "", None: "",
        "A&amp;B": "A&B",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(clean_address("t")).collect()] == list(cases.values())


def test_safe_cast(spark):
    df = spark.createDataFrame([("1.5",), ("bad",), ("NaN",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(safe_cast("t", "float")).collect()] == [1.5, None, None, None, None]


def test_projection_check_values(spark):
    df = spark.createDataFrame([(127.0, 37.5)], "lon double, lat double")
    df = reproject(df, "lon", "lat", 4326, 5179, ("kx", "ky"))
    df = reproject(df, "lon", "lat", 4326, 5186, ("mx", "my"))
    r = df.first()
    assert (r.kx, r.ky) == (pytest.approx(955804.816, abs=0.01), pytest.approx(1944643.716, abs=0.01))
    assert (r.mx, r.my) == (pytest.approx(200000.0, abs=0.01), pytest.approx(544504.123, abs=0.01))


@pytest.mark.parametrize("epsg", [5179, 5186, 3857])
def test_projection_round_trip(spark, epsg):
    df = spark.range(0, 200).select(
        (126 + F.col("id") % 20 / 10).alias("lon"), (36 + F.floor(F.col("id") / 20) / 4).alias("lat"))
    there = reproject(df, "lon", "lat", 4326, epsg, ("x", "y"))
    back = reproject(there, "x", "y", epsg, 4326, ("lon2", "lat2"))
    worst = back.agg(F.max(F.abs(F.col("lon") - F.col("lon2"))), F.max(F.abs(F.col("lat") - F.col("lat2"))))
    assert max(worst.first()) < 1e-8


def test_projection_default_and_unknown(spark):
    df = spark.createDataFrame([(200000.0, 544504.123)], "x double, y double")
    r = reproject(df, "x", "y", None, 4326, ("lon", "lat")).first()
    assert (r.lon, r.lat) == (pytest.approx(127.0, abs=1e-7), pytest.approx(37.5, abs=1e-7))
    with pytest.raises(ValueError):
        reproject(df, "x", "y", 1234, 4326, ("lon", "lat"))
