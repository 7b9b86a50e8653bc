import gzip
import json
import os
import random
from datetime import datetime as dt
from unittest import mock

import pytest
from pyspark.sql import functions as F

from conftest import rows
from geohour.operators.cells import Bounds
from geohour.operators.shapes import explode_vertices
from geohour.operators.tables import drop_all_null_columns, validate
from geohour.plans.flood import flood_clean
from geohour.plans.water import registry_refresh, sensor_cells
from geohour.sources import placed, storage
from geohour.sources.delimited import (
    quarantined_files, read_csv_any_charset, read_gauge_csv, read_level_files, read_station_csv, standardize_columns,
)
from geohour.sources.features import (
    read_geojson, read_years, rejected_features, square_feature, union_files, write_geojson,
)
from geohour.sources.payload import readings_from_payload
from geohour.sources.rest import last_hour, level_source


def put(root, path, text, encoding="utf-8"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode(encoding))


def test_level_files(spark, tmp_path):
    root = str(tmp_path / "하수 관")  # a path that needs escaping
    put(root, "2012/a/a.csv", "1,02,강남,x,01-MAY-12 00:00:00,1.5,ok\n"
        "2,02,강남,x,01-MAY-12 01:10:00,-1,ok,EXTRA\n3,02,x\n", "cp949")
    put(root, "2018/empty.csv", "")
    put(root, "2019/b.csv", "﻿고유번호,구분코드,구분명,측정일자,측정수위,통신상태,위치정보\n"
        ' 7 ,01,종로,2019-05-01 10:20,0.5,ok,"서울, 종로"\n8,01,종로,bad,zz,ok,x\n')
    put(root, "2020/c.csv", "UNQ_NO,MSRMT_YMD,MSRMT_WATL\n9,20200801,2\n", "cp949")
    out = read_level_files(spark, root)
    assert out.columns == ["unq_no", "se_cd", "se_nm", "msrmt_ymd", "msrmt_watl", "sgn_stts",
                           "pstn_info", "source_file"]
    got = {r.unq_no: r for r in out.collect()}
    assert set(got) == {"1", "3", "7", "8", "9"}  # the long line is gone, the short one is padded
    assert (got["1"].se_cd, got["1"].se_nm, got["1"].msrmt_ymd) == ("02", "강남", dt(2012, 5, 1))
    assert (got["3"].msrmt_ymd, got["3"].msrmt_watl, got["3"].pstn_info) == (None, None, None)
    assert (got["7"].pstn_info, got["7"].msrmt_watl) == ("서울, 종로", 0.5)
    assert (got["8"].msrmt_ymd, got["8"].msrmt_watl) == (None, None)
    assert (got["9"].msrmt_ymd, got["9"].se_nm) == (dt(2020, 8, 1), None)
    assert got["1"].source_file.endswith("/2012/a/a.csv")


def test_gauge_and_station_files(spark, tmp_path):
    put(str(tmp_path), "g/x/1.csv", "지점,지점명,일시,강수량(mm)\n108,서울,2011-05-01 01:00,0.5\n"
        "108,서울,2011-05-01 02:00,\n", "cp949")
    put(str(tmp_path), "g/2.csv", "지점,지점명,일시,강수량(mm)\n109,서울,2011-05-01 03:00,1\n")
    assert rows(read_gauge_csv(spark, str(tmp_path / "g"))) == [
        (dt(2011, 5, 1, 1), 108, 0.5), (dt(2011, 5, 1, 2), 108, None), (dt(2011, 5, 1, 3), 109, 1.0)]
    put(str(tmp_path), "s/m.csv", "지점,시작일,종료일,위도,경도\n108,2010-01-01,,37.5,127.0\n", "cp949")
    assert rows(read_station_csv(spark, str(tmp_path / "s"))) == [
        (108, dt(2010, 1, 1), None, 37.5, 127.0)]


def test_failing_members_are_named_and_the_others_read(spark, tmp_path):
    root = str(tmp_path / "m")
    body = "a,b\n" + "".join(f"{i},x{i}\n" for i in range(20_000))
    packed = gzip.compress(body.encode())
    for name, data in {
        "1/fine.csv": body, "2/fine.csv.gz": packed, "2/twice.csv.gz": packed + packed, "3/cut.csv.gz": packed[:len(packed) // 2],
        "3/flipped.csv.gz": packed[:900] + bytes(64) + packed[964:], "4/plain.csv.gz": body, "5/empty.csv": "",  # Spark lists no empty file
        "5/blank.csv": "\n \n", "6/binary.csv": b"a,b\n\0\x01,2\n", "7/other.csv": "a,c\n1,2\n", "8/note.txt": "a,b\n1,2\n",
    }.items():
        put(root, name, data)
    out = read_csv_any_charset(spark, root, ["a", "B"])
    n = {os.path.basename(r.source_file): r["count"] for r in out.groupBy("source_file").count().collect()}
    assert n == {"fine.csv": 20_000, "fine.csv.gz": 20_000, "twice.csv.gz": 40_001}
    bad = {os.path.basename(r.file): r.reason for r in quarantined_files(spark, root, ["a", "B"]).collect()}
    assert bad.pop("cut.csv.gz") == "truncated" and bad.pop("flipped.csv.gz").startswith("corrupt: ")
    assert bad.pop("plain.csv.gz").startswith("corrupt: ")
    assert bad == {"blank.csv": "no line", "binary.csv": "no text", "other.csv": "no column b"}


def test_layouts_come_back_and_files_do_not(spark, tmp_path):
    for i in range(120):
        put(str(tmp_path), f"f/{i}.csv", f"a,{'B' if i % 2 else 'b'}\n{i},{i}\n" if i % 3 else f"b,c\n{i},{i}\n")
    with mock.patch.object(type(spark), "createDataFrame", autospec=True, side_effect=type(spark).createDataFrame) as made:
        out = read_csv_any_charset(spark, str(tmp_path / "f"))
    assert [len(c.args[1]) for c in made.call_args_list] == [3]  # one row per layout is all that the driver saw
    assert out.columns == ["a", "B", "c", "source_file"]
    assert out.where("a IS NULL").count() == 40 and out.where("B = a").count() == 80


def test_no_files(spark, tmp_path):
    put(str(tmp_path), "a.csv", "")
    with pytest.raises(ValueError):
        read_csv_any_charset(spark, str(tmp_path))


def test_standardize_prefers_first_spelling_with_a_value(spark):
    df = spark.createDataFrame([("1", "x")], "`?고유번호` string, se_nm string")
    r = standardize_columns(df).first()
    assert (r.unq_no, r.se_nm, r.se_cd, r.source_file) == ("1", "x", None, None)


def test_headers_with_quotes_and_repeats(spark, tmp_path):
    put(str(tmp_path), "q/a.csv", '"a","b,c",a,A\n1,2,3,4\n')
    out = read_csv_any_charset(spark, str(tmp_path / "q")).drop("source_file")
    assert out.columns == ["a", "b,c", "a.1", "A.2"]
    assert rows(out) == [("1", "2", "3", "4")]


def test_geojson_collection_and_lines(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"CONT": "10", "n": 1},
         "geometry": {"type": "LineString", "coordinates": [[0, 0], [1.5, 2]]}},
        {"type": "Feature", "properties": {"CONT": None},
         "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 2]], [[5, 5], [6, 6]]]}},
        {"type": "Feature", "properties": {"CONT": "x"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 2], [3, 3], [0, 0]]]}},
        {"type": "Feature", "properties": {}, "geometry": None},
    ]
    put(str(tmp_path), "a/c.geojson", json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    put(str(tmp_path), "a/l.geojson", "\n".join(json.dumps(f) for f in features[:2]))
    out = read_geojson(spark, str(tmp_path / "a"), "CONT string, n int")
    kinds = sorted(str(r.geom_type) for r in out.collect())
    assert kinds == ["LineString"] * 2 + ["MultiLineString"] * 2 + ["None", "Polygon"]
    vertices = explode_vertices(out.where("n = 1"), "lines", ["CONT"])
    assert rows(vertices.distinct()) == [("10", 0, 0, 0.0, 0.0), ("10", 0, 1, 1.5, 2.0)]


def test_geojson_reports_what_it_cannot_read(spark, tmp_path):
    lines = ['{"type":"Feature","properties":{"n":1},"geometry":null}', '{"type":"Feature","properties":{"n":2,',
             '{"type": "Feature", "properties": {"n": 3}, "geometry": null}']
    put(str(tmp_path), "b/l.geojson", "\n".join(lines))
    path = str(tmp_path / "b")
    with pytest.raises(Exception, match="no feature in"):
        read_geojson(spark, path, "n int").collect()
    assert sorted(r.n for r in read_geojson(spark, path, "n int", skip_broken=True).collect()) == [1, 3]
    assert [r.text for r in rejected_features(spark, path).collect()] == ['{"type":"Feature","properties":{"n":2,']
    put(str(tmp_path), "e/empty.geojson", '{"type": "FeatureCollection", "features": []}')
    assert read_geojson(spark, str(tmp_path / "e"), "n int").count() == 0


def _feature(i, rng):
    tricky = ["x", 'a "b', "\\", '"Feature"', "}{][", "\n{", '"features":[{', "é" * 40]
    made = {"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [i, 1]}, "properties": {
        "n": i, "s": rng.choice(tricky), "type": "Feature", "deep": {"list": [{"a": [[]]}, {"b": {}}]}}}
    return {k: made[k] for k in rng.sample(list(made), len(made))}


def _collection(ids, rng):
    made = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}},
            "links": [{"type": "Feature", "href": "}"}, {"features": [{"no": 1}]}], "bbox": [1, 2],
            "features": [_feature(i, rng) for i in ids]}
    return {k: made[k] for k in rng.sample(list(made), len(made))}


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_geojson_boundaries_follow_the_structure(spark, tmp_path, split):
    rng = random.Random(split)
    texts = [
        json.dumps(_collection(range(0, 10), rng)), json.dumps(_collection(range(10, 20), rng), indent=2),
        json.dumps(_collection(range(20, 25), rng), indent=0, ensure_ascii=False),
        "\n".join(json.dumps(_feature(i, rng)) for i in range(25, 35)) + "\n",
        json.dumps(_feature(35, rng), indent=1), json.dumps(_collection([], rng)),
        "\ufeff" + json.dumps(_collection([36], rng)) + "\n\x1e" + json.dumps(_feature(37, rng)),
    ]
    for i, text in enumerate(texts):
        put(str(tmp_path), f"j/{i}.geojson", text)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        out = read_geojson(spark, str(tmp_path / "j"), "n int, s string, type string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.n for r in out) == list(range(38))
    assert all(r.geom_type == "Point" and r.type == "Feature" and r.lines[0][0].x == r.n for r in out)


def test_geojson_broken_parts_are_reported_and_hide_nothing(spark, tmp_path):
    good = '{"type":"Feature","properties":{"n":%d},"geometry":null}'
    lines = [good % 1, '{"type":"Feature","properties":{"s":"cut off', good % 2, "no json", '{"type":"Feature"}}', good % 3,
             '{"type":"Point","coordinates":[1,2]}', good % 4]
    put(str(tmp_path), "b/l.geojson", "\n".join(lines))
    whole = '{"type":"FeatureCollection","features":[' + ",".join([good % 5, '{"n":6}', good % 7])
    put(str(tmp_path), "b/cut.geojson", whole)  # lacks its end
    path = str(tmp_path / "b")
    assert sorted(r.n for r in read_geojson(spark, path, "n int", skip_broken=True).where("n IS NOT NULL").collect()) == [
        1, 2, 3, 4, 5, 7]
    said = "".join(r.text for r in rejected_features(spark, path).collect())
    for part in ("cut off", "no json", '"Point"', '{"n":6}', "FeatureCollection"):
        assert part in said
    with pytest.raises(Exception, match="no feature in"):
        read_geojson(spark, path, "n int").collect()


def test_geojson_collection_larger_than_one_value(spark, tmp_path):
    n, pad = 180_000, "x" * 900
    with open(tmp_path / "big.geojson", "w") as f:
        f.write('{"type": "FeatureCollection", "name": "big", "features": [\n')
        for i in range(n):
            f.write(f'{{ "type": "Feature", "properties": {{ "n": {i}, "pad": "{pad}" }}, "geometry": '
                    f'{{ "type": "Point", "coordinates": [ {i}, 1 ] }} }}{"," if i < n - 1 else ""}\n')
        f.write("]\n}\n")
    assert os.path.getsize(tmp_path / "big.geojson") > 150_000_000
    out = read_geojson(spark, str(tmp_path / "big.geojson"), "n int")
    assert out.rdd.getNumPartitions() > 1
    assert out.agg(F.count("n"), F.sum("n"), F.count("lines")).first()[:] == (n, n * (n - 1) // 2, n)


def test_write_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 100.0)], "grid_id int, x0 double, y0 double")
    path = str(tmp_path / "g")
    write_geojson(df, square_feature(F.col("x0"), F.col("y0"), 100.0), ["grid_id"], path)
    feature = json.loads(spark.read.text(path).first()[0])
    assert feature["properties"] == {"grid_id": 1}
    assert feature["geometry"]["coordinates"] == [
        [[0.0, 100.0], [100.0, 100.0], [100.0, 200.0], [0.0, 200.0], [0.0, 100.0]]]


def test_years_and_union(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/2011")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{tmp_path}/2013")
    out = read_years(spark, f"{tmp_path}/{{year}}", range(2010, 2016), spark.read.parquet)
    assert rows(out) == [(1, None), (2, "x")]
    with pytest.raises(ValueError):
        union_files([])


def test_versions_ignore_an_unfinished_write(spark, tmp_path):
    root = str(tmp_path / "t")
    storage.write_version(spark.createDataFrame([(1, 2)], "a int, b int"), root)
    os.makedirs(f"{root}/v=00000002")  # a job that died before its success marker
    assert rows(storage.read_latest(spark, root)) == [(1, 2)]
    storage.drop_stored_column(spark, root, "b")
    assert storage.read_latest(spark, root).columns == ["a"]
    with pytest.raises(ValueError):
        storage.read_latest(spark, str(tmp_path / "none"))


def test_upserts(spark, tmp_path):
    root = str(tmp_path / "log")
    one = spark.createDataFrame([(1, 5.0), (2, 1.0)], "grid_id int, water_level double")
    two = spark.createDataFrame([(1, 2.0)], "grid_id int, water_level double")
    storage.append_batch(one, root, 1)
    storage.append_batch(two, root, 2)
    for _ in range(2):
        log = storage.read_log(spark, root)
        assert rows(storage.resolve_max(log, ["grid_id"], "water_level")) == [(1, 5.0), (2, 1.0)]
        assert rows(storage.resolve_last(log, ["grid_id"])) == [(1, 2.0), (2, 1.0)]
        storage.append_batch(two, root, 2)  # a replay changes nothing
    storage.compact_log(spark, root, ["grid_id"])
    assert os.listdir(root) == ["batch_id=2"]
    assert rows(storage.resolve_last(storage.read_log(spark, root), ["grid_id"])) == [(1, 2.0), (2, 1.0)]
    storage.append_batch(spark.createDataFrame([(2, 7.0)], "grid_id int, water_level double"), root, 3)
    storage.compact_log(spark, root, ["grid_id"])
    assert rows(storage.resolve_last(storage.read_log(spark, root), ["grid_id"])) == [(1, 2.0), (2, 7.0)]


def test_a_box_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "by place+x")
    rnd = random.Random(4)
    points = [(i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(20_000)]
    points += [(20_000 + i, 500.0 + rnd.random(), 500.0) for i in range(5000)] + [(-1, None, 3.0), (-2, 3.0, None)]
    df = spark.createDataFrame(points, "id int, x double, y double").repartition(6)
    placed.write_by_place(df, path, files=64)
    assert spark.read.parquet(path).count() == len(points)
    every = len(spark.read.parquet(path).inputFiles())
    for box in (Bounds(100, 100, 200, 180), Bounds(499, 499, 501, 501), Bounds(0, 990, 1000, 1000)):
        out = placed.read_box(spark, path, box)
        want = {i for i, x, y in points if x is not None and y is not None and box.min_x <= x <= box.max_x and box.min_y <= y <= box.max_y}
        assert {r.id for r in out.collect()} == want
        assert len(out.inputFiles()) < every / 2
    assert len(placed.read_box(spark, path, Bounds(100, 100, 200, 180)).inputFiles()) <= every / 8
    assert placed.read_box(spark, path, Bounds(-9, -9, -8, -8)).collect() == []
    placed.write_by_place(df.limit(0), str(tmp_path / "none"))
    assert placed.read_box(spark, str(tmp_path / "none"), Bounds(0, 0, 1, 1)).collect() == []


def test_compaction_sorts(spark, tmp_path):
    for i in (3, 1, 2):
        spark.range(i * 10, i * 10 + 10).write.parquet(f"{tmp_path}/in/chunk_{i}.parquet")
    storage.compact_chunks(spark, f"{tmp_path}/in", f"{tmp_path}/out", ["id"])
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.id for r in out.collect()) == list(range(10, 40))


def test_payload(spark):
    body = {"DrainpipeMonitoringInfo": {"row": [{"UNQ_NO": "1", "MSRMT_WATL": "0.5"}]}}
    df = spark.createDataFrame([(json.dumps(body),), ('{"RESULT": {}}',), ("no json",)], "t string")
    assert rows(readings_from_payload(df, "t")) == [("1", "0.5", None, None)]


def _service(calls, broken):
    def count(district):
        if calls[district] is None:
            raise OSError("down")
        return calls[district]

    def fetch(district, first, last, start, end):
        if (district, first) == broken:
            raise OSError("down")
        return {"DrainpipeMonitoringInfo": {"row": [
            {"UNQ_NO": f"{district}-{i}", "MSRMT_YMD": start} for i in range(first, last + 1)]}}

    return fetch, count


def test_rest_source_pages_and_leaves_out_a_district_that_is_down(spark):
    fetch, count = _service({"01": 3, "02": 6, "03": None}, None)
    spark.dataSource.register(level_source(
        "levels_test", fetch, count, lambda tick: ("2024010100", "2024010101"),
        ("01", "02", "03"), page_rows=4, wait=0))
    out = spark.read.format("levels_test").load().collect()
    assert sorted(r.sensor_id for r in out) == [
        "01-1", "01-2", "01-3", "02-1", "02-2", "02-3", "02-4", "02-5", "02-6"]
    assert {r.time for r in out} == {"2024010100"}


def test_rest_source_stores_no_half_district(spark):
    fetch, count = _service({"01": 3, "02": 6}, ("02", 5))
    spark.dataSource.register(level_source("levels_half", fetch, count, districts=("01", "02"), page_rows=4, wait=0))
    with pytest.raises(Exception, match="district 02, rows 5 to 6 failed 3 times"):
        spark.read.format("levels_half").load().collect()
    start, end = last_hour(0)
    assert len(start) == len(end) == 10 and start < end


def test_a_district_that_failed_is_asked_for_its_missed_hours(spark, tmp_path):
    calls, log = {"01": 2, "02": 3, "03": 4}, []

    def fetch(district, first, last, start, end):
        return {"DrainpipeMonitoringInfo": {"row": [{"UNQ_NO": district, "MSRMT_YMD": f"{start}-{end}"}]}}

    def count(district):
        if district == "02" and len(log) in (1, 2):
            raise OSError("down")
        return calls[district]

    source = level_source("levels_owed", fetch, count, lambda tick: (f"h{tick}", f"h{tick + 1}"), ("01", "02", "03"),
                          page_rows=10, wait=0)
    reader = source({}).streamReader(None)
    offsets, read = [reader.initialOffset()], []
    for _ in range(5):
        end = json.loads(json.dumps(reader.latestOffset()))
        read.append({p.district: (p.start, p.end) for p in reader.partitions(offsets[-1], end)})
        offsets.append(end)
        log.append(end)
    assert read[0] == {"01": ("h0", "h1"), "02": ("h0", "h1"), "03": ("h0", "h1")}
    assert "02" not in read[1] and "02" not in read[2]
    assert read[3] == {"01": ("h3", "h4"), "02": ("h1", "h4"), "03": ("h3", "h4")}
    assert read[4]["02"] == ("h4", "h5")
    # A restarted reader goes on from the offset in the checkpoint, owed hours included.
    later = source({}).streamReader(None)
    later.partitions(offsets[1], offsets[3])
    log.append(None)
    assert later.latestOffset()["read"]["02"] == [3, "h1"]
    # A poll that no batch took is read by the next one.
    later.latestOffset()
    assert later.latestOffset()["read"]["01"] == [2, "h3"]


def test_polls_are_limited_and_starve_no_district(spark):
    source = level_source("levels_limit", lambda *a: {}, lambda d: 6, lambda tick: (f"h{tick}", f"h{tick + 1}"),
                          ("01", "02", "03"), page_rows=4, wait=0, max_rows=12)
    reader, seen = source({}).streamReader(None), []
    last = reader.initialOffset()
    for _ in range(4):
        end = reader.latestOffset()
        pages = reader.partitions(last, end)
        last = end
        assert sum(p.last - p.first + 1 for p in pages) <= 12
        seen.append({p.district: p.start for p in pages})
    assert seen == [{"01": "h0", "02": "h0"}, {"03": "h0", "01": "h1"}, {"02": "h1", "01": "h2"}, {"03": "h2", "01": "h3"}]


def test_registry(spark):
    known = spark.createDataFrame([("1", "a", 1.0, 2.0), (" 2", "b, x", None, 2.0)],
                                  "sensor_id string, location string, lat double, lon double")
    found = spark.createDataFrame([("1", "new", 1), ("3", "c (x)", 2), ("3", "later", 3), ("4", None, 4)],
                                  "sensor_id string, location string, seq int")
    out = registry_refresh(known, found, lambda a: (float(len(a)), 9.0) if a != "zz" else (None, None))
    assert rows(out) == [("1", "a", 1.0, 2.0), ("2", "b, x", 1.0, 9.0), ("3", "c (x)", 1.0, 9.0),
                         ("4", None, None, None)]


def test_sensor_cells(spark):
    sensors = spark.createDataFrame([("a", 37.5, 127.0), ("b", 30.0, 120.0)],
                                    "sensor_id string, lat double, lon double")
    grid = spark.createDataFrame([(0, 0, 5)], "ix int, iy int, grid_id int")
    out = sensor_cells(sensors, grid, 955_750.0, 1_944_600.0, 100.0)
    assert rows(out.select("sensor_id", "grid_id")) == [("a", 5), ("b", None)]


def test_flood_clean(spark):
    df = spark.createDataFrame(
        [("z", "20200801", "3", "2020-08-02", "1", None), ("y", "bad", "1", "2020-08-02", "1", None),
         ("x", None, "1", "2020-08-02", "1", None)],
        "F_ZONE_NM string, F_SAT_YMD string, F_SAT_TM string, F_END_YMD string, F_END_TM string, "
        "F_SHIM double")
    out = flood_clean(df)
    assert out.columns == ["ADDRESS", "start_ts", "end_ts"]
    assert rows(out) == [("z", dt(2020, 8, 1, 3), dt(2020, 8, 2, 1))]


def test_validation_and_null_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    assert drop_all_null_columns(df).columns == ["a"]
    with pytest.raises(ValueError):
        validate(df, ["grid_id"])
    with pytest.raises(ValueError):
        validate(df.where("a = 2"), ["a"])
    assert validate(df, ["a"]) is df


def test_collections_written_by_many_tasks_stay_whole(spark, tmp_path):
    from workload import QUERIES

    ids = F.col("id")
    spark.range(3000).select(
        ids.alias("s_suppkey"), (ids % 25).cast("int").alias("s_nationkey"), (ids % 97).cast("double").alias("s_acctbal")
    ).write.parquet(f"{tmp_path}/supplier.parquet")
    small = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert QUERIES["scan_geojson"](spark, str(tmp_path)).count() == 3000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
