"""Files and stored tables: text layouts, GeoJSON, versions, batch logs, compaction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geohour.functions.temporal import floor_hour
from geohour.operators.cells import Bounds
from geohour.operators.shapes import ring_segments
from geohour.session import run_dir
from geohour.sources import delimited, placed, storage
from geohour.plans.dataset import write_dataset
from geohour.sources.features import read_feature_lines, read_geojson, read_years, square_feature
from geohour.sources.features import write_geojson as store_geojson
from workload import stage
from workload.registry import query, table


def _korean_csv(df, path, header=True, encoding="cp949"):
    df.write.option("header", header).option("encoding", encoding).csv(path)


@query("scan_csv", """
    SELECT date_trunc('second', ts) AS time, CAST(user_id AS SMALLINT) AS station,
           CAST(value AS FLOAT) AS rain_1h FROM events""")
def scan_csv(spark, d):
    root = run_dir(spark, "gauge")
    raw = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("지점"), F.col("event_type").alias("지점명"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("일시"),
        F.col("value").cast("string").alias("강수량(mm)"),
    )
    _korean_csv(raw, f"{root}/a/b")
    return delimited.read_gauge_csv(spark, root)


@query("scan_csv_charset", """
    SELECT CAST(c_custkey AS VARCHAR) AS "고유번호", c_mktsegment || ' 하수관' AS "구분명" FROM customer
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name || ' 수위' FROM supplier""")
def scan_csv_charset(spark, d):
    root = run_dir(spark, "charset")
    for encoding, rows in (
        ("utf-8", table(spark, d, "customer").select(
            F.col("c_custkey").alias("고유번호"),
            F.concat("c_mktsegment", F.lit(" 하수관")).alias("구분명"))),
        ("cp949", table(spark, d, "supplier").select(
            F.col("s_suppkey").alias("고유번호"),
            F.concat("s_name", F.lit(" 수위")).alias("구분명"))),
    ):
        _korean_csv(rows, f"{root}/{encoding}", encoding=encoding)
    return delimited.read_csv_any_charset(spark, root).drop("source_file")


@query("scan_csv_badlines", """
    SELECT CAST(event_id AS VARCHAR) AS a, CASE WHEN event_type <> 'click' THEN event_type END AS b,
           CASE WHEN event_type <> 'click' THEN CAST(user_id AS VARCHAR) END AS c
    FROM events WHERE event_type <> 'error'""")
def scan_csv_badlines(spark, d):
    # Clicks give lines that are too short, errors lines that are too long.
    root = run_dir(spark, "badlines")
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    line = (
        F.when(F.col("event_type") == "click", event)
        .when(F.col("event_type") == "error",
              F.concat_ws(",", event, F.lit("x"), F.lit("y"), F.lit("z")))
        .otherwise(F.concat_ws(",", event, "event_type", user))
    )
    table(spark, d, "events").select(line.alias("value")).write.text(f"{root}/rows")
    return delimited.read_layout(spark, f"{root}/rows", ["a", "b", "c"], "part-*").drop("source_file")


def _rename(spark, folder, old, new):
    """Give the files of a folder another ending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        if name.endswith(old):
            fs.rename(entry.getPath(), entry.getPath().suffix(new) if new.startswith(old) else path.suffix(
                "/" + name.removesuffix(old) + new))


@query("scan_failing_files", """
    SELECT c_nationkey AS nation, CASE c_nationkey WHEN 0 THEN 'no line' WHEN 1 THEN 'no text'
             WHEN 2 THEN 'no column name' WHEN 3 THEN 'corrupt' END AS reason,
           count(*) FILTER (c_nationkey > 3) AS n, CAST(sum(c_custkey) FILTER (c_nationkey > 3) AS BIGINT) AS keys
    FROM customer GROUP BY ALL""")
def scan_failing_files(spark, d):
    # A member per nation, four of them damaged: blank, with bytes of no text, short of a column, not compressed.
    root = run_dir(spark, "members")
    rows = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"))

    def of(nation):
        return rows.where(F.col("nation") == nation).coalesce(1)

    for nation, text in ((0, F.lit("")), (1, F.concat("key", F.lit(",\0"), "name"))):
        of(nation).select(text.alias("value")).write.text(f"{root}/nation={nation}")
        _rename(spark, f"{root}/nation={nation}", ".txt", ".csv")
    _korean_csv(of(2).select("key", "nation"), f"{root}/nation=2")
    _korean_csv(of(3).select("key", "name"), f"{root}/nation=3")
    _rename(spark, f"{root}/nation=3", ".csv", ".csv.gz")
    good = rows.where("nation > 3").repartition("nation").write.partitionBy("nation").mode("append")
    good.option("header", True).option("compression", "gzip").csv(root)
    read = delimited.read_csv_any_charset(spark, root, ("key", "name")).withColumnRenamed("source_file", "file").groupBy("file").agg(
        F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("keys"))
    files = read.join(delimited.quarantined_files(spark, root, ("key", "name")), "file", "full")
    return files.groupBy(
        F.regexp_extract("file", r"nation=(\d+)", 1).cast("int").alias("nation"),
        F.regexp_extract("reason", "^[^:]*", 0).alias("reason"),
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("keys").alias("keys"))


@query("scan_legacy_layout", """
    SELECT CAST(user_id AS VARCHAR) AS unq_no, CASE WHEN event_type <> 'click' THEN event_type END AS se_cd,
           CASE WHEN event_type <> 'click' THEN '강남' END AS se_nm,
           CASE WHEN event_type = 'signup' THEN NULL ELSE date_trunc('second', ts) END AS msrmt_ymd,
           CAST(value AS FLOAT) AS msrmt_watl,
           CASE WHEN event_type = 'click' THEN NULL ELSE 'ok' END AS sgn_stts,
           CASE WHEN event_type NOT IN ('view', 'signup') THEN '서울' END AS pstn_info FROM events""")
def scan_legacy_layout(spark, d):
    root = run_dir(spark, "legacy")
    events = table(spark, d, "events")
    user, value = F.concat(F.col("user_id").cast("string"), F.lit(" ")), F.col("value").cast("string")
    old = events.where(F.col("event_type").isin("view", "signup")).select(
        user.alias("a"), F.col("event_type").alias("b"), F.lit("강남").alias("c"),
        F.lit("x").alias("d"),
        F.when(F.col("event_type") == "signup", F.lit("bad")).otherwise(
            F.upper(F.date_format("ts", "dd-MMM-yy HH:mm:ss"))).alias("e"),
        value.alias("f"), F.lit("ok").alias("g"),
    )
    _korean_csv(old, f"{root}/2018/a", header=False)
    clicks = events.where(F.col("event_type") == "click").select(
        user.alias("UNQ_NO"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("MSRMT_YMD"),
        value.alias("MSRMT_WATL"), F.lit("서울").alias("PSTN_INFO"),
    )
    _korean_csv(clicks, f"{root}/2019/b")
    rest = events.where(F.col("event_type").isin("purchase", "error")).select(
        user.alias("고유번호"), F.col("event_type").alias("구분코드"), F.lit("강남").alias("구분명"),
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("측정일자"), value.alias("측정수위"),
        F.lit("ok").alias("통신상태"), F.lit("서울").alias("위치정보"),
    )
    _korean_csv(rest, f"{root}/2020/c", encoding="utf-8")
    return delimited.read_level_files(spark, root).drop("source_file")


@query("write_read_roundtrip", """
    SELECT o_orderkey, o_orderdate, o_totalprice, 'parquet' AS format FROM orders
    UNION ALL SELECT o_orderkey, o_orderdate, o_totalprice, 'csv' FROM orders""")
def write_read_roundtrip(spark, d):
    root = run_dir(spark, "roundtrip")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    earlier = rows.withColumn("o_totalprice", -F.col("o_totalprice"))
    storage.write_version(earlier, f"{root}/table")  # an earlier output, to be replaced
    storage.write_version(rows, f"{root}/table")
    storage.write_csv(rows, f"{root}/csv")
    stored = storage.read_latest(spark, f"{root}/table")
    text = spark.read.schema(rows.schema).option("header", True).csv(f"{root}/csv")
    return stored.withColumn("format", F.lit("parquet")).unionByName(
        text.withColumn("format", F.lit("csv"))
    )


@query("write_geojson", f"""
    WITH {stage.CITY_SQL}
    SELECT grid_id, 'Polygon' AS geom_type, x0 AS x1, y0 AS y1, x0 + 100 AS x3, y0 + 100 AS y3
    FROM grid""")
def write_geojson(spark, d):
    root = run_dir(spark, "geojson")
    grid, _ = stage.city(spark, d)
    store_geojson(grid, square_feature(F.col("x0"), F.col("y0"), stage.STEP), ["grid_id"], root)
    back = read_feature_lines(spark, root, "grid_id int")
    first, third = F.col("parts")[0][0][0], F.col("parts")[0][0][2]
    return back.select("grid_id", "geom_type", first["x"].alias("x1"), first["y"].alias("y1"),
                       third["x"].alias("x3"), third["y"].alias("y3"))


@query("scan_geojson", f"""
    WITH {stage.SHAPES_SQL}
    SELECT feature_id, s_nationkey, '}}{{"Feature"[' || feature_id AS note,
           CASE WHEN s_nationkey < 13 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type,
           CAST(8 AS BIGINT) AS n_segments FROM poly""")
def scan_geojson(spark, d):
    root = run_dir(spark, "features")
    coords = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.array(p["x"], p["y"]))))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), coords[0].alias("coordinates")))
    properties = F.to_json(F.struct(
        "feature_id", "s_nationkey", F.concat(F.lit('}{"Feature"['), F.col("feature_id").cast("string")).alias("note")))
    geometry = F.when(F.col("s_nationkey") < 13, multi).otherwise(single)
    # Members in any order, on one line or several.
    members = F.array(F.lit('"type": "Feature"'), F.concat(F.lit('"properties":'), properties),
                      F.concat(F.lit('"geometry" : '), geometry))
    turn = (F.col("feature_id") % 3).cast("int")
    turned = F.concat(F.slice(members, turn + 1, 3 - turn), F.slice(members, 1, turn))
    between = F.when(F.col("feature_id") % 2 == 0, F.lit(", ")).otherwise(F.lit(",\n  "))
    text = F.concat(F.lit("{"), F.array_join(turned, "\n@"), F.lit("}"))
    text = F.replace(text, F.lit("\n@"), between)
    # Many tasks write, each some collections, whose own members stand on both sides.
    document = (F.col("feature_id") / 50).cast("long").alias("document")
    rows = stage.district_polygons(spark, d).select(document, F.col("feature_id").alias("seq"), text.alias("value"))
    first = Window.partitionBy("document").orderBy("seq")
    features = rows.withColumn("value", F.when(F.row_number().over(first) > 1, F.concat(F.lit(","), "value")).otherwise(F.col("value")))
    each = rows.select("document").distinct()
    opening = F.lit('{"links": [{"type": "Feature"}], "crs": {"type": "name", "properties": {}}, "features": [')
    closing = F.lit('], "bbox": null, "type": "FeatureCollection"}')
    whole = features.unionByName(each.select("document", F.lit(-1).cast("long").alias("seq"), opening.alias("value"))).unionByName(
        each.select("document", F.lit((1 << 63) - 1).alias("seq"), closing.alias("value")))
    whole.repartition("document").sortWithinPartitions("document", "seq").select("value").write.text(root)
    back = read_geojson(spark, root, "feature_id bigint, s_nationkey int, note string")
    return ring_segments(back, "feature_id", "parts", ["s_nationkey", "geom_type", "note"]).groupBy(
        "feature_id", "s_nationkey", "geom_type", "note"
    ).agg(F.count(F.lit(1)).alias("n_segments"))


@query("box_slice", """
    SELECT c_custkey, c_nationkey, c_acctbal FROM customer
    WHERE c_nationkey BETWEEN 5 AND 15 AND c_acctbal BETWEEN 1000 AND 4000""")
def box_slice(spark, d):
    root = run_dir(spark, "placed")
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    placed.write_by_place(rows, root, "c_nationkey", "c_acctbal")
    return placed.read_box(spark, root, Bounds(5, 1000.0, 15, 4000.0), "c_nationkey", "c_acctbal")


@query("compact_chunks", """
    SELECT l_orderkey AS grid_id, l_shipdate AS time, l_linenumber, l_quantity FROM lineitem""")
def compact_chunks(spark, d):
    root = run_dir(spark, "chunks")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("grid_id"), F.col("l_shipdate").alias("time"), "l_linenumber",
        "l_quantity",
    )
    # Several chunk folders, one per line number.
    rows.withColumn("chunk", F.col("l_linenumber")).write.partitionBy("chunk").parquet(f"{root}/in")
    storage.compact_chunks(spark, f"{root}/in", f"{root}/out", ["grid_id", "time"])
    return spark.read.parquet(f"{root}/out")


def typed_hours(spark, d, first: bool):
    kinds = ("view", "click") if first else ("purchase", "error", "signup")
    rows = table(spark, d, "events").where(F.col("event_type").isin(*kinds))
    return rows.groupBy(floor_hour("ts").alias("time"), F.col("user_id").alias("grid_id")).agg(
        F.max("value").alias("water_level")
    )


def batch_log(spark, d, name):
    root = run_dir(spark, name)
    storage.append_batch(typed_hours(spark, d, True), root, 1)
    storage.append_batch(typed_hours(spark, d, False), root, 2)
    storage.append_batch(typed_hours(spark, d, True), root, 1)  # a replay changes nothing
    return storage.read_log(spark, root)


@query("upsert_max", """
    SELECT date_trunc('hour', ts) AS time, user_id AS grid_id, max(value) AS water_level
    FROM events GROUP BY ALL""")
def upsert_max(spark, d):
    return storage.resolve_max(batch_log(spark, d, "upsert-max"), ["time", "grid_id"], "water_level")


@query("upsert_last", """
    WITH b AS (SELECT date_trunc('hour', ts) AS time, user_id AS grid_id, max(value) AS water_level,
                      CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 2 END AS batch_id
               FROM events GROUP BY ALL)
    SELECT time, grid_id, arg_max(water_level, batch_id) AS water_level FROM b GROUP BY ALL""")
def upsert_last(spark, d):
    return storage.resolve_last(batch_log(spark, d, "upsert-last"), ["time", "grid_id"])


@query("read_years", "SELECT o_orderkey, o_orderdate FROM orders")
def years(spark, d):
    root = run_dir(spark, "years")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    orders.withColumn("year", F.year("o_orderdate")).write.partitionBy("year").parquet(root)
    # The range names more years than there are folders.
    return read_years(spark, f"{root}/year={{year}}", range(1985, 2031), spark.read.parquet)


@query("stored_dataset", """
    SELECT date_trunc('hour', ts) AS time, user_id AS grid_id, max(value) AS water_level,
           strftime(date_trunc('hour', ts), '%Y-%m') AS month
    FROM events GROUP BY ALL""")
def stored_dataset(spark, d):
    root = run_dir(spark, "dataset")
    hours = table(spark, d, "events").groupBy(floor_hour("ts").alias("time"), F.col("user_id").alias("grid_id")).agg(
        F.max("value").alias("water_level"))
    write_dataset(hours, root)
    return spark.read.schema(hours.schema.add("month", "string")).parquet(root)
