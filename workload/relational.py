"""Projection, filter, join, aggregate, sort, set and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geohour.functions.temporal import floor_hour, hour_range_stamps
from geohour.functions.values import (
    clean_address, contains_text, distance_class, distance_label, normalize_id, safe_cast,
)
from geohour.operators import intervals
from geohour.operators import profile as prof
from geohour.operators import tables as ops
from geohour.plans.rain import season
from geohour.session import run_dir
from geohour.sources.delimited import standardize_columns
from geohour.sources.features import union_files
from geohour.sources.storage import drop_stored_column, read_latest, write_version
from geohour.streaming.levels import unmatched
from workload.registry import query, table


@query("scan_parquet", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def scan_parquet(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("project_rename", """
    SELECT o_orderdate AS time, o_custkey AS station, o_totalprice AS rain_1h FROM orders""")
def project_rename(spark, d):
    names = {"o_custkey": "station", "o_orderdate": "time", "o_totalprice": "rain_1h"}
    renamed = table(spark, d, "orders").withColumnsRenamed(names)
    return renamed.select("time", "station", "rain_1h")


@query("drop_all_null_columns", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def drop_all_null_columns(spark, d):
    events = table(spark, d, "events")
    return ops.drop_all_null_columns(events.withColumn("depth", F.lit(None).cast("double")))


@query("dropna_subset", """
    SELECT c_custkey, o_orderkey, o_totalprice
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def dropna_subset(spark, d):
    joined = table(spark, d, "customer").join(
        table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    return joined.select("c_custkey", "o_orderkey", "o_totalprice").dropna(
        subset=["o_orderkey", "o_totalprice"]
    )


@query("filter_season", """
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE month(o_orderdate) BETWEEN 5 AND 10 AND year(o_orderdate) BETWEEN 1996 AND 2000""")
def filter_season(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return season(rows, "o_orderdate", years=(1996, 2000))


@query("filter_numeric", """
    SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem
    WHERE l_tax > 0 AND l_discount >= 0.05 AND l_linenumber = 1""")
def filter_numeric(spark, d):
    rows = table(spark, d, "lineitem").where(
        (F.col("l_tax") > 0) & (F.col("l_discount") >= 0.05) & (F.col("l_linenumber") == 1)
    )
    return rows.select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


@query("filter_string", """
    SELECT doc_id, lang, contains(text, 'tion') AS has_tion, lang = 'en' AS is_english,
           starts_with(CAST(n_chars AS VARCHAR), '11') AS starts_11
    FROM documents
    WHERE coalesce(contains(text, 'tion'), false) OR lang = 'en'
       OR starts_with(CAST(n_chars AS VARCHAR), '11')""")
def filter_string(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", "lang", contains_text("text", "tion").alias("has_tion"),
        (F.col("lang") == "en").alias("is_english"),
        F.startswith(F.col("n_chars").cast("string"), F.lit("11")).alias("starts_11"),
    )
    return rows.where(F.col("has_tion") | F.col("is_english") | F.col("starts_11"))


@query("semi_join", """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def semi_join(spark, d):
    buyers = table(spark, d, "events").where(F.col("event_type") == "purchase")
    return table(spark, d, "customer").select("c_custkey", "c_name").join(
        buyers.select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi"
    )


@query("anti_join", """
    SELECT DISTINCT user_id, event_type FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = e.user_id)""")
def anti_join(spark, d):
    sensors = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("sensor_id"), F.col("s_nationkey").alias("grid_id")
    )
    return unmatched(table(spark, d, "events"), sensors, "user_id", report="event_type")


@query("join_left", """
    SELECT event_id, user_id, s_nationkey AS grid_id
    FROM events LEFT JOIN supplier ON user_id = s_suppkey""")
def join_left(spark, d):
    sensors = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("grid_id"))
    events = table(spark, d, "events")
    return events.join(sensors, F.col("user_id") == F.col("s_suppkey"), "left").select(
        "event_id", "user_id", "grid_id"
    )


HOURLY = "date_trunc('hour', ts) AS time"


@query("join_left_multi", f"""
    WITH views AS (SELECT user_id AS grid_id, {HOURLY}, max(value) AS rain
                   FROM events WHERE event_type = 'view' GROUP BY ALL),
         water AS (SELECT user_id AS grid_id, {HOURLY}, max(value) AS water_level
                   FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT grid_id, time, rain, water_level FROM views LEFT JOIN water USING (grid_id, time)""")
def join_left_multi(spark, d):
    def hourly(kind, out):
        rows = table(spark, d, "events").where(F.col("event_type") == kind)
        return rows.groupBy(F.col("user_id").alias("grid_id"), floor_hour("ts").alias("time")).agg(
            F.max("value").alias(out)
        )

    return hourly("view", "rain").join(hourly("purchase", "water_level"), ["grid_id", "time"], "left")


@query("join_inner", """
    SELECT o_orderkey, l_linenumber, o_orderdate, l_quantity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def join_inner(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", "l_linenumber", "o_orderdate", "l_quantity")


@query("cross_skeleton", f"""
    SELECT time, grid_id FROM (SELECT DISTINCT {HOURLY} FROM events),
                              (SELECT DISTINCT user_id AS grid_id FROM events)""")
def cross_skeleton(spark, d):
    events = table(spark, d, "events")
    times = events.select(floor_hour("ts").alias("time")).distinct()
    cells = events.select(F.col("user_id").alias("grid_id")).distinct()
    return ops.cross_skeleton(times, cells)


@query("fill_constant", """
    SELECT event_id, coalesce(CASE WHEN value >= 20 THEN value END, 0.0) AS value,
           coalesce(CASE WHEN event_type = 'view' THEN ts END, TIMESTAMP '2100-01-01') AS expired
    FROM events""")
def fill_constant(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.when(F.col("value") >= 20, F.col("value")).alias("value"),
        F.when(F.col("event_type") == "view", F.col("ts")).alias("expired"),
    )
    far = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    return rows.fillna(0.0, subset=["value"]).withColumn("expired", F.coalesce("expired", far))


@query("fill_aggregate", """
    WITH v AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS elevation
               FROM customer)
    SELECT c_custkey, round(coalesce(elevation, (SELECT avg(elevation) FROM v)), 6) AS filled_mean,
           coalesce(elevation, (SELECT max(elevation) FROM v)) AS filled_max FROM v""")
def fill_aggregate(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("filled_mean")
    ).withColumn("filled_max", F.col("filled_mean"))
    rows = ops.fill_with_aggregate(rows, "filled_mean", F.avg("filled_mean"))
    rows = ops.fill_with_aggregate(rows, "filled_max", F.max("filled_max"))
    return rows.withColumn("filled_mean", F.round("filled_mean", 6))


@query("fill_interval_end", """
    SELECT event_id, ts AS start_ts,
           coalesce(CASE WHEN event_type = 'view' THEN ts + INTERVAL 3 HOUR END,
                    date_trunc('day', ts) + INTERVAL 1 DAY) AS end_ts
    FROM events""")
def fill_interval_end(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.col("ts").alias("start_ts"),
        F.when(F.col("event_type") == "view", F.col("ts") + F.expr("INTERVAL 3 HOUR")).alias("end_ts"),
    )
    return intervals.fill_interval_end(rows, "start_ts", "end_ts")


@query("agg_hourly_max", f"""
    SELECT {HOURLY}, user_id AS grid_id, CAST(max(value) AS FLOAT) AS water_level
    FROM events GROUP BY ALL""")
def agg_hourly_max(spark, d):
    rows = table(spark, d, "events").select(
        floor_hour("ts").alias("time"), F.col("user_id").alias("grid_id"),
        F.col("value").cast("float").alias("water_level"),
    )
    return ops.hourly_max(rows, ["time", "grid_id"], "water_level")


@query("agg_mean", """
    SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY l_suppkey""")
def agg_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity")
    )


@query("agg_global", """
    SELECT count(*) AS n_rows, min(l_shipdate) AS first, max(l_shipdate) AS last,
           round(avg(l_quantity), 6) AS mean_quantity, max(l_extendedprice) AS max_price
    FROM lineitem""")
def agg_global(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("l_shipdate").alias("first"),
        F.max("l_shipdate").alias("last"),
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
        F.max("l_extendedprice").alias("max_price"),
    )


@query("count_distinct", """
    SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types,
           count(DISTINCT date_trunc('hour', ts)) AS n_hours FROM events""")
def count_distinct(spark, d):
    return table(spark, d, "events").agg(
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("event_type").alias("n_types"),
        F.count_distinct(floor_hour("ts")).alias("n_hours"),
    )


@query("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("dedup_first", """
    SELECT user_id, event_type, ts, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def dedup_first(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return ops.dedup_first(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query("having_groups", """
    SELECT o_custkey, o_orderkey, o_orderdate FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)""")
def having_groups(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ops.groups_with_many(rows, "o_custkey")


@query("value_counts", """
    SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL
    GROUP BY l_returnflag ORDER BY n DESC, l_returnflag""")
def value_counts(spark, d):
    counts = prof.value_counts(table(spark, d, "lineitem"), "l_returnflag")
    return counts.orderBy(F.desc("n"), "l_returnflag")


@query("value_counts_nulls", """
    WITH e AS (SELECT CASE WHEN value > 50 THEN event_type END AS kind FROM events)
    SELECT kind, count(*) AS n FROM e GROUP BY kind""")
def value_counts_nulls(spark, d):
    kind = F.when(F.col("value") > 50, F.col("event_type")).alias("kind")
    return prof.value_counts(table(spark, d, "events").select(kind), "kind", dropna=False)


@query("first_distinct", """
    SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand ORDER BY 2, 1 LIMIT 10""")
def first_distinct(spark, d):
    return ops.first_distinct(table(spark, d, "part"), "p_brand", 10, "p_partkey")


@query("describe", """
    SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean,
           round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min,
           round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
           round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
           round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max
    FROM lineitem""")
def describe(spark, d):
    out = prof.describe(table(spark, d, "lineitem"), "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


NULLED_EVENTS = """
    SELECT event_id, nullif(event_type, 'view') AS event_type,
           CASE WHEN value >= 20 THEN value END AS value, ts FROM events"""


def nulled_events(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.nullif("event_type", F.lit("view")).alias("event_type"),
        F.when(F.col("value") >= 20, F.col("value")).alias("value"), "ts",
    )


@query("null_profile", f"""
    WITH e AS ({NULLED_EVENTS}),
         c AS (SELECT 'event_id' AS "column", count(*) - count(event_id) AS n_null FROM e
               UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM e
               UNION ALL SELECT 'value', count(*) - count(value) FROM e
               UNION ALL SELECT 'ts', count(*) - count(ts) FROM e)
    SELECT "column", n_null, round(n_null * 100 / (SELECT count(*) FROM e), 6) AS null_pct FROM c""")
def null_profile(spark, d):
    return prof.null_profile(nulled_events(spark, d)).withColumn("null_pct", F.round("null_pct", 6))


@query("duplicate_rows", """
    SELECT 2 * (SELECT count(*) FROM lineitem) - count(*) AS n_duplicates
    FROM (SELECT DISTINCT * FROM lineitem)""")
def duplicate_rows(spark, d):
    rows = table(spark, d, "lineitem")
    return prof.duplicate_rows(rows.unionAll(rows))  # whole rows, each at least twice


@query("class_balance", """
    SELECT count(*) AS n_rows, count(*) FILTER (toxic = 1) AS n_positive,
           round(count(*) FILTER (toxic = 1) * 100 / count(*), 6) AS positive_pct FROM labels""")
def class_balance(spark, d):
    out = prof.class_balance(table(spark, d, "labels"), "toxic")
    return out.withColumn("positive_pct", F.round("positive_pct", 6))


@query("sort_multi", """
    SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem
    ORDER BY l_suppkey, l_shipdate, l_orderkey, l_linenumber""")
def sort_multi(spark, d):
    keys = ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber"]
    return table(spark, d, "lineitem").select(*keys).orderBy(*keys)


@query("top_n", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_n(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("union_all", """
    SELECT user_id AS id FROM events UNION ALL SELECT c_custkey FROM customer""")
def union_all(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return table(spark, d, "events").select(F.col("user_id").alias("id")).unionByName(customers)


@query("set_union", """
    SELECT date_trunc('hour', ts) AS time FROM events WHERE event_type = 'error'
    UNION SELECT date_trunc('hour', ts) FROM events WHERE value > 50""")
def set_union(spark, d):
    events = table(spark, d, "events")
    floods = events.where(F.col("event_type") == "error").select(floor_hour("ts").alias("time"))
    wet = events.where(F.col("value") > 50).select(floor_hour("ts").alias("time"))
    return floods.union(wet).distinct()


def event_users(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id"))


@query("set_intersect", """
    SELECT user_id AS id FROM events INTERSECT SELECT s_suppkey FROM supplier""")
def set_intersect(spark, d):
    return event_users(spark, d).intersect(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("set_except", """
    SELECT user_id AS id FROM events EXCEPT SELECT s_suppkey FROM supplier""")
def set_except(spark, d):
    return event_users(spark, d).subtract(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("union_by_name", """
    SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name
    FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""")
def union_by_name(spark, d):
    return union_files([
        table(spark, d, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment")),
        table(spark, d, "supplier").select(
            F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
            F.col("s_suppkey").alias("id")),
    ])


@query("standardize_columns", """
    SELECT CAST(c_custkey AS VARCHAR) AS unq_no, NULL::VARCHAR AS se_cd, c_mktsegment AS se_nm,
           NULL::VARCHAR AS msrmt_ymd, NULL::VARCHAR AS msrmt_watl, NULL::VARCHAR AS sgn_stts,
           c_name AS pstn_info, 'customer:' || c_mktsegment AS source_file FROM customer
    UNION ALL
    SELECT CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR), NULL, NULL,
           CAST(s_nationkey * 2 AS VARCHAR), NULL, s_name, 'supplier:' || s_nationkey FROM supplier""")
def standardize(spark, d):
    korean = table(spark, d, "customer").select(
        F.col("c_custkey").alias("고유번호"), F.col("c_mktsegment").alias("구분명"),
        F.col("c_name").alias("위치정보"),
    )
    upper = table(spark, d, "supplier").select(
        F.col("s_name").alias("PSTN_INFO"), F.col("s_suppkey").alias("UNQ_NO"),
        F.col("s_nationkey").alias("SE_CD"), (F.col("s_nationkey") * 2).alias("MSRMT_WATL"),
    )
    first = standardize_columns(korean, F.concat_ws(":", F.lit("customer"), F.col("구분명")))
    second = standardize_columns(
        upper, F.concat_ws(":", F.lit("supplier"), F.col("SE_CD").cast("string"))
    )
    return first.unionByName(second)


@query("normalize_id", """
    SELECT event_id, trim('  ' || user_id || ' ') AS sensor_id FROM events""")
def normalize(spark, d):
    padded = F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" "))
    return table(spark, d, "events").select("event_id", normalize_id(padded).alias("sensor_id"))


CLEAN_SQL = r"""
    CASE WHEN lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))) = 'none' THEN '' ELSE
    trim(regexp_replace(split_part(regexp_replace(regexp_replace(regexp_replace(
        replace(replace(replace(coalesce({0}, ''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
        '<.*?>', '', 'g'), '\(.*?\)', '', 'g'),
        '(?s)(앞|옆|뒤|사거리|교차로|맨홀|측구|지점에 위치|도로에 위치).*$', ''),
        ',', 1), '\s+', ' ', 'g')) END"""


@query("clean_text", f"""
    SELECT 'page' AS kind, page_id AS id, {CLEAN_SQL.format('html')} AS address FROM pages
    UNION ALL SELECT 'document', doc_id, {CLEAN_SQL.format('text')} FROM documents
    UNION ALL SELECT 'customer', c_custkey,
        {CLEAN_SQL.format("(c_name || ' &lt;b&gt;x&lt;/b&gt; (동)  ' || c_mktsegment || ' 사거리 앞, ' || c_nationkey)")}
        FROM customer
    UNION ALL SELECT 'missing', o_orderkey,
        {CLEAN_SQL.format("CASE WHEN o_orderstatus = 'F' THEN ' None ' ELSE o_orderpriority END")}
        FROM orders""")
def clean_text(spark, d):
    def cleaned(name, kind, key, text):
        return table(spark, d, name).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), clean_address(text).alias("address")
        )

    address = F.concat(
        "c_name", F.lit(" &lt;b&gt;x&lt;/b&gt; (동)  "), "c_mktsegment", F.lit(" 사거리 앞, "),
        F.col("c_nationkey").cast("string"),
    )
    missing = F.when(F.col("o_orderstatus") == "F", F.lit(" None ")).otherwise(
        F.col("o_orderpriority")
    )
    parts = [
        cleaned("pages", "page", "page_id", F.col("html")),
        cleaned("documents", "document", "doc_id", F.col("text")),
        cleaned("customer", "customer", "c_custkey", address),
        cleaned("orders", "missing", "o_orderkey", missing),
    ]
    return union_files(parts)


@query("safe_cast", """
    SELECT event_id, TRY_CAST(t AS FLOAT) AS as_float, TRY_CAST(t AS SMALLINT) AS as_small
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad' || user_id
                                WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR)
                                WHEN event_type = 'click' THEN '-' || user_id || '.25' END AS t
          FROM events)""")
def safe_casts(spark, d):
    user = F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("bad"), user))
        .when(F.col("event_type") == "view", user)
        .when(F.col("event_type") == "click", F.concat(F.lit("-"), user, F.lit(".25")))
    )
    rows = table(spark, d, "events").select("event_id", text.alias("t"))
    whole = F.when(~F.contains("t", F.lit(".")), F.col("t")).otherwise(
        F.round(safe_cast("t", "double")).cast("long").cast("string"))
    return rows.select(
        "event_id", safe_cast("t", "float").alias("as_float"),
        safe_cast(whole, "smallint").alias("as_small"),
    )


@query("bin_distance", """
    SELECT o_orderkey, dist, CASE WHEN dist > 500 THEN 2 WHEN dist > 100 THEN 1
                                  WHEN dist > -1 THEN 0 END AS distance_class,
           CASE WHEN dist > 500 THEN '500m+' WHEN dist > 100 THEN '100-500m'
                WHEN dist > -1 THEN '0-100m' END AS distance_label
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P'
                                  THEN floor(o_totalprice / 500) - 2 END AS dist FROM orders)""")
def bin_distance(spark, d):
    dist = F.when(
        F.col("o_orderstatus") != "P", (F.floor(F.col("o_totalprice") / 500) - 2).cast("double")
    )
    rows = table(spark, d, "orders").select("o_orderkey", dist.alias("dist"))
    return rows.withColumns({
        "distance_class": distance_class("dist"), "distance_label": distance_label("dist"),
    })


@query("json_extract", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
           json_extract_string(props, '$.absent') AS absent FROM events""")
def json_extract(spark, d):
    parsed = F.from_json("props", "k int, absent string")
    return table(spark, d, "events").select("event_id", parsed.alias("p")).select(
        "event_id", "p.k", "p.absent"
    )


@query("format_hour", """
    SELECT event_id, strftime(ts - INTERVAL 1 HOUR, '%Y%m%d%H') AS from_hour,
           strftime(ts, '%Y%m%d%H') AS to_hour FROM events""")
def format_hour(spark, d):
    first, last = hour_range_stamps("ts")
    return table(spark, d, "events").select(
        "event_id", first.alias("from_hour"), last.alias("to_hour")
    )


@query("profile_table", f"""
    WITH e AS ({NULLED_EVENTS})
    SELECT count(*) AS n_rows, count(*) - count(event_type) + count(*) - count(value) AS n_null_cells,
           min(ts) AS time_min, max(ts) AS time_max, count(DISTINCT event_type) AS n_cells,
           4 AS n_columns,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS n_duplicates
    FROM e""")
def profile_table(spark, d):
    return prof.profile_table(nulled_events(spark, d), "ts", "event_type")


@query("coverage_report", """
    WITH h AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'view'),
         a AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'click'),
         f AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error')
    SELECT 'historical_cells' AS metric, count(*) AS n FROM h
    UNION ALL SELECT 'live_cells', count(*) FROM a
    UNION ALL SELECT 'shared_cells', count(*) FROM (SELECT id FROM h INTERSECT SELECT id FROM a)
    UNION ALL SELECT 'flagged_cells', count(*) FROM f
    UNION ALL SELECT 'flagged_in_historical', count(*) FROM (SELECT id FROM f INTERSECT SELECT id FROM h)
    UNION ALL SELECT 'flagged_in_live', count(*) FROM (SELECT id FROM f INTERSECT SELECT id FROM a)
    UNION ALL SELECT 'flagged_missing_historical', count(*) FROM (SELECT id FROM f EXCEPT SELECT id FROM h)
    UNION ALL SELECT 'flagged_missing_live', count(*) FROM (SELECT id FROM f EXCEPT SELECT id FROM a)""")
def coverage_report(spark, d):
    events = table(spark, d, "events")

    def of(kind):
        return events.where(F.col("event_type") == kind)

    return prof.coverage_report(of("view"), of("click"), of("error"), "user_id")


@query("validate_inputs", """
    SELECT n_nationkey, n_name, checked, problem FROM nation, (VALUES
      ('columns', 'missing columns'), ('rows', 'no rows'), ('numbers', 'unusable values'),
      ('system', 'unusable values'), ('sound', NULL)) v(checked, problem)""")
def validate_inputs(spark, d):
    """Every check on the whole table, with what it raised."""
    nation = table(spark, d, "nation").withColumn("epsg", F.lit(5179)).select("n_nationkey", "n_name", "epsg")
    checks = {
        "columns": (nation, {"required": ["lost"]}), "rows": (nation.limit(0), {"required": []}),
        "numbers": (nation, {"required": [], "numeric": ("n_name",)}),
        "system": (nation, {"required": [], "epsg": "epsg", "wanted_epsg": 4326}),
        "sound": (nation, {"required": ["n_name"], "numeric": ("n_nationkey",), "epsg": "epsg", "wanted_epsg": 5179}),
    }
    found = []
    for name, (rows, wanted) in checks.items():
        try:
            ops.validate(rows, name="nation", **wanted)
            problem = F.lit(None).cast("string")
        except ValueError as e:
            problem = F.lit(next(t for t in ("missing columns", "no rows", "unusable values") if t in str(e)))
        found.append(nation.select("n_nationkey", "n_name", F.lit(name).alias("checked"), problem.alias("problem")))
    return union_files(found)


@query("drop_column", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def drop_column(spark, d):
    root = run_dir(spark, "drop-column")
    write_version(table(spark, d, "customer"), root)
    drop_stored_column(spark, root, "c_mktsegment")
    return read_latest(spark, root)
