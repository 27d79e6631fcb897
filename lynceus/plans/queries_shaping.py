"""Queries over the shaping, event-log and exploratory operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.operators import eda, eventlog, shaping
from lynceus.plans import stand_ins as s
from lynceus.plans.catalog import query, rounded
from lynceus.sources.messages import decode_columnar_json, encode_columnar_json, explode_records

ROUND_SENSORS = ", ".join(f"round({c}, 6) AS {c}" for c in s.SENSORS)


@query("pivot_sensors", f"SELECT ds, {ROUND_SENSORS} FROM ({s.sensors_sql()})")
def pivot_sensors(spark, d):
    return rounded(s.sensors(spark, d))


@query("normalize_ts", """
SELECT event_id, date_trunc('millisecond', ts)::timestamp AS ts_epoch,
  date_trunc('day', ts)::timestamp AS ts_text FROM events""")
def normalize_ts(spark, d):
    rows = s.events(spark, d).select(
        "event_id", F.unix_millis("ts").alias("ts_epoch"), F.date_format("ts", "dd/MM/yyyy").alias("ts_text"))
    rows = shaping.normalize_ts(rows, "ts_epoch", "ms")
    return rounded(shaping.normalize_ts(rows, "ts_text", "%d/%m/%Y"))


@query("to_series", "SELECT user_id AS series_id, ts AS ds, value AS y FROM events")
def to_series(spark, d):
    return rounded(shaping.to_series(s.events(spark, d), "ts", "value", series="user_id"))


@query("to_labelled", """
SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS target FROM lineitem""")
def to_labelled(spark, d):
    return shaping.to_labelled(s.table(spark, d, "lineitem"), "l_returnflag", s.LINE_FEATURES)


@query("encode_target", """
SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events""")
def encode_target(spark, d):
    rows = s.table(spark, d, "events").select("event_id", "event_type")
    return shaping.encode_target(rows, "event_type", "code").select("event_id", "event_type", "code")


@query("chrono_split", """
SELECT event_id, row_idx, row_idx >= n - ceil(n * 0.3) AS is_test FROM (
  SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx, count(*) OVER () AS n FROM events)""")
def chrono_split(spark, d):
    rows = s.table(spark, d, "events").select("event_id", "ts")
    return shaping.chrono_split(rows, ["ts", "event_id"], 0.3).drop("ts")


@query("replay_batches", """
WITH RECURSIVE r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx,
    count(*) OVER () AS n FROM events),
t AS (SELECT event_id, row_idx, row_idx - (n - ceil(n * 0.3)::bigint) AS pos, ceil(n * 0.3)::bigint AS m FROM r
  WHERE row_idx >= n - ceil(n * 0.3)::bigint),
cut AS (SELECT 0 AS level, 0::bigint AS start, (SELECT max(m) FROM t) AS size
  UNION ALL SELECT level + 1, start + h * (size // 2), CASE h WHEN 0 THEN size // 2 ELSE size - size // 2 END
  FROM cut, (VALUES (0), (1)) v(h) WHERE level < 3),
parts AS (SELECT start, size, row_number() OVER (ORDER BY start) - 1 AS batch_no FROM cut WHERE level = 3)
SELECT event_id, row_idx, batch_no FROM t JOIN parts ON pos >= start AND pos < start + size""")
def replay_batches(spark, d):
    rows = s.table(spark, d, "events").select("event_id", "ts")
    out = shaping.replay_batches(rows, ["ts", "event_id"], 0.3)
    return out.select("event_id", "row_idx", F.col("batch_no").cast("long").alias("batch_no"))


@query("assign_regular_ts", """
SELECT o_orderkey, TIMESTAMP '2018-01-01 00:00:00'
  + to_hours(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS ds FROM orders""")
def assign_regular_ts(spark, d):
    rows = s.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    out = shaping.assign_regular_ts(rows, ["o_orderdate", "o_orderkey"], datetime(2018, 1, 1), timedelta(hours=1))
    return rounded(out.select("o_orderkey", "ds"))


@query("join_history", """
SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def join_history(spark, d):
    rows = s.events(spark, d).select("event_id", "ts", "event_type", "value")
    train, new = rows.filter("event_type <> 'view'").drop("event_type"), rows.filter("event_type = 'view'")
    return shaping.join_history(train, new, ["ts", "event_id"], 500).select("event_id", "value")


@query("tail_window", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def tail_window(spark, d):
    rows = s.table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return shaping.tail_window(rows, ["o_orderdate", "o_orderkey"], 200).drop("o_orderdate")


@query("explode_records", """
SELECT event_id, event_type AS target, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, value FROM events""")
def explode_messages(spark, d):
    record = F.struct(F.col("event_type").alias("target"),
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), "value")
    messages = s.events(spark, d).select(
        "event_id", F.to_json(F.struct(F.array(record).alias("tsdata"))).alias("body"))
    return explode_records(messages, "body")


@query("decode_columnar_json", """
SELECT event_id // 1000 AS message, event_id::varchar AS row_key, event_type, user_id, value FROM events""")
def decode_messages(spark, d):
    rows = s.table(spark, d, "events").withColumn("message", F.expr("event_id div 1000"))
    messages = encode_columnar_json(rows, "message", "event_id", ["event_type", "user_id", "value"])
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("user_id", T.LongType()),
                           T.StructField("value", T.DoubleType())])
    return decode_columnar_json(messages, "body", schema, "message")


@query("order_log", """
SELECT event_id, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) - 1 AS event_idx
FROM (%s)""" % s.USER_DAY_SQL)
def order_log(spark, d):
    out = eventlog.order_log(s.user_day_log(spark, d), ["user_id", "day"], ["ts", "event_id"])
    return out.select("event_id", "event_idx")


@query("parse_event_ts", "SELECT event_id, date_trunc('second', ts)::timestamp AS start_ts FROM events")
def parse_event_ts(spark, d):
    rows = s.events(spark, d).select(
        "event_id", F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("start_ts"))
    return rounded(eventlog.parse_event_ts(rows, ["start_ts"]))


@query("to_event_log", """
SELECT user_id AS "case:concept:name", event_type AS "concept:name", ts AS "start:timestamp" FROM events""")
def to_event_log(spark, d):
    names = {"user_id": "case:concept:name", "event_type": "concept:name", "ts": "start:timestamp"}
    out = eventlog.to_event_log(s.table(spark, d, "events"), names)
    return out.select(*[f"`{n}`" for n in names.values()])


@query("filter_log", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def filter_log(spark, d):
    out = eventlog.filter_log(s.table(spark, d, "events"), F.col("event_type") == "purchase")
    return out.select("event_id", "user_id", "value")


@query("cases_with_activity", f"""
WITH log AS ({s.USER_DAY_SQL})
SELECT event_id, user_id, event_type FROM log
WHERE (user_id, day) IN (SELECT (user_id, day) FROM log WHERE event_type = 'error')""")
def cases_with_activity(spark, d):
    out = eventlog.cases_with_activity(s.user_day_log(spark, d), ["user_id", "day"], "event_type", "error")
    return out.select("event_id", "user_id", "event_type")


@query("first_seen_codes", """
SELECT user_id, row_number() OVER (ORDER BY first_id) AS code
FROM (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY 1)""")
def first_seen_codes(spark, d):
    return eventlog.first_seen_codes(s.table(spark, d, "events"), "user_id", "event_id")


@query("build_traces", f"""
SELECT user_id, day, 0::bigint AS segment_no, count(*)::int AS n_events,
  string_agg(event_type, ' ' ORDER BY ts, event_id) AS trace_text FROM ({s.USER_DAY_SQL}) GROUP BY 1, 2""")
def build_traces(spark, d):
    out = eventlog.build_traces(s.user_day_log(spark, d), ["user_id", "day"], ["ts", "event_id"], "event_type")
    return rounded(eventlog.trace_text(out).drop("trace"))


HIST_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
HIST_SQL = " UNION ALL ".join(f"""
SELECT '{c}' AS sensor, NULL::varchar AS category, bin, round(lo + bin * w, 6) AS bin_from, count(*) AS n FROM (
  SELECT least(floor(({c} - lo) / w), 9)::int AS bin, lo, w FROM lineitem,
    (SELECT min({c}) AS lo, (max({c}) - min({c})) / 10 AS w FROM lineitem)) GROUP BY bin, lo, w""" for c in HIST_COLS)


@query("histograms", HIST_SQL + """ UNION ALL SELECT 'l_returnflag', l_returnflag, NULL, NULL, count(*)
FROM lineitem GROUP BY l_returnflag""")
def histograms(spark, d):
    return rounded(eda.histograms(s.table(spark, d, "lineitem"), [*HIST_COLS, "l_returnflag"], 10))


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in s.LINE_FEATURES for b in s.LINE_FEATURES))
def correlation_matrix(spark, d):
    return rounded(eda.correlation_matrix(s.table(spark, d, "lineitem"), s.LINE_FEATURES))


@query("missing_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, count(*) FILTER ({c} IS NULL) AS n_missing FROM ({s.sensors_sql()})"
    for c in ["ds", *s.SENSORS]))
def missing_counts(spark, d):
    return eda.missing_counts(s.sensors(spark, d))


@query("binned_counts", """
WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM events),
b AS (SELECT least(floor((value - lo) / w), 49)::int AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT i::int AS bin, round(lo + (i + 0.5) * w, 6) AS centre, coalesce(n, 0) AS n
FROM range(50) r(i) CROSS JOIN e LEFT JOIN b ON b.bin = i""")
def binned_counts(spark, d):
    return rounded(eda.binned_counts(s.table(spark, d, "events"), "value"))


SPC_SQL = """
SELECT {keys}, round(centre, 6) AS centre, round(sigma, 6) AS sigma, round(centre + 3 * sigma, 6) AS ucl3,
  round(centre - 3 * sigma, 6) AS lcl3, CASE WHEN x IS NULL THEN NULL WHEN abs(x - centre) <= sigma THEN 'C'
  WHEN abs(x - centre) <= 2 * sigma THEN 'B' WHEN abs(x - centre) <= 3 * sigma THEN 'A' ELSE 'OUT' END AS zone
FROM ({rows})"""


@query("spc_zones", SPC_SQL.format(keys="ds", rows=f"""SELECT ds, click AS x, avg(click) OVER () AS centre,
  stddev_pop(click) OVER () AS sigma FROM ({s.sensors_sql('day')})"""))
def spc_zones(spark, d):
    out = eda.spc_zones(s.sensors(spark, d, "day"), "click")
    return rounded(out.select("ds", "centre", "sigma", "ucl3", "lcl3", "zone"))


@query("spc_zones_by", SPC_SQL.format(keys="event_id, event_type", rows="""SELECT event_id, event_type, value AS x,
  avg(value) OVER (PARTITION BY event_type) AS centre, stddev_pop(value) OVER (PARTITION BY event_type) AS sigma
  FROM events"""))
def spc_zones_by(spark, d):
    out = eda.spc_zones(s.table(spark, d, "events"), "value", by="event_type")
    return rounded(out.select("event_id", "event_type", "centre", "sigma", "ucl3", "lcl3", "zone"))


def z_sql(cols, rows, keep="") -> str:
    """SELECT of the z-scaled columns (population sigma)."""
    z = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
                  f"ELSE stddev_pop({c}) OVER () END AS {c}" for c in cols)
    return f"SELECT {keep}{z} FROM ({rows})"


@query("scaler", "SELECT user_id, ds, " + ", ".join(f"round({c}, 6) AS {c}" for c in s.UNIT_FEATURES)
       + f" FROM ({z_sql(s.UNIT_FEATURES, s.UNIT_DAYS_SQL, 'user_id, ds, ')})")
def scaler(spark, d):
    rows = s.unit_days(spark, d)
    return rounded(eda.Scaler.fit(rows, s.UNIT_FEATURES).transform(rows))


@query("anomaly_counts", """
SELECT event_type, count(*) AS n, count(*) FILTER (value > 150) AS n_anomalies,
  round(count(*) FILTER (value > 150) / count(*), 6) AS anomaly_ratio FROM events GROUP BY 1""")
def anomaly_counts(spark, d):
    rows = s.table(spark, d, "events").withColumn("is_anomaly", F.col("value") > 150)
    return rounded(eda.anomaly_counts(rows, "event_type"))


@query("class_series", " UNION ALL ".join(
    f"SELECT ds, n_events > 2 AS state, user_id, '{c}' AS sensor, round({c}, 6) AS value FROM ({s.UNIT_DAYS_SQL})"
    for c in s.UNIT_FEATURES))
def class_series(spark, d):
    rows = s.unit_days(spark, d).withColumn("state", F.col("n_events") > 2)
    return rounded(eda.class_series(rows, s.UNIT_FEATURES, "state", keep=["user_id"]))


@query("outlier_overlay", " UNION ALL ".join(
    f"SELECT ds, click > 60 AS is_anomaly, '{c}' AS sensor, round({c}, 6) AS value FROM ({s.sensors_sql()})"
    " WHERE click > 60" for c in s.SENSORS))
def outlier_overlay(spark, d):
    rows = s.sensors(spark, d).withColumn("is_anomaly", F.col("click") > 60)
    return rounded(eda.outlier_overlay(rows, s.SENSORS, only_outliers=True))


@query("quantile_bins", f"""
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM lineitem)
SELECT bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM (
  SELECT ({' + '.join(f'(e[{i}] < l_extendedprice)::int' for i in range(1, 10))}) AS bin, l_extendedprice FROM lineitem, q) GROUP BY 1""")
def quantile_bins(spark, d):
    rows = s.table(spark, d, "lineitem").select("l_extendedprice")
    number = eda.QuantileBinner.fit(rows, ["l_extendedprice"], q=10).bin_of("l_extendedprice")
    return rows.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
