"""Monitoring tables derived from the driver's tables.

Each function has a SQL twin of the same columns, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.operators.shaping import pivot_sensors

SENSORS = ["click", "error", "purchase", "signup", "view"]
UNIT_FEATURES = ["n_events", "avg_value", "max_value", "sd_value"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def sensors(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Wide sensor frame: mean value per event type and hour (or day)."""
    rows = events(spark, sf_dir).withColumn("ds", F.date_trunc(unit, "ts"))
    return pivot_sensors(rows, "ds", "event_type", "value", SENSORS)


def sensors_sql(unit: str = "hour") -> str:
    cells = ", ".join(f"avg(value) FILTER (event_type = '{s}') AS {s}" for s in SENSORS)
    return f"SELECT date_trunc('{unit}', ts)::timestamp AS ds, {cells} FROM events GROUP BY 1"


def unit_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every user and day."""
    return (events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("ds"))
            .agg(F.count(F.lit(1)).cast("double").alias("n_events"), F.avg("value").alias("avg_value"),
                 F.max("value").alias("max_value"), F.stddev_pop("value").alias("sd_value")))


UNIT_DAYS_SQL = """SELECT user_id, date_trunc('day', ts)::timestamp AS ds, count(*)::double AS n_events,
  avg(value) AS avg_value, max(value) AS max_value, stddev_pop(value) AS sd_value
  FROM events GROUP BY 1, 2"""


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the binary state ``returned``; the row id separates equal lines."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
                       *LINE_FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("target"))


LABELLED_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity,
  l_extendedprice, l_discount, l_tax, (l_returnflag = 'R')::int AS target FROM lineitem"""


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series: order value per day."""
    return (table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp").alias("ds"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("y")))


DAILY_SQL = "SELECT o_orderdate::timestamp AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1"


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many series: the values of every user along time."""
    return events(spark, sf_dir).select(F.col("user_id").alias("series_id"), F.col("ts").alias("ds"),
                                        F.col("value").alias("y"))


USERS_SQL = "SELECT user_id AS series_id, ts AS ds, value AS y FROM events"


def user_day_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log with short cases: one case per user and day."""
    return events(spark, sf_dir).select("event_id", "user_id", F.date_trunc("day", "ts").alias("day"),
                                        "ts", "event_type", "value")


USER_DAY_SQL = """SELECT event_id, user_id, date_trunc('day', ts)::timestamp AS day, ts, event_type, value
  FROM events"""


def type_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types bought together in an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # collect_set keeps distinct types only, so a basket never exceeds the number of types
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("l_orderkey").agg(F.collect_set("p_type").alias("items")))


BASKETS_SQL = "SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey"
