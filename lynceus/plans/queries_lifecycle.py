"""Queries over experiments and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.operators import shaping
from lynceus.plans import experiment, store
from lynceus.plans import stand_ins as s
from lynceus.plans.catalog import query, rounded
from lynceus.plans.queries_shaping import z_sql
from lynceus.session import new_folder
from lynceus.streaming import scoring, sigma_monitor

T2_COLS = ["l_quantity", "l_extendedprice"]
PCA_CFG = {"load_object": {"module": "detection", "name": "FaultDetectionExperiment"},
           "setup": {"features": T2_COLS},
           "create_model": {"model": "pca", "params": {"n_components": 2}}}
LINE_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
# two scaled columns with correlation r: T2 in closed form, limit chi-square(2, 0.95)
T2_SQL = f"""
WITH z AS ({z_sql(T2_COLS, 'SELECT * FROM lineitem', ', '.join(LINE_IDS) + ', ')}),
r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM z),
t AS (SELECT {', '.join(LINE_IDS)}, (l_quantity + l_extendedprice) ** 2 / (2 * (1 + r))
  + (l_quantity - l_extendedprice) ** 2 / (2 * (1 - r)) AS t2 FROM z, r)
SELECT {', '.join(LINE_IDS)}, round(t2, 5) AS t2, t2 > 5.991464547107979 AS is_t2 FROM t"""


def _lines(spark, d):
    return s.table(spark, d, "lineitem").select(*LINE_IDS, *T2_COLS)


@query("experiment_run", T2_SQL)
def experiment_run(spark, d):
    """Train from a configuration, store, load again, predict."""
    root = new_folder(spark, "store")
    experiment.train(spark, root, "lines", PCA_CFG, _lines(spark, d))
    return rounded(experiment.load(spark, root, "lines").predict(_lines(spark, d)).select(*LINE_IDS, "t2", "is_t2"), 5)


@query("report_lookup", """
SELECT l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY 1""")
def report_lookup(spark, d):
    """Train with the exploratory step, then look up one stored report."""
    root = new_folder(spark, "store")
    cfg = {**PCA_CFG, "setup": {"features": T2_COLS}, "eda": {}}
    cfg = {k: cfg[k] for k in ("load_object", "setup", "eda", "create_model")}
    experiment.train(spark, root, "lines", cfg, s.table(spark, d, "lineitem").select(*T2_COLS, "l_returnflag"))
    found = store.read_report(spark, root, "lines", "eda_histograms")
    return found.filter("sensor = 'l_returnflag'").select("category", "n")


@query("stream_predict", T2_SQL)
def stream_predict(spark, d):
    """Score the table as a stream of files; equals the batch result."""
    root = new_folder(spark, "store")
    rows = _lines(spark, d)
    experiment.train(spark, root, "lines", PCA_CFG, rows)
    source = scoring.file_stream(spark, d, rows.schema, pattern="lineitem.parquet")
    stream = scoring.stream_predict(spark, source, root, "lines", new_folder(spark, "stream"))
    stream.awaitTermination()
    return rounded(store.read_batches(spark, root, "predictions", "lines").select(*LINE_IDS, "t2", "is_t2"), 5)


DEPTH = 2
SIGMA_SQL = """
WITH RECURSIVE r AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos,
  count(*) OVER () AS n FROM events),
cut AS (SELECT 0 AS level, 0::bigint AS start, (SELECT max(n) FROM r) AS size
  UNION ALL SELECT level + 1, start + h * (size // 2), CASE h WHEN 0 THEN size // 2 ELSE size - size // 2 END
  FROM cut, (VALUES (0), (1)) v(h) WHERE level < 2),
parts AS (SELECT start, size, row_number() OVER (ORDER BY start) - 1 AS batch_no FROM cut WHERE level = 2),
e AS (SELECT event_id, event_type, value, batch_no FROM r JOIN parts ON pos >= start AND pos < start + size),
s AS (SELECT a.event_type, p.batch_no, avg(a.value) AS m, stddev_pop(a.value) AS sd FROM e a
  JOIN (SELECT DISTINCT batch_no FROM e) p ON a.batch_no < p.batch_no GROUP BY 1, 2)
SELECT event_id, round(m, 6) AS mean, round(sd, 6) AS sigma, coalesce(abs(value - m) > 3 * sd, false) AS is_anomaly
FROM e LEFT JOIN s ON e.event_type = s.event_type AND e.batch_no = s.batch_no"""


def _batches(spark, d):
    rows = s.table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return shaping.replay_batches(rows, ["ts", "event_id"], frac=1.0, depth=DEPTH).drop("row_idx")


@query("batch_sigma", SIGMA_SQL)
def batch_sigma(spark, d):
    out = sigma_monitor.batch_sigma(_batches(spark, d), "event_type", y="value")
    return rounded(out.select("event_id", "mean", "sigma", "is_anomaly"))


@query("stream_sigma", SIGMA_SQL)
def stream_sigma(spark, d):
    """Replay the table batch by batch through one streaming job."""
    inbox, out, mark = (new_folder(spark, n) for n in ("inbox", "sigma", "stream"))
    rows = _batches(spark, d).persist()
    try:
        for number in range(2 ** DEPTH):
            # files arrive while the job is down; its next start takes them as one micro-batch
            rows.filter(F.col("batch_no") == number).drop("batch_no").write.mode("append").parquet(inbox)
            source = spark.readStream.schema(rows.drop("batch_no").schema).parquet(inbox)
            sigma_monitor.stream_sigma(source, "event_type", out, mark, y="value").awaitTermination()
    finally:
        rows.unpersist()
    return rounded(sigma_monitor.judged_rows(spark, out).select("event_id", "mean", "sigma", "is_anomaly"))
