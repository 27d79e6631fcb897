"""Queries over process mining, Markov chains, metrics and the series rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.operators import eda, eventlog, itemsets, markov, metrics, process_graph, sequences, series, top_rules
from lynceus.plans import lifecycle
from lynceus.plans import stand_ins as s
from lynceus.plans.catalog import query, rounded

# --- itemsets and rules -------------------------------------------------------------------------

def sets_sql(share: float) -> str:
    """Baskets as bit masks over the part types: s (k, support) holds every frequent set, names (k, txt, bar) its items."""
    return f"""
WITH t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)),
g AS (SELECT m, count(*) AS c FROM (SELECT l_orderkey, sum(1 << i)::bigint AS m FROM ({s.BASKETS_SQL}) x JOIN t
  ON t.p_type = x.p_type GROUP BY 1) GROUP BY 1),
k AS (SELECT k FROM range(1, (SELECT 1 << count(*) FROM t)) r(k)),
s AS (SELECT k, sum(c)::bigint AS support FROM g JOIN k ON (m & k) = k GROUP BY 1
  HAVING sum(c) >= ceil({share} * (SELECT sum(c) FROM g))),
names AS (SELECT k, string_agg(p_type, ' ' ORDER BY p_type) AS txt, string_agg(p_type, '|' ORDER BY p_type) AS bar
  FROM k JOIN t ON ((k >> i) & 1) = 1 GROUP BY 1)"""


def rules_sql(share: float) -> str:
    return sets_sql(share) + """,
rules AS (SELECT na.txt AS x, nc.txt AS y, na.bar AS xs, nc.bar AS ys, s.support, s.support / a.support AS confidence
  FROM s JOIN s a ON (s.k & a.k) = a.k AND a.k <> s.k JOIN names na ON na.k = a.k JOIN names nc ON nc.k = s.k - a.k)"""


def _sets(spark, d, share=0.1):
    return itemsets.frequent_itemsets(s.type_baskets(spark, d), "items", share)


@query("frequent_itemsets", sets_sql(0.1) + """
SELECT bar AS items, support FROM s JOIN names USING (k)""")
def frequent_itemsets(spark, d):
    return _sets(spark, d).select(F.array_join("items", "|").alias("items"), "support")


@query("association_rules", rules_sql(0.1) + """
SELECT xs AS antecedent, ys AS consequent, support, round(confidence, 6) AS confidence FROM rules
WHERE confidence >= 0.1""")
def association_rules(spark, d):
    rules = itemsets.association_rules(_sets(spark, d), 0.1)
    return rounded(rules.select(F.array_join("antecedent", "|").alias("antecedent"),
                                F.array_join("consequent", "|").alias("consequent"), "support", "confidence"))


@query("association_rules_long", rules_sql(0.05) + """
SELECT x || ' ==> ' || y AS rule, support, round(confidence, 6) AS confidence FROM rules WHERE confidence >= 0.1""")
def association_rules_long(spark, d):
    """Rules of rarer sets, with consequents of several items."""
    return rounded(itemsets.rule_text(itemsets.association_rules(_sets(spark, d, 0.05), 0.1))
                   .select("rule", "support", "confidence"))


@query("top_k_rules", rules_sql(0.0) + """
SELECT x || ' ==> ' || y AS rule, support, round(confidence, 6) AS confidence FROM rules WHERE confidence >= 0.3
ORDER BY support DESC, rules.confidence DESC, 1 LIMIT 10""")
def top_k_rules(spark, d):
    rules = top_rules.best_rules(s.type_baskets(spark, d), "items", 10, 0.3)
    return rounded(rules.select("rule", "support", "confidence"))


@query("rule_edges", rules_sql(0.1) + """
SELECT x AS src, y AS dst, support, round(confidence, 6) AS confidence FROM rules WHERE confidence >= 0.1""")
def rule_edges(spark, d):
    return rounded(itemsets.rule_edges(itemsets.association_rules(_sets(spark, d), 0.1)))


# --- sequences ----------------------------------------------------------------------------------

@query("sequential_patterns", f"""
WITH RECURSIVE e AS (SELECT user_id, day, event_type AS i, row_number() OVER (PARTITION BY user_id, day
    ORDER BY ts, event_id) AS p FROM ({s.USER_DAY_SQL})),
n AS (SELECT count(DISTINCT (user_id, day)) AS n FROM e),
m AS (SELECT user_id, day, i AS pattern, p, 1 AS n FROM e UNION ALL
  SELECT m.user_id, m.day, m.pattern || ' ' || e.i, e.p, m.n + 1 FROM m JOIN e ON e.user_id = m.user_id
  AND e.day = m.day AND e.p > m.p AND e.p <= m.p + 3 WHERE m.n < 10),
found AS (SELECT pattern, count(DISTINCT (user_id, day)) AS support FROM m GROUP BY 1)
SELECT pattern, support FROM found, n WHERE support >= ceil(0.02 * n.n)""")
def sequential_patterns(spark, d):
    log = eventlog.order_log(s.user_day_log(spark, d), ["user_id", "day"], ["ts", "event_id"])
    log = log.withColumn("case_id", F.concat_ws("/", "user_id", F.col("day").cast("string")))
    found = sequences.sequential_patterns(log, "case_id", "event_idx", "event_type", 0.02)
    return found.select(F.array_join("pattern", " ").alias("pattern"), "support")


# --- process graphs -----------------------------------------------------------------------------

NEXT_SQL = """SELECT event_type AS src, lead(event_type) OVER w AS dst, lead(event_type, 2) OVER w AS nxt,
  lag(event_type) OVER w AS prior FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

DEPENDENCY_SQL = f"""
WITH e AS (SELECT src, dst, count(*) AS freq, count(*) FILTER (nxt = src AND dst <> src) AS l2
  FROM ({NEXT_SQL}) WHERE dst IS NOT NULL GROUP BY 1, 2),
g AS (SELECT a.src, a.dst, a.freq, CASE WHEN a.src = a.dst THEN a.freq / (a.freq + 1)
    ELSE (a.freq - coalesce(b.freq, 0)) / (a.freq + coalesce(b.freq, 0) + 1) END AS dependency,
  CASE WHEN a.src = a.dst THEN 0.0 ELSE (a.l2 + coalesce(b.l2, 0)) / (a.l2 + coalesce(b.l2, 0) + 1) END AS loop2
  FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src)"""

LOG = ("user_id", ["ts", "event_id"], "event_type")


@query("directly_follows", f"""
SELECT src, dst, count(*) AS freq FROM ({NEXT_SQL}) WHERE dst IS NOT NULL GROUP BY 1, 2""")
def directly_follows(spark, d):
    return process_graph.directly_follows(s.table(spark, d, "events"), *LOG)


@query("dependency_graph", DEPENDENCY_SQL + """
SELECT src, dst, freq, round(dependency, 6) AS dependency, round(loop2, 6) AS loop2_dependency FROM g""")
def dependency_graph(spark, d):
    return rounded(process_graph.dependency_graph(s.table(spark, d, "events"), *LOG))


@query("heuristics_net", DEPENDENCY_SQL + f"""
SELECT 'edge' AS kind, src, dst, freq, round(dependency, 6) AS dependency FROM g
  WHERE dependency >= 0.5 OR loop2 >= 0.5
UNION ALL SELECT 'start', NULL, src, count(*), NULL FROM ({NEXT_SQL}) WHERE prior IS NULL GROUP BY src
UNION ALL SELECT 'end', src, NULL, count(*), NULL FROM ({NEXT_SQL}) WHERE dst IS NULL GROUP BY src""")
def heuristics_net(spark, d):
    return rounded(process_graph.heuristics_net(s.table(spark, d, "events"), *LOG))


@query("and_splits", DEPENDENCY_SQL + """,
k AS (SELECT * FROM g WHERE dependency >= 0.0 AND src <> dst)
SELECT b.src, b.dst AS b, c.dst AS c, round((coalesce(x.freq, 0) + coalesce(y.freq, 0)) / (b.freq + c.freq + 1), 6)
  AS and_measure, (coalesce(x.freq, 0) + coalesce(y.freq, 0)) / (b.freq + c.freq + 1) >= 0.65 AS is_and
FROM k b JOIN k c ON b.src = c.src AND b.dst < c.dst LEFT JOIN g x ON x.src = b.dst AND x.dst = c.dst
LEFT JOIN g y ON y.src = c.dst AND y.dst = b.dst""")
def and_splits(spark, d):
    return rounded(process_graph.and_splits(s.table(spark, d, "events"), *LOG, dependency=0.0))


# --- Markov chain -------------------------------------------------------------------------------

MATRIX_SQL = """
WITH t AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS state_from FROM events),
l AS (SELECT DISTINCT event_type AS x FROM events),
c AS (SELECT a.x AS state_from, b.x AS state_to, count(t.event_id) AS n FROM l a CROSS JOIN l b
  LEFT JOIN t ON t.state_from = a.x AND t.event_type = b.x GROUP BY 1, 2),
m AS (SELECT state_from, state_to, n, n / sum(n) OVER (PARTITION BY state_from) AS p FROM c)"""


@query("transition_matrix", MATRIX_SQL + " SELECT state_from, state_to, n, round(p, 6) AS p FROM m")
def transition_matrix(spark, d):
    return rounded(markov.transition_matrix(s.table(spark, d, "events"), "event_type", ["ts", "event_id"], "user_id"))


@query("score_transitions", MATRIX_SQL + """,
best AS (SELECT state_from, arg_max(state_to, p) AS y_pred FROM m GROUP BY 1)
SELECT event_id, t.state_from, event_type, y_pred, round(p, 6) AS p, coalesce(p < 0.19, false) AS is_anomaly
FROM t LEFT JOIN m ON m.state_from = t.state_from AND m.state_to = event_type
LEFT JOIN best ON best.state_from = t.state_from""")
def score_transitions(spark, d):
    rows = s.table(spark, d, "events")
    matrix = markov.transition_matrix(rows, "event_type", ["ts", "event_id"], "user_id")
    out = markov.score_transitions(rows, matrix, "event_type", ["ts", "event_id"], "user_id", 0.19)
    return rounded(out.select("event_id", "state_from", "event_type", "y_pred", "p", "is_anomaly"))


# --- metrics ------------------------------------------------------------------------------------

GUESS_SQL = f"SELECT target, (l_discount > 0.05)::int AS y_pred, l_quantity, l_shipdate FROM ({s.LABELLED_SQL})"


def _guess(spark, d):
    return s.labelled_lines(spark, d).withColumn("y_pred", (F.col("l_discount") > 0.05).cast("int"))


@query("confusion", f"""
WITH g AS ({GUESS_SQL}), c AS (SELECT a.x AS y, b.x AS y_pred, count(g.target) AS n FROM (VALUES (0), (1)) a(x)
  CROSS JOIN (VALUES (0), (1)) b(x) LEFT JOIN g ON g.target = a.x AND g.y_pred = b.x GROUP BY 1, 2)
SELECT y, y_pred, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM c""")
def confusion(spark, d):
    return rounded(metrics.confusion(_guess(spark, d), "target", "y_pred"))


METRIC_SQL = """round(sum((target = y_pred)::int) / count(*), 6) AS accuracy,
  round(2 * sum(target * y_pred) / (sum(target) + sum(y_pred)), 6) AS f1,
  round(sum(target * y_pred) / sum(y_pred), 6) AS precision, round(sum(target * y_pred) / sum(target), 6) AS recall"""


@query("classification_metrics", f"SELECT {METRIC_SQL} FROM ({GUESS_SQL})")
def classification_metrics(spark, d):
    return rounded(metrics.classification_metrics(_guess(spark, d)))


STEP_SQL = """SELECT series_id, ds, y, lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS y_pred
  FROM (%s)""" % s.USERS_SQL
REGRESSION_SQL = """round(avg((y - y_pred) ** 2), 6) AS mse, round(avg(abs(y - y_pred)), 6) AS mae,
  round(1 - sum((y - y_pred) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
  round(avg(abs(y - y_pred) / abs(y)), 6) AS mape"""


def _naive(spark, d):
    """Last value as forecast."""
    return series.lag_features(s.user_series(spark, d), 1, key="series_id").withColumnRenamed("lag_1", "y_pred")


@query("regression_metrics", f"""
SELECT series_id, {REGRESSION_SQL} FROM ({STEP_SQL}) WHERE y_pred IS NOT NULL GROUP BY 1""")
def regression_metrics(spark, d):
    return rounded(metrics.regression_metrics(_naive(spark, d), by="series_id"))


HISTORY_SQL = f"""
WITH g AS (SELECT *, (year(l_shipdate) - 1990)::int AS batch_no FROM ({GUESS_SQL})),
w AS (SELECT batch_no, {METRIC_SQL} FROM g GROUP BY 1),
h AS (UNPIVOT w ON accuracy, f1, precision, recall INTO NAME metric VALUE value)"""


def _yearly(spark, d):
    rows = _guess(spark, d).withColumn("batch_no", (F.year("l_shipdate") - 1990).cast("int"))
    return lifecycle.metrics_history(rows, "classification")


@query("metrics_history", HISTORY_SQL + " SELECT batch_no, metric, value FROM h")
def metrics_history(spark, d):
    return rounded(_yearly(spark, d))


@query("needs_retrain", HISTORY_SQL + """
SELECT batch_no, metric, value, value < 0.5 AS retrain FROM h WHERE metric = 'accuracy'""")
def needs_retrain(spark, d):
    return rounded(lifecycle.retrain_flags(_yearly(spark, d), "accuracy", 0.5, higher_better=True))


# --- series rules -------------------------------------------------------------------------------

@query("embed", f"""
SELECT ds, round(y + 2 * y1 + 3 * y2 + 4 * y3, 2) AS weighted FROM (SELECT ds, y, lead(y, 1) OVER w AS y1,
  lead(y, 2) OVER w AS y2, lead(y, 3) OVER w AS y3 FROM ({s.DAILY_SQL}) WINDOW w AS (ORDER BY ds))
WHERE y3 IS NOT NULL""")
def embed(spark, d):
    rows = series.embed(s.daily_orders(spark, d), 4)
    return rounded(rows.select("ds", F.expr(
        "aggregate(window, (0D, 1), (a, x) -> (a.col1 + a.col2 * x, a.col2 + 1), a -> a.col1)").alias("weighted")), 2)


@query("lag_features", f"""
SELECT * FROM (SELECT series_id, ds, y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3
  FROM ({s.USERS_SQL}) WINDOW w AS (PARTITION BY series_id ORDER BY ds)) WHERE lag_3 IS NOT NULL""")
def lag_features(spark, d):
    return rounded(series.lag_features(s.user_series(spark, d), 3, key="series_id"))


BAND_SQL = f"""SELECT series_id, ds, y, avg(y) OVER w AS yhat, 2 * stddev_pop(y) OVER w AS uncertainty
  FROM ({s.USERS_SQL}) WINDOW w AS (PARTITION BY series_id)"""


def _aligned(spark, d):
    rows = s.user_series(spark, d)
    level = rows.groupBy("series_id").agg(F.avg("y").alias("yhat"), F.stddev_pop("y").alias("_sd"))
    forecast = rows.select("series_id", "ds").join(level, "series_id").select(
        "series_id", "ds", "yhat", (F.col("yhat") - F.col("_sd")).alias("yhat_lower"),
        (F.col("yhat") + F.col("_sd")).alias("yhat_upper"))
    return series.align_forecast(forecast, rows, "series_id")


@query("align_forecast", f"""
SELECT series_id, ds, round(y - yhat, 8) AS error, round(uncertainty, 8) AS uncertainty FROM ({BAND_SQL})""")
def align_forecast(spark, d):
    return rounded(_aligned(spark, d).select("series_id", "ds", "error", "uncertainty"), 8)


@query("flag_interval", f"""
SELECT series_id, ds, abs(y - yhat) > uncertainty AS is_anomaly FROM ({BAND_SQL})""")
def flag_interval(spark, d):
    return rounded(series.flag_interval(_aligned(spark, d)).select("series_id", "ds", "is_anomaly"))


@query("sigma_rule", f"""
WITH e AS (SELECT series_id, ds, abs(y - y_pred) AS e FROM ({STEP_SQL}) WHERE y_pred IS NOT NULL)
SELECT series_id, ds, round(e, 6) AS score, round((SELECT avg(e) + 3 * stddev_pop(e) FROM e), 6) AS threshold,
  e > (SELECT avg(e) + 3 * stddev_pop(e) FROM e) AS is_anomaly FROM e""")
def sigma_rule(spark, d):
    rows = _naive(spark, d).withColumn("error", F.col("y") - F.col("y_pred"))
    out = series.SigmaRule.fit(rows, 3.0).apply(rows)
    return rounded(out.select("series_id", "ds", "score", "threshold", "is_anomaly"))


@query("sigma_rule_by", f"""
WITH e AS (SELECT series_id, ds, abs(y - y_pred) AS e FROM ({STEP_SQL}) WHERE y_pred IS NOT NULL),
t AS (SELECT *, avg(e) OVER w + 2 * stddev_pop(e) OVER w AS threshold FROM e WINDOW w AS (PARTITION BY series_id))
SELECT series_id, ds, round(e, 6) AS score, round(threshold, 6) AS threshold, e > threshold AS is_anomaly FROM t""")
def sigma_rule_by(spark, d):
    rows = _naive(spark, d).withColumn("error", F.col("y") - F.col("y_pred"))
    out = series.sigma_rule_by(rows, "series_id", 2.0)
    return rounded(out.select("series_id", "ds", "score", "threshold", "is_anomaly"))


@query("flag_zscore", f"""
WITH e AS (SELECT series_id, ds, y - y_pred AS e FROM ({STEP_SQL}) WHERE y_pred IS NOT NULL),
z AS (SELECT series_id, ds, (e - (SELECT avg(e) FROM e)) / (SELECT stddev_pop(e) FROM e) AS z FROM e)
SELECT series_id, ds, round(z, 6) AS score, abs(z) > 3 AS is_anomaly FROM z""")
def flag_zscore(spark, d):
    rows = _naive(spark, d).withColumn("error", F.col("y") - F.col("y_pred"))
    return rounded(series.flag_zscore(rows).select("series_id", "ds", "score", "is_anomaly"))


@query("future_frame", f"""
WITH u AS ({s.USERS_SQL}), r AS (SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS step,
    max(ds) OVER (PARTITION BY series_id) AS last FROM u),
g AS (SELECT series_id, max(epoch_us(last)) AS e, max(epoch_us(last)) - max(epoch_us(ds)) FILTER (ds < last) AS gap
  FROM r GROUP BY 1)
SELECT series_id, step, make_timestamp(e + step * gap) AS ds FROM r JOIN g USING (series_id)""")
def future_frame(spark, d):
    return rounded(series.future_frame(s.user_series(spark, d), key="series_id"))


@query("fit_table", f"""
SELECT series_id, ds, y, round(y_pred, 6) AS y_pred, round(y - y_pred, 6) AS error FROM ({STEP_SQL})
WHERE y_pred IS NOT NULL""")
def fit_table(spark, d):
    fitted = _naive(spark, d).select("series_id", "ds", "y_pred")
    return rounded(eda.fit_table(s.user_series(spark, d), fitted, "series_id"))
