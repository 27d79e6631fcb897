"""Queries over the detection, isolation and series models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.functions.moments import vector_moments
from lynceus.operators import (arima, bayes_net, density, eda, hidden_markov, isolation_forest, metrics,
                               multivariate, naive_bayes, smoothing, trees, trend_season, windows)
from lynceus.plans import stand_ins as s
from lynceus.plans.catalog import query, rounded
from lynceus.plans.queries_shaping import z_sql

UNIT_KEYS = ["user_id", "ds"]
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]

# --- detection ----------------------------------------------------------------------------------

Z_UNITS = z_sql(s.UNIT_FEATURES, s.UNIT_DAYS_SQL, "user_id, ds, ")
GAP2 = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in s.UNIT_FEATURES)


@query("dbscan_noise", f"""
WITH z AS ({Z_UNITS}), near AS (SELECT a.user_id, a.ds, b.user_id AS u2, b.ds AS d2 FROM z a JOIN z b
  ON b.n_events BETWEEN a.n_events - 0.5 AND a.n_events + 0.5 AND {GAP2} <= 0.25),
core AS (SELECT user_id, ds FROM near GROUP BY 1, 2 HAVING count(*) >= 8),
reached AS (SELECT DISTINCT near.user_id, near.ds FROM near JOIN core ON u2 = core.user_id AND d2 = core.ds)
SELECT z.user_id, z.ds, reached.user_id IS NULL AS is_anomaly FROM z LEFT JOIN reached
  ON z.user_id = reached.user_id AND z.ds = reached.ds""")
def dbscan_noise(spark, d):
    rows = s.unit_days(spark, d)
    found = density.DensityOutliers.fit(rows, s.UNIT_FEATURES, eps=0.5, min_samples=8)
    return rounded(found.training_flags(rows).select(*UNIT_KEYS, "is_anomaly"))


@query("elliptic_envelope")
def elliptic_envelope(spark, d):
    rows = s.unit_days(spark, d)
    model = multivariate.EllipticEnvelope.fit(rows, s.UNIT_FEATURES)
    return rounded(model.transform(rows).select(*UNIT_KEYS, "score", "threshold", "is_anomaly"), 4)


@query("mahalanobis", f"""
WITH u AS ({s.UNIT_DAYS_SQL}),
m AS (SELECT avg(avg_value) AS mx, avg(max_value) AS my, var_pop(avg_value) AS vx, var_pop(max_value) AS vy,
  covar_pop(avg_value, max_value) AS c FROM u),
q AS (SELECT user_id, ds, (vy * (avg_value - mx) ** 2 - 2 * c * (avg_value - mx) * (max_value - my)
  + vx * (max_value - my) ** 2) / (vx * vy - c * c) AS score FROM u, m),
t AS (SELECT quantile_cont(score, 0.9) AS threshold FROM q)
SELECT user_id, ds, round(score, 6) AS score, round(threshold, 6) AS threshold, score > threshold AS is_anomaly
FROM q, t""")
def mahalanobis(spark, d):
    rows = s.unit_days(spark, d)
    out = multivariate.mahalanobis(rows, ["avg_value", "max_value"])
    return rounded(out.select(*UNIT_KEYS, "score", "threshold", "is_anomaly"))


@query("isolation_forest")
def isolation_forest_query(spark, d):
    rows = s.unit_days(spark, d)
    model = isolation_forest.IsolationForest.fit(rows, s.UNIT_FEATURES, row_key=UNIT_KEYS)
    return rounded(model.transform(rows).select(*UNIT_KEYS, "score", "is_anomaly", "label"))


# two scaled columns with correlation r: eigenvalues 1 +- r, vectors (1, 1) and (1, -1) over sqrt 2
Z2 = f"""WITH u AS ({z_sql(["avg_value", "max_value"], s.UNIT_DAYS_SQL, "user_id, ds, ")}),
r AS (SELECT corr(avg_value, max_value) AS r FROM u),
p AS (SELECT user_id, ds, r, (avg_value + max_value) / sqrt(2) AS t1, (avg_value - max_value) / sqrt(2) AS t2
  FROM u, r)"""


@query("pca_t2", Z2 + """
SELECT user_id, ds, round(t1 ** 2 / (1 + r) + t2 ** 2 / (1 - r), 6) AS t2, 5.991465::double AS t2_limit,
  t1 ** 2 / (1 + r) + t2 ** 2 / (1 - r) > 5.991464547107979 AS is_t2 FROM p""")
def pca_t2(spark, d):
    rows = s.unit_days(spark, d)
    model = multivariate.PcaMonitor.fit(rows, ["avg_value", "max_value"], n_components=2)
    return rounded(model.transform(rows).select(*UNIT_KEYS, "t2", "t2_limit", "is_t2"))


@query("pca_spe", Z2 + """,
h AS (SELECT *, 1 - r AS l, 1.6448536269514722 AS c FROM p),
g AS (SELECT *, l * (c * sqrt(2.0 / 9) + 1 + (1.0 / 3) * (1.0 / 3 - 1)) ** 3 AS spe_limit FROM h)
SELECT user_id, ds, round(t2 ** 2, 6) AS spe, round(spe_limit, 6) AS spe_limit, t2 ** 2 > spe_limit AS is_spe FROM g""")
def pca_spe(spark, d):
    rows = s.unit_days(spark, d)
    model = multivariate.PcaMonitor.fit(rows, ["avg_value", "max_value"], n_components=1)
    return rounded(model.transform(rows).select(*UNIT_KEYS, "spe", "spe_limit", "is_spe"))


@query("explained_variance", Z2 + """
SELECT 1 AS component, round(1 + r, 6) AS eigenvalue, round((1 + r) / 2, 6) AS ratio, round((1 + r) / 2, 6) AS cumulative
FROM r UNION ALL SELECT 2, round(1 - r, 6), round((1 - r) / 2, 6), 1.0 FROM r""")
def explained_variance(spark, d):
    model = multivariate.PcaMonitor.fit(s.unit_days(spark, d), ["avg_value", "max_value"], n_components=2)
    return rounded(spark.createDataFrame(
        model.explained_variance(), "component int, eigenvalue double, ratio double, cumulative double"))


@query("biplot", Z2 + """
SELECT user_id, ds, round(t1, 6) AS pc1, round(t2, 6) AS pc2, CASE WHEN t1 ** 2 / (1 + r) + t2 ** 2 / (1 - r)
  > 5.991464547107979 THEN 't2' ELSE 'inlier' END AS outlier_class FROM p""")
def biplot(spark, d):
    rows = s.unit_days(spark, d)
    model = multivariate.PcaMonitor.fit(rows, ["avg_value", "max_value"], n_components=2)
    return rounded(model.biplot_scores(rows).select(*UNIT_KEYS, "pc1", "pc2", "outlier_class"))


@query("biplot_loadings", Z2 + """
SELECT 'avg_value' AS sensor, 1 AS component, round(1 / sqrt(2), 6) AS loading UNION ALL
SELECT 'max_value', 1, round(1 / sqrt(2), 6) UNION ALL SELECT 'avg_value', 2, round(1 / sqrt(2), 6) UNION ALL
SELECT 'max_value', 2, round(-1 / sqrt(2), 6)""")
def biplot_loadings(spark, d):
    model = multivariate.PcaMonitor.fit(s.unit_days(spark, d), ["avg_value", "max_value"], n_components=2)
    rows = model.loading_rows()
    return rounded(spark.createDataFrame(rows, "sensor string, component int, loading double"))


@query("wide_covariance", """
WITH e AS (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT i::int AS position, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM e GROUP BY 1""")
def wide_covariance(spark, d):
    rows = s.table(spark, d, "embeddings")
    p = rows.select(F.size("embedding")).first()[0]
    m = vector_moments(rows, "embedding", p)
    out = [(i + 1, float(m.mean[i]), float(m.cov[i, i])) for i in range(p)]
    return rounded(spark.createDataFrame(out, "position int, mean double, variance double"))


@query("pca_wide")
def pca_wide(spark, d):
    """T2 and SPE of 64 columns."""
    rows = s.table(spark, d, "embeddings")
    p = rows.select(F.size("embedding")).first()[0]
    names = [f"e{i}" for i in range(p)]
    rows = rows.select("vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    model = multivariate.PcaMonitor.fit(rows, names)
    return rounded(model.transform(rows).select("vec_id", "t2", "is_t2", "spe", "is_spe"), 4)


# --- isolation ----------------------------------------------------------------------------------

@query("decision_tree")
def decision_tree(spark, d):
    rows = s.labelled_lines(spark, d)
    model = trees.fit_tree(rows, s.LINE_FEATURES, fold_key=LINE_KEYS)
    return metrics.confusion(model.transform(rows).withColumn("target", F.col("target").cast("string")),
                             "target", "y_pred")


@query("random_forest")
def random_forest(spark, d):
    rows = s.labelled_lines(spark, d)
    model = trees.fit_forest(rows, s.LINE_FEATURES, fold_key=LINE_KEYS)
    return metrics.confusion(model.transform(rows).withColumn("target", F.col("target").cast("string")),
                             "target", "y_pred")


@query("feature_importance")
def feature_importance(spark, d):
    one = {"impurity": ["gini"], "minInfoGain": [0.0], "maxDepth": [4]}
    model = trees.fit_tree(s.labelled_lines(spark, d), s.LINE_FEATURES, grid=one, fold_key=LINE_KEYS)
    return rounded(spark.createDataFrame(model.importance(), "sensor string, importance double"))


NB_COLS = ["avg_value", "max_value", "sd_value"]
NB_CLASS = "CASE WHEN n_events < 2 THEN 'single' WHEN n_events < 4 THEN 'few' ELSE 'many' END"
NB_STATS = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + 1e-9 AS v_{c}" for c in NB_COLS)
NB_JOINT = " + ".join(f"(-0.5 * ln(2 * pi() * v_{c}) - ({c} - m_{c}) ** 2 / (2 * v_{c}))" for c in NB_COLS)
NB_INNER = ", ".join(f"avg({c}) OVER () AS a_{c}, stddev_pop({c}) OVER () AS s_{c}" for c in NB_COLS)
NB_SCALED = ", ".join(f"({c} - a_{c}) / s_{c} AS {c}" for c in NB_COLS)


@query("gaussian_nb", f"""
WITH u AS (SELECT *, {NB_CLASS} AS target, {NB_INNER} FROM ({s.UNIT_DAYS_SQL})),
z AS (SELECT user_id, ds, target, {NB_SCALED} FROM u),
g AS (SELECT target AS cl, count(*) AS n, {NB_STATS} FROM z GROUP BY 1),
j AS (SELECT user_id, ds, target, cl, ln(n / (SELECT count(*) FROM z)) + {NB_JOINT} AS lj FROM z CROSS JOIN g)
SELECT user_id, ds, target, arg_max(cl, lj) AS y_pred, round(max(lj), 5) AS log_joint FROM j GROUP BY 1, 2, 3""")
def gaussian_nb(spark, d):
    rows = s.unit_days(spark, d).withColumn("target", F.expr(NB_CLASS))
    out = naive_bayes.GaussianNB.fit(rows, NB_COLS).transform(rows)
    return rounded(out.select(*UNIT_KEYS, "target", "y_pred", "log_joint"), 5)


BN_COLS = ["l_quantity", "l_discount", "l_tax"]
# fixed equal-width bins: exact in both engines
BN_BINNED = """SELECT least(floor((l_quantity - 1) / 10), 4)::int AS qty, least(floor(l_discount * 50 + 0.25), 4)::int AS disc,
  l_returnflag AS flag, l_linestatus AS status FROM lineitem"""


def _binned(spark, d):
    return s.table(spark, d, "lineitem").select(
        F.least(F.floor((F.col("l_quantity") - 1) / 10), F.lit(4)).cast("int").alias("qty"),
        F.least(F.floor(F.col("l_discount") * 50 + 0.25), F.lit(4)).cast("int").alias("disc"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


@query("bn_structure")
def bn_structure(spark, d):
    rows = eda.QuantileBinner.fit(s.unit_days(spark, d), s.UNIT_FEATURES).transform(s.unit_days(spark, d))
    edges = bayes_net.learn_structure(rows.select(*s.UNIT_FEATURES), s.UNIT_FEATURES)
    return spark.createDataFrame(edges, "parent string, child string")


@query("bn_bic", f"""
WITH b AS ({BN_BINNED}), n AS (SELECT count(*) AS n FROM b),
j AS (SELECT flag, qty, disc, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT *, sum(c) OVER (PARTITION BY qty, disc) AS t FROM j),
k AS (SELECT count(DISTINCT qty) * count(DISTINCT disc) AS q, count(DISTINCT flag) AS r FROM b)
SELECT 'flag' AS child, round((SELECT sum(c * ln(c / t)) FROM p) - 0.5 * ln(n) * q * (r - 1), 3) AS bic FROM n, k""")
def bn_bic(spark, d):
    scores = bayes_net.FamilyScores(_binned(spark, d), ["qty", "disc", "flag", "status"])
    return rounded(spark.createDataFrame([("flag", float(scores.family("flag", ["qty", "disc"])))],
                                         "child string, bic double"), 3)


@query("bn_cpt", f"""
WITH j AS (SELECT qty, status, flag, count(*) AS n FROM ({BN_BINNED}) GROUP BY ALL)
SELECT qty, status, flag, n, round(n / sum(n) OVER (PARTITION BY qty, status), 6) AS p FROM j""")
def bn_cpt(spark, d):
    return rounded(bayes_net.fit_cpt(_binned(spark, d), "flag", ["qty", "status"]))


@query("bn_predict", f"""
WITH b AS ({BN_BINNED}), n AS (SELECT count(*) AS n FROM b),
f AS (SELECT flag, count(*) AS c FROM b GROUP BY 1),
q AS (SELECT flag, qty, count(*) AS c FROM b GROUP BY ALL), st AS (SELECT flag, status, count(*) AS c FROM b GROUP BY ALL),
sc AS (SELECT qty, status, f.flag, ln(f.c / n) + ln(q.c / f.c) + ln(st.c / f.c) AS lj
  FROM f JOIN q ON q.flag = f.flag JOIN st ON st.flag = f.flag CROSS JOIN n),
best AS (SELECT qty, status, arg_max(flag, lj) AS y_pred FROM sc GROUP BY ALL)
SELECT qty, status, y_pred, count(*) AS n FROM b JOIN best USING (qty, status) GROUP BY ALL""")
def bn_predict(spark, d):
    rows = _binned(spark, d).select("qty", "status", "flag")
    edges = [("flag", "qty"), ("flag", "status")]
    cpts = bayes_net.fit_cpts(rows, ["qty", "status", "flag"], edges)
    out = bayes_net.bn_predict(rows, cpts, edges, "flag")
    return out.groupBy("qty", "status", "y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("bayes_net")
def bayes_net_query(spark, d):
    rows = s.unit_days(spark, d).withColumn("target", F.expr(NB_CLASS))
    out = bayes_net.BayesNet.fit(rows, NB_COLS).transform(rows)
    return metrics.confusion(out, "target", "y_pred")


@query("hmm_states")
def hmm_states(spark, d):
    rows = s.events(spark, d).select("event_id", "user_id", "ts", "event_type", "value",
                                     F.log1p("value").alias("log_value"))
    model = hidden_markov.HiddenMarkov.fit(rows, ["value", "log_value"], 3, ["ts", "event_id"], "user_id")
    return model.transform(rows).select("event_id", "state")


# --- series -------------------------------------------------------------------------------------

AR_SQL = f"""WITH y AS (SELECT ds, y, lag(y) OVER (ORDER BY ds) AS p FROM ({s.DAILY_SQL})),
c AS (SELECT regr_slope(y, p) AS b, regr_intercept(y, p) AS a FROM y WHERE p IS NOT NULL),
f AS (SELECT ds, y, a + b * p AS y_pred, y - a - b * p AS e FROM y, c WHERE p IS NOT NULL)"""


@query("arima")
def arima_query(spark, d):
    out = arima.arima_anomalies(s.user_series(spark, d), d=1, max_p=2, max_q=1, key="series_id")
    return rounded(out.select("series_id", "ds", "y", "y_pred", "is_anomaly"), 4)


@query("arima_forecast")
def arima_forecast(spark, d):
    model = arima.fit_arima(s.daily_orders(spark, d), d=1, max_p=2, max_q=2)
    return rounded(model.forecast(10), 2)


@query("ar1_anomaly", AR_SQL + """,
t AS (SELECT avg(abs(e)) + 3 * stddev_pop(abs(e)) AS t FROM f)
SELECT ds, round(y_pred, 2) AS y_pred, abs(e) > t AS is_anomaly FROM f, t""")
def ar1_anomaly(spark, d):
    found = arima.arima_anomalies(s.daily_orders(spark, d), d=0, start_p=1, max_p=1, start_q=0, max_q=0)
    return rounded(found.select("ds", "y_pred", "is_anomaly"), 2)


@query("exp_smoothing")
def exp_smoothing(spark, d):
    out = smoothing.smoothing_anomalies(s.user_series(spark, d), trend="add", key="series_id")
    return rounded(out.select("series_id", "ds", "y", "y_pred", "is_anomaly"), 4)


@query("holt_winters")
def holt_winters(spark, d):
    fit = smoothing.exp_smoothing(s.daily_orders(spark, d), trend="add", seasonal="add", seasonal_periods=7)
    return rounded(fit.rows, 2)


@query("ses", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i FROM ({s.USERS_SQL}))
SELECT a.series_id, a.ds, round(sum(CASE WHEN b.i = 0 THEN (2e0 / 3) ** (a.i - 1)
  ELSE 1e0 / 3 * (2e0 / 3) ** (a.i - 1 - b.i) END * b.y), 6)
  AS y_pred FROM r a JOIN r b ON a.series_id = b.series_id AND b.i < a.i GROUP BY 1, 2""")
def ses(spark, d):
    return rounded(smoothing.ses(s.user_series(spark, d), 1 / 3, key="series_id").select("series_id", "ds", "y_pred"))


@query("trend_season")
def trend_season_query(spark, d):
    model = trend_season.TrendSeason.fit(s.daily_orders(spark, d))
    return rounded(model.transform(s.daily_orders(spark, d)), 2)


@query("linear_trend", f"""
WITH y AS (SELECT series_id, ds, y, epoch_us(ds) / 1e6 AS t FROM ({s.USERS_SQL})),
c AS (SELECT series_id, regr_slope(y, t - 1704067200) AS b, regr_intercept(y, t - 1704067200) AS a FROM y GROUP BY 1)
SELECT series_id, ds, round(a + b * (t - 1704067200), 6) AS yhat FROM y JOIN c USING (series_id)""")
def linear_trend(spark, d):
    rows = s.user_series(spark, d)
    model = trend_season.TrendSeason.fit(rows, key="series_id", changepoints=0, seasons={})
    return rounded(model.predict(rows).select("series_id", "ds", "yhat"))


@query("ssa")
def ssa(spark, d):
    rows = s.daily_orders(spark, d)
    return rounded(windows.Ssa.fit(rows).transform(rows), 5)


@query("window_reconstruction")
def window_reconstruction(spark, d):
    rows = s.user_series(spark, d)
    return rounded(windows.WindowReconstruction.fit(rows, key="series_id").transform(rows), 5)


@query("lag_forecaster", f"""
WITH y AS (SELECT series_id, ds, y, lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS p FROM ({s.USERS_SQL})),
c AS (SELECT regr_slope(y, p) AS b, regr_intercept(y, p) AS a FROM y WHERE p IS NOT NULL),
f AS (SELECT series_id, ds, a + b * p AS y_pred, y - a - b * p AS e FROM y, c WHERE p IS NOT NULL)
SELECT series_id, ds, round(y_pred, 6) AS y_pred, round((e - avg(e) OVER ()) / stddev_pop(e) OVER (), 6) AS score,
  abs((e - avg(e) OVER ()) / stddev_pop(e) OVER ()) > 3 AS is_anomaly FROM f""")
def lag_forecaster(spark, d):
    rows = s.user_series(spark, d)
    out = windows.LagForecaster.fit(rows, lags=1, key="series_id").transform(rows)
    return rounded(out.select("series_id", "ds", "y_pred", "score", "is_anomaly"))


@query("lag_forecaster_trees")
def lag_forecaster_trees(spark, d):
    rows = s.user_series(spark, d)
    out = windows.LagForecaster.fit(rows, lags=5, learner="gbt", key="series_id").transform(rows)
    return rounded(out.select("series_id", "ds", "y_pred", "is_anomaly"), 4)
