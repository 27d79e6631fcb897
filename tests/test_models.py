"""Models against brute force, numpy, planted anomalies, and themselves in other chunkings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.functions.distributions import chi2_cdf, chi2_quantile
from lynceus.functions.moments import covariance, gram, vector_moments
from lynceus.operators import (arima, bayes_net, density, hidden_markov, isolation_forest, multivariate,
                               naive_bayes, sequences, smoothing, trees, trend_season, windows)

# --- statistics ---------------------------------------------------------------------------------


def test_chi_square():
    # fixed values: textbook quantiles
    for p, df, want in [(0.95, 1, 3.841459), (0.95, 2, 5.991465), (0.975, 4, 11.143287), (0.5, 10, 9.341818)]:
        assert abs(chi2_quantile(p, df) - want) < 1e-5
    assert chi2_cdf(1e6, 3) == 1.0 and chi2_cdf(0, 3) == 0.0


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1000, [1, 2, 3], (500, 3))
    df = spark.createDataFrame([(int(i % 7), *map(float, r)) for i, r in enumerate(x)], "k int, a double, b double, c double")
    df = df.withColumn("v", F.array("a", "b", "c")).repartition(5)
    for m in (covariance(df, ["a", "b", "c"]), vector_moments(df, "v", 3)):
        assert m.n == 500 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.cov, np.cov(x.T, bias=True))
    for r in gram(df, "v", 3, "k").collect():
        part = x[np.arange(500) % 7 == r["k"]]
        assert r["n"] == len(part) and np.allclose(np.reshape(r["gram"], (3, 3)), part.T @ part)


# --- density ------------------------------------------------------------------------------------

def _noise(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps ** 2
    core = near.sum(axis=1) >= least
    return ~(near & core[None]).any(axis=1)


@pytest.mark.parametrize("p,leaf", [(1, 64), (2, 3), (3, 3), (5, 2)])
def test_noise_matches_brute_force(spark, monkeypatch, p, leaf):
    monkeypatch.setattr(density, "LEAF_POINTS", leaf)
    rng = np.random.default_rng(p)
    x = np.vstack([rng.normal(0, 0.3, (150, p)), rng.normal(3, 1.0, (120, p)), rng.uniform(-6, 9, (40, p)),
                   np.repeat(rng.normal(0, 1, (1, p)), 60, axis=0)])
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{c} double" for c in cols))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    model = density.DensityOutliers.fit(df, cols, eps=0.35, min_samples=6)
    got = {r["id"]: r["is_anomaly"] for r in model.training_flags(df).collect()}
    want = _noise(z, 0.35, 6)
    assert [got[i] for i in range(len(x))] == want.tolist()
    assert 0 < want.sum() < len(x)
    # new rows: noise when no core point of the training rows is near
    new = rng.uniform(-6, 9, (80, p))
    fresh = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(new)], df.schema)
    near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= 0.35 ** 2
    core = z[near.sum(axis=1) >= 6]
    zn = (new - x.mean(axis=0)) / x.std(axis=0)
    wanted = ~(((zn[:, None] - core[None]) ** 2).sum(axis=2) <= 0.35 ** 2).any(axis=1)
    scored = {r["id"]: r["is_anomaly"] for r in model.transform(fresh).collect()}
    assert [scored[i] for i in range(80)] == wanted.tolist()
    alone = {r["id"]: r["is_anomaly"] for r in model.transform(fresh, refit=True).collect()}
    assert [alone[i] for i in range(80)] == _noise(zn, 0.35, 6).tolist()


# --- planted outliers ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([10, -5, 0], [[2, 1, 0], [1, 2, 0], [0, 0, 1]], 950)
    x = np.vstack([x, rng.normal([30, 20, 15], 0.5, (50, 3))])
    data = [(i, *map(float, r), int(i >= 950)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id int, a double, b double, c double, target int").repartition(4).cache()


def _hits(out):
    return {r["id"] for r in out.filter("is_anomaly").collect()}


def test_envelope_finds_planted_outliers(planted):
    model = multivariate.EllipticEnvelope.fit(planted, ["a", "b", "c"], contamination=0.05)
    assert _hits(model.transform(planted)) == set(range(950, 1000))
    # the outliers do not pull the centre: it is that of the clean rows
    clean = np.array(planted.filter("target = 0").select("a", "b", "c").collect(), float)
    mean = model.mean * np.array(list(model.scaler.sigma.values())) + np.array(list(model.scaler.mean.values()))
    assert np.allclose(mean, clean.mean(axis=0), atol=0.2)
    with pytest.raises(ValueError):
        multivariate.EllipticEnvelope.fit(planted, ["a"], contamination=0.5)


@pytest.mark.parametrize("key", [None, "id"])
def test_forest_ranks_planted_outliers_first(planted, key):
    model = isolation_forest.IsolationForest.fit(planted, ["a", "b", "c"], row_key=key, contamination=0.05)
    assert len(_hits(model.transform(planted)) & set(range(950, 1000))) >= 45
    again = isolation_forest.IsolationForest.fit(planted.repartition(9), ["a", "b", "c"], row_key=key, contamination=0.05)
    assert np.array_equal(model.cut, again.cut) and abs(model.threshold - again.threshold) < 1e-12
    codes = {r[0] for r in model.transform(planted).select("label").distinct().collect()}
    assert codes == {-1, 1}


def test_forest_draws_copies_in_proportion(spark):
    # a third of the rows are copies of one row
    data = [(0.0, 0.0)] * 2000 + [(float(i), float(i % 17)) for i in range(4000)]
    df = spark.createDataFrame(data, "a double, b double")
    model = isolation_forest.IsolationForest.fit(df, ["a", "b"], n_trees=20)
    scores = model.transform(df)
    assert scores.filter("a = 0 and b = 0").first()["score"] < scores.agg(F.max("score")).first()[0]


def test_pca_limits_and_residual(planted):
    cols = ["a", "b", "c"]
    model = multivariate.PcaMonitor.fit(planted, cols, n_components=2)
    x = np.array(planted.select(*cols).orderBy("id").collect(), float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    top = vectors[:, ::-1][:, :2]
    t = z @ top
    out = np.array(model.transform(planted).orderBy("id").select("t2", "spe").collect(), float)
    assert np.allclose(out[:, 0], (t ** 2 / values[::-1][:2]).sum(axis=1))
    assert np.allclose(out[:, 1], ((z - t @ top.T) ** 2).sum(axis=1))
    assert multivariate.PcaMonitor.fit(planted, cols, n_components=0.95).k <= 3
    assert abs(sum(r[2] for r in model.explained_variance()) - 1) < 1e-12


def test_wide_and_narrow_plans_agree(planted, monkeypatch):
    cols = ["a", "b", "c"]

    def results():
        model = multivariate.PcaMonitor.fit(planted, cols, n_components=2)
        pca = model.transform(planted).orderBy("id").select("t2", "spe").collect()
        far = multivariate.mahalanobis(planted, cols).orderBy("id").select("score").collect()
        return np.array(pca, float), np.array(far, float)

    narrow = results()
    monkeypatch.setattr(multivariate, "NARROW", 2)
    monkeypatch.setattr("lynceus.functions.moments.NARROW", 2)
    for a, b in zip(narrow, results()):
        assert np.allclose(a, b)
    holes = planted.withColumn("a", F.when(F.col("id") > 10, F.col("a")))
    model = multivariate.PcaMonitor.fit(holes, cols, n_components=2)
    assert model.transform(holes).filter("t2 is null").count() == 11


# --- isolation ----------------------------------------------------------------------------------

def test_classifiers_learn_planted_states(planted):
    for fit in (trees.fit_tree, trees.fit_forest, naive_bayes.GaussianNB.fit):
        out = fit(planted, ["a", "b", "c"], "target").transform(planted)
        wrong = out.filter(F.col("target").cast("string") != F.col("y_pred").cast("string")).count()
        assert wrong <= 2
    assert abs(sum(v for _, v in trees.fit_tree(planted, ["a", "b"]).importance()) - 1) < 1e-9


def test_network_finds_a_chain_and_normalised_tables(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, 4000)
    b = (a + (rng.random(4000) < 0.2)) % 3
    c = (b + (rng.random(4000) < 0.2)) % 3
    d = rng.integers(0, 2, 4000)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(a, b, c, d)], "a int, b int, c int, d int")
    edges = bayes_net.learn_structure(df, ["a", "b", "c", "d"])
    assert {frozenset(e) for e in edges} == {frozenset("ab"), frozenset("bc")}
    for child, table in bayes_net.fit_cpts(df, ["a", "b", "c", "d"], edges).items():
        parents = [p for p, q in edges if q == child]
        for r in table.groupBy(*parents).agg(F.sum("p").alias("s")).collect():
            assert abs(r["s"] - 1) < 1e-12
    model = bayes_net.BayesNet.fit(df.withColumnRenamed("c", "target"), ["a", "b", "d"], bins=10)
    # quantile bins of three levels merge the lower two, so only part of the link is left
    out = model.transform(df.withColumnRenamed("c", "target"))
    assert out.filter("target = y_pred").count() / 4000 > 0.6
    whole = bayes_net.bn_predict(df, bayes_net.fit_cpts(df, ["a", "b", "c", "d"], edges), edges, "c")
    assert abs(whole.filter("c = y_pred").count() / 4000 - np.mean(b == c)) < 1e-12
    # a row without the target is scored all the same
    assert model.transform(df.drop("c")).filter("y_pred is null").count() == 0


def test_hidden_states_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(7)
    data = []
    for key in range(3):
        state = 0
        for t in range(120):
            if rng.random() < 0.05:
                state = 1 - state
            data.append((key, t, float(rng.normal(4 * state, 1)), float(rng.normal(-3 * state, 1)), f"s{state}"))
    df = spark.createDataFrame(data, "k int, t int, x double, y double, target string")
    fits = [hidden_markov.HiddenMarkov.fit(df, ["x", "y"], 2, "t", "k", n_mix=mix, n_iter=4, chunk=chunk, target="target")
            for mix in (1, 2) for chunk in (1000, 17)]
    for whole, cut in (fits[:2], fits[2:]):
        assert np.allclose(whole.history, cut.history)
        assert all(b >= a - 1e-6 for a, b in zip(whole.history, whole.history[1:]))
        assert np.allclose(whole.params.move, cut.params.move)
        assert np.allclose(whole.params.move.sum(axis=1), 1) and np.allclose(whole.params.weight.sum(axis=1), 1)
        paths = [{(r["k"], r["t"]): r["state"] for r in m.transform(df).collect()} for m in (whole, cut)]
        assert paths[0] == paths[1]
    good = fits[0].transform(df).filter("target = y_pred").count()
    assert good / len(data) > 0.97


def test_patterns_need_all_end_positions(spark):
    # a ... a b: only the second a is near enough to b
    seqs = {1: "axxxab", 2: "ab", 3: "ba"}
    data = [(s, i, c) for s, text in seqs.items() for i, c in enumerate(text)]
    df = spark.createDataFrame(data, "s int, p int, i string")
    found = {"".join(r["pattern"]): r["support"] for r in
             sequences.sequential_patterns(df, "s", "p", "i", 2 / 3, max_len=3, max_gap=1).collect()}
    assert found == {"a": 3, "b": 3, "ab": 2}
    only = sequences.sequential_patterns(df, "s", "p", "i", 2 / 3, min_len=2, required=["b"], max_gap=1).collect()
    assert [r["pattern"] for r in only] == [["a", "b"]]


# --- series -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def season(spark):
    rng = np.random.default_rng(11)
    t = np.arange(140)
    data = []
    for key in (1, 2):
        y = 50 * key + 0.3 * t + 8 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, 140)
        y[100] += 40
        data += [(key, int(i), float(v)) for i, v in zip(t, y)]
    df = spark.createDataFrame(data, "series_id int, i int, y double")
    return df.select("series_id", F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 86400).alias("ds"), "i", "y").cache()


@pytest.mark.parametrize("trend,seasonal", [(None, None), ("add", None), ("mul", None), ("add", "add"), ("add", "mul"), ("mul", "mul")])
@pytest.mark.parametrize("key", ["series_id"])
def test_smoothing_does_not_depend_on_chunks(season, trend, seasonal, key):
    fits = [smoothing.exp_smoothing(season, trend, seasonal, 7, key=key, step=0.3, chunk=chunk) for chunk in (1000, 40)]
    a, b = ({(r["series_id"], r["ds"]): r["y_pred"] for r in f.rows.collect()} for f in fits)
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-7
    p, q = (f.params.orderBy("series_id").collect() for f in fits)
    for x, y in zip(p, q):
        assert (x["alpha"], x["beta"], x["gamma"]) == (y["alpha"], y["beta"], y["gamma"])
        assert np.allclose(x["state"], y["state"])


def test_single_series_in_chunks(season):
    one = season.filter("series_id = 1").drop("series_id")
    a, b = (sorted(map(tuple, smoothing.ses(one, 0.3, chunk=c).select("ds", F.round("y_pred", 8)).collect())) for c in (1000, 20))
    assert a == b and len(a) == 139


def test_seasonal_smoothing_forecasts_the_season(season):
    fit = smoothing.exp_smoothing(season.filter("i < 98"), "add", "add", 7, key="series_id")
    ahead = {(r["series_id"], r["step"]): r["y_pred"] for r in fit.forecast(14).collect()}
    for key in (1, 2):
        truth = [50 * key + 0.3 * t + 8 * np.sin(2 * np.pi * t / 7) for t in range(98, 112)]
        assert max(abs(ahead[key, i + 1] - v) for i, v in enumerate(truth)) < 5
    new = fit.transform(season.filter("i >= 98 and i < 112"))
    assert {(r["series_id"], r["i"]) for r in new.filter("is_anomaly").collect()} >= {(1, 100), (2, 100)}


def test_arima_recovers_an_autoregression(spark):
    rng = np.random.default_rng(13)
    e, y = rng.normal(0, 1, 3000), np.zeros(3000)
    for t in range(2, 3000):
        y[t] = 2 + 0.6 * y[t - 1] - 0.3 * y[t - 2] + e[t]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "ds int, y double")
    fit = arima.fit_arima(df, d=0, max_p=3, max_q=1)
    best = fit.model.first()
    assert np.allclose(best["coef"][:3], [2, 0.6, -0.3], atol=0.12) or best["q"] > 0
    assert abs(best["sse"] / best["n"] - 1) < 0.1
    long_run = 2 / (1 - 0.6 + 0.3)
    assert abs(fit.forecast(200).orderBy(F.col("step").desc()).first()["y_pred"] - long_run) < 0.3


@pytest.mark.parametrize("d", [1, 2])
def test_arima_forecast_continues_a_polynomial(spark, d):
    y = [3.0 + 2 * t + (0.5 * t * t if d == 2 else 0) for t in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "ds int, y double")
    fit = arima.fit_arima(df, d=d, max_p=0, max_q=0)
    got = [r["y_pred"] for r in fit.forecast(5).orderBy("step").collect()]
    want = [3.0 + 2 * t + (0.5 * t * t if d == 2 else 0) for t in range(60, 65)]
    assert np.allclose(got, want)
    assert np.allclose([r["error"] for r in fit.fitted().collect()], 0, atol=1e-8)


def test_trend_and_season_fit(season):
    model = trend_season.TrendSeason.fit(season, "series_id", changepoints=5)
    assert set(model.seasons) == {"weekly"}
    out = model.transform(season)
    assert {(r["series_id"], r["i"]) for r in out.filter("is_anomaly").collect()} == {(1, 100), (2, 100)}
    assert model.horizon(season, 7).count() == 14


def _ssa_numpy(y, L, f_bound, contribution):
    z = (y - y.mean()) / y.std()
    x = np.lib.stride_tricks.sliding_window_view(z, L)
    stack = windows.group_projections(x.T @ x, f_bound, contribution)
    out = np.zeros((3, len(z)))
    for g in range(3):
        total, n = np.zeros(len(z)), np.zeros(len(z))
        for i, row in enumerate(x @ stack[g]):
            total[i:i + L] += row
            n[i:i + L] += 1
        out[g] = total / n
    return out, z


@pytest.mark.parametrize("key", [None, "series_id"])
def test_ssa_matches_diagonal_averaging(season, small_tasks, key):
    for rows in (10_000, 30):
        small_tasks(rows)
        df = season if key else season.filter("series_id = 1")
        out = windows.Ssa.fit(df, 10, 0.15, 0.9, key=key).transform(df)
        for one in (1, 2) if key else (1,):
            found = out.filter(F.col("series_id") == one).orderBy("ds").select("y", *windows.GROUPS).collect()
            y = np.array([r["y"] for r in found])
            want, z = _ssa_numpy(y, 10, 0.15, 0.9)
            got = np.array([[r[g] for g in windows.GROUPS] for r in found]).T
            assert np.allclose(got, want)
            assert np.allclose(got.sum(axis=0), z)


def test_reconstruction_matches_numpy_and_flags_the_spike(season):
    model = windows.WindowReconstruction.fit(season, 10, 4, key="series_id")
    out = model.transform(season)
    for one in (1, 2):
        found = out.filter(F.col("series_id") == one).orderBy("ds").collect()
        y = np.array([r["y"] for r in found])
        x = np.lib.stride_tricks.sliding_window_view((y - y.mean()) / y.std(), 10)
        loss = np.abs(x - x @ model.projection).mean(axis=1)
        want = [loss[max(0, i - 9):i + 1].mean() for i in range(len(y))]
        assert np.allclose([r["score"] for r in found], want)
        train = loss[:int(140 * 0.8) - 9]
        assert np.isclose(found[0]["threshold"], train.mean() + 3 * train.std())


@pytest.mark.parametrize("learner", ["linear", "gbt"])
def test_lag_forecaster_flags_the_spike(season, learner):
    model = windows.LagForecaster.fit(season.filter("i < 98"), 7, learner, key="series_id")
    hits = {(r["series_id"], r["i"]) for r in model.transform(season.filter("i > 80")).filter("is_anomaly").collect()}
    assert {(1, 100), (2, 100)} <= hits
    with pytest.raises(ValueError, match="unknown learner"):
        windows.LagForecaster.fit(season, 7, "cells", key="series_id")


def test_markov_steps_of_many_chunks(spark):
    """All chunks together against one after the other, row by row."""
    from lynceus.functions import markov_steps as steps

    r = np.random.default_rng(3)
    lengths, s = np.array([4, 1, 7, 7, 2]), 3
    b, move = r.random((21, s)) + 0.1, r.dirichlet(np.ones(s), s)
    first, ahead, behind = np.array([True, False, True, False, False]), r.dirichlet(np.ones(s), 5), r.dirichlet(np.ones(s), 5)
    c = steps.Chunks.of(lengths)
    alpha, norm = steps.forward(c, b, move, first[c.place], ahead[c.place])
    beta = steps.backward(c, b, move, behind[c.place])
    through = steps.transfers(c, b, move, first[c.place])
    log_b, log_move = np.log(b), np.log(move)
    last = np.array([-1, 2, -1, 0, 1])
    path = steps.best_paths(c, log_b, log_move, first[c.place], np.log(ahead)[c.place], last[c.place])
    scores = steps.best_transfers(c, log_b, log_move, first[c.place])
    for k, (a, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
        message, total, score, came = ahead[k], np.eye(s), np.log(ahead[k]), []
        for t in range(n):
            step = np.eye(s) if first[k] and t == 0 else move
            message = message @ step * b[a + t]
            assert np.allclose(alpha[a + t], message / message.sum()) and np.isclose(norm[a + t], message.sum())
            message, total = message / message.sum(), total @ step * b[a + t]
            options = score[:, None] + np.log(step + 1e-300)
            came.append(options.argmax(axis=0))
            score = options.max(axis=0) + log_b[a + t]
        assert np.allclose(through[list(c.place).index(k)], total / total.sum())
        assert np.allclose((np.log(ahead[k])[:, None] + scores[list(c.place).index(k)]).max(axis=0), score)
        state = score.argmax() if last[k] < 0 else last[k]
        for t in range(n - 1, -1, -1):
            assert path[a + t] == state
            state = came[t][state]
        back = behind[k] / behind[k].sum()
        for t in range(n - 1, -1, -1):
            assert np.allclose(beta[a + t], back)
            back = move @ (b[a + t] * back)
            back = back / back.sum()


def test_squared_em_climbs_faster_and_never_falls():
    """A slow linear map: the longer steps need a fraction of the rounds, and a worse one is taken back."""
    like = hidden_markov.Parameters(np.array([1.0]), np.array([[1.0]]), np.array([[1.0]]), np.zeros((1, 1, 2)), np.ones((1, 1, 2)))
    rates, goal, rounds = np.array([0.97, 0.6]), np.array([3.0, -2.0]), []

    def round_of(p):
        rounds.append(1)
        mean = p.mean[0, 0]
        return hidden_markov.Parameters(p.start, p.move, p.weight, (goal + rates * (mean - goal)).reshape(1, 1, 2), p.var), -1e3 - ((mean - goal) ** 2).sum()

    best, kept = hidden_markov.squared_em(round_of, like, 1000, 1e-9)
    assert all(b >= a for a, b in zip(kept, kept[1:])) and np.abs(best.mean[0, 0] - goal).max() < 0.01 and len(rounds) < 60
    plain, n = like, 0
    while np.abs(plain.mean[0, 0] - goal).max() >= 0.01:
        plain, n = round_of(plain)[0], n + 1
    assert n > 3 * (len(rounds) - n)


def test_hidden_states_pack_equal_vectors_once(spark):
    """Blocks hold distinct vectors and a code a row, and keys of cut sequences only; their statistics are those of plain sums over paths."""
    from itertools import product

    values = [(0.0, 1.0), (2.0, -1.0), (5.0, 0.5)]
    data = [(k, t, *values[(t * t + n) % 3]) for k, n in ((1, 40), (2, 7), (None, 9), (3, 10)) for t in range(n)]
    df = spark.createDataFrame(data, "k int, t int, x double, y double")
    fit = hidden_markov.HiddenMarkov.fit(df, ["x", "y"], 2, "t", "k", n_mix=2, n_iter=2, chunk=10)
    rows, split = fit._chunks(df, ["k"])
    blocks = hidden_markov._blocks(rows, ["k"], 10, 1000, 2).collect()
    assert split and sum(len(b["_codes"]) for b in blocks) == 4 * len(data)
    assert all(len(b["_vectors"]) <= 3 * 2 * 8 for b in blocks)
    # the four chunks of the long sequence, and one that may go on
    assert sorted((c["k"], c["_i"]) for b in blocks for c in b["_cut"]) == [(1, 0), (1, 10), (1, 20), (1, 30), (3, 0)]

    r = np.random.default_rng(5)
    s, m, x, codes, n = 2, 2, r.normal(size=(2, 2)), np.array([0, 1, 0, 1, 1]), 5
    p = hidden_markov.Parameters(r.dirichlet(np.ones(s)), r.dirichlet(np.ones(s), s), r.dirichlet(np.ones(m), s), r.normal(size=(s, m, 2)), r.random((s, m, 2)) + 0.5)
    got = hidden_markov.expectations(p, x, codes, np.array([n]), np.array([True]), p.start[None], np.full((1, s), 1 / s))
    density = p.weight * np.exp(-0.5 * ((x[codes][:, None, None] - p.mean) ** 2 / p.var + np.log(2 * np.pi * p.var)).sum(axis=3))
    want = np.zeros(s + s * s + s * m * 5)
    total = 0.0
    for path in product(range(s * m), repeat=n):
        state, part = [v // m for v in path], [v % m for v in path]
        chance = p.start[state[0]] * np.prod([p.move[a, b] for a, b in zip(state, state[1:])]) * np.prod(density[range(n), state, part])
        start, xi, post, sx, sxx = np.zeros(s), np.zeros((s, s)), np.zeros((s, m)), np.zeros((s, m, 2)), np.zeros((s, m, 2))
        start[state[0]] = 1
        np.add.at(xi, (state[:-1], state[1:]), 1)
        for at, v in ((post, 1.0), (sx, x[codes]), (sxx, x[codes] ** 2)):
            np.add.at(at, (state, part), v)
        want += chance * np.concatenate([a.ravel() for a in (start, xi, post, sx, sxx)])
        total += chance
    assert np.allclose(got[:-1], want / total) and np.isclose(got[-1], np.log(total))
