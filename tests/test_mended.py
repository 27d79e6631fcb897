"""Running limits on large offsets, series with nulls, rules of any length, null inputs, and names of shipped configurations."""

import json
import random
from itertools import combinations, product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import arima, hidden_markov, itemsets, shaping, smoothing, top_rules, trees, windows
from lynceus.operators.ordering import over_order
from lynceus.plans import experiment, registry
from lynceus.plans.params import translate
from lynceus.session import durable, held_bytes, scoped_steps, work_folder
from lynceus.streaming import sigma_monitor


def test_running_sigma_on_a_large_offset(spark):
    rows = [("a", i // 250, i, 1e9 + i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, batch_no int, i long, y double")
    out = sigma_monitor.batch_sigma(df, "k").collect()
    assert not any(r["is_anomaly"] for r in out)
    for r in out:
        if r["batch_no"]:
            before = np.array([y for _, b, _, y in rows if b < r["batch_no"]])
            assert r["sigma"] == pytest.approx(before.std(), rel=1e-6) and r["mean"] == pytest.approx(before.mean(), rel=1e-15)
    parts = sigma_monitor.partial_moments(df, ["k", "batch_no"], "y").drop("batch_no")
    merged = sigma_monitor.merge_moments(parts, ["k"]).first()
    assert merged["m2"] == pytest.approx(np.var([r[3] for r in rows]) * 1000, rel=1e-6) and merged["n"] == 1000


def _ssa_by_hand(z, L, f_bound, contribution):
    """Reconstruction from complete windows only, for a list with None."""
    z = np.array([np.nan if v is None else v for v in z], float)
    starts = [i for i in range(len(z) - L + 1) if not np.isnan(z[i:i + L]).any()]
    x = np.stack([z[i:i + L] for i in starts])
    projections = windows.group_projections(x.T @ x, f_bound, contribution)
    total, count = np.zeros((3, len(z))), np.zeros(len(z))
    for i in starts:
        total[:, i:i + L] += projections @ z[i:i + L]
        count[i:i + L] += 1
    return np.where(count > 0, total / np.maximum(count, 1), np.nan).T


@pytest.mark.parametrize("key", [None, "k"])
def test_ssa_next_to_nulls(spark, key):
    y = [float(np.sin(i / 3) + i / 40) for i in range(90)]
    for hole in (0, 17, 44, 45, 89):
        y[hole] = None
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "k string, ds long, y double")
    model = windows.Ssa.fit(df, window=6, key=key)
    out = model.transform(df).orderBy("ds").collect()
    known = np.array([v for v in y if v is not None])
    stats = model.scale.first().asDict()
    sd = next(v for n, v in stats.items() if n != "k" and v is not None and abs(v - known.std()) < abs(known.std()) * 0.02)
    want = _ssa_by_hand([None if v is None else (v - known.mean()) / sd for v in y], 6, model.f_bound, model.contribution)
    got = np.array([[np.nan if r[g] is None else r[g] for g in windows.GROUPS] for r in out], float)
    assert np.allclose(got, want, atol=1e-6, equal_nan=True)
    assert all(np.isnan(got[i]).all() for i in (17, 44, 45)) and not np.isnan(got[18:44]).any()


def test_rules_of_long_itemsets(spark):
    r = random.Random(2)
    items = [f"i{n:02d}" for n in range(14)]
    baskets = [items] * 30 + [r.sample(items, 5) for _ in range(20)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    sets = itemsets.frequent_itemsets(df, "items", 0.9)
    assert itemsets.association_rules(sets, 0.99).count() == 0
    sets = spark.createDataFrame([(items, 30)] + [(sorted(set(items) - {x}), 30) for x in items], "items array<string>, support long")
    assert {r["confidence"] for r in itemsets.association_rules(sets, 0.99).collect()} == {1.0}


def test_rules_against_all_subsets(spark):
    r = random.Random(4)
    baskets = [[x for x in "abcdef" if r.random() < 0.6] for _ in range(60)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    sets = itemsets.frequent_itemsets(df, "items", 0.05)
    support = {tuple(r["items"]): r["support"] for r in sets.collect()}
    want = {(a, tuple(x for x in s if x not in a)) for s in support for n in range(1, len(s)) for a in combinations(s, n)
            if support[s] / support[a] >= 0.5}
    got = itemsets.association_rules(sets, 0.5).collect()
    assert {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in got} == want and len(got) == len(want)
    best = top_rules.best_rules(df, "items", 25, 0.5).collect()
    assert len(best) == min(25, len(want))
    assert [r["support"] for r in best] == sorted((support[tuple(sorted(a + c))] for a, c in want), reverse=True)[:25]


def test_trees_keep_rows_with_nulls(spark):
    rows = [(float(i % 10), float(i % 7), str(int(i % 10 > 4))) for i in range(200)] + [(None, 1.0, "0"), (2.0, None, "0")]
    df = spark.createDataFrame(rows, "a double, b double, target string")
    model = trees.fit_tree(df, ["a", "b"], grid={"maxDepth": [3]})
    out = model.transform(df).collect()
    assert len(out) == 202 and sum(r["y_pred"] is None for r in out) == 2
    assert all(r["y_pred"] == r["target"] for r in out if r["y_pred"] is not None)
    assert len(trees.TREE_GRID["maxDepth"]) * 6 == 48 and trees.FOLDS == 5


def test_hidden_states_keep_rows_with_nulls(spark):
    rows = [(i, float(i // 25 % 2) * 5 + (i % 3) / 10) for i in range(200)] + [(200, None), (201, float("nan"))]
    df = spark.createDataFrame(rows, "t long, x double")
    model = hidden_markov.HiddenMarkov.fit(df, ["x"], 2, "t", n_mix=1)
    out = model.transform(df).collect()
    assert len(out) == 202 and sorted(r["t"] for r in out if r["state"] is None) == [200, 201]


def test_forecasts_are_as_long_as_the_new_rows(spark):
    long, short = [("a", i, float(i % 5)) for i in range(60)], [("b", i, float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(long + short, "k string, ds long, y double")
    new = spark.createDataFrame([("a", 60 + i, 1.0) for i in range(40)] + [("b", 60, 1.0)], "k string, ds long, y double")
    for fit in (arima.fit_arima(df, d=0, max_p=2, max_q=0, key="k"), smoothing.exp_smoothing(df, trend="add", key="k", step=0.3)):
        steps = new.groupBy("k").agg(F.count("*").alias("periods"))
        assert fit.forecast(steps).count() == 41
        whole = {(r["k"], r["step"]): r["y_pred"] for r in fit.forecast(40).collect()}
        scored = fit.transform(new).collect()
        assert len(scored) == 41 and all(r["y_pred"] == pytest.approx(whole[r["k"], r["ds"] - 59]) for r in scored)


def test_automatic_differences(spark):
    r = np.random.default_rng(1)
    noise = r.normal(size=400)
    for d, y in ((0, noise), (1, np.cumsum(noise)), (2, np.cumsum(np.cumsum(noise)))):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "ds long, y double")
        assert arima.fit_arima(df, d=None, max_p=1, max_q=0).d == d


#: Model and parameters of the shipped configurations.
SHIPPED = [
    ("isolation", "dt", None), ("isolation", "rf", None), ("isolation", "nb", None), ("isolation", "bn", None), ("isolation", "mc", None),
    ("isolation", "hmm", {"n_iter": 1000, "covariance_type": "diag", "n_mix": 10}),
    ("detection", "dbscan", {"eps": 2, "min_samples": None}), ("detection", "ee", {"contamination": 0.1}), ("detection", "pca", None),
    ("detection", "iforest", {"n_estimators": 100, "contamination": "auto", "random_state": 0}),
    ("series", "prophet", {"periods": 0, "factor": 1.0, "forecast_window": 100}),
    ("series", "lstm", {"cell_no": 100}), ("series", "lstm", None),
    ("series", "ae", {"layer_no": 6, "window": 250, "epoch_no": 10, "batch_size": 64, "shuffle": False, "threshold_for_anomaly": 3,
                      "neuron_no_enc": [30, 25, 20, 15, 10, 5], "neuron_no_dec": [5, 10, 15, 20, 25, 30], "act_enc": "relu", "act_dec": "relu"}),
    ("series", "arima", {"start_p": 10, "d": None, "start_q": 10, "max_p": 100, "max_q": 100, "seasonal": False, "threshold_for_anomaly": 3}),
    ("series", "es", {"trend": "mul", "seasonal": None, "seasonal_periods": None, "threshold_for_anomaly": 2.5, "freq": None}),
    ("series", "ssa", {"window_size": 10, "lower_frequency_bound": 0.05, "lower_frequency_contribution": 0.975, "threshold": 3}),
    ("mining", "apriori", {"minsup": "10%", "min_conf": "10%"}), ("mining", "topk", {"k": 10, "minconf_ar": 0.8}),
    ("mining", "cmspam", {"minsup": "50%", "min_len": 1, "max_len": 10, "req_items": [], "max_gap": 3}), ("mining", "heuristics", {"mac": 10}),
]


@pytest.mark.parametrize("family, model, params", SHIPPED)
def test_shipped_parameters_are_understood(monkeypatch, family, model, params):
    """Every name reaches the fit; only what a fit can't be asked is refused."""
    seen = {}
    fit = registry.MODELS[family][model]
    names = dict(zip(fit.__code__.co_freevars, (c.cell_contents for c in fit.__closure__)))
    seen = translate(family, model, params, names["known"])
    assert set(seen) <= names["known"]
    with pytest.raises(ValueError, match="nonsense"):
        translate(family, model, {"nonsense": 1}, names["known"])


def test_size_in_memory(spark):
    small = held_bytes(spark.range(1000))
    wide = held_bytes(spark.range(1000).withColumn("a", F.array_repeat(F.lit(1.5), 200)))
    assert small < 100_000 and wide > 600_000


def test_column_oriented_bodies_and_predict_window(spark, tmp_path):
    body = [{"ds": {str(i): 1_600_000_000_000 + 3_600_000 * i for i in range(40)}, "x": {str(i): float(i % 9) for i in range(40)},
             "label": {str(i): int(i % 9 > 4) for i in range(40)}}]
    batch = spark.createDataFrame([(json.dumps(b),) for b in body], "body string")
    cfg = {"load_object": {"name": "isolation"}, "create_model": {"model": "nb", "params": None}}
    cfg = {**cfg, "setup": {"datetime_column": "ds", "datetime_format": "ms", "target": "label", "predict_window": 7,
                            "body": "ds long, x double, label int"}}
    cfg = {k: cfg[k] for k in ("load_object", "setup", "create_model")}
    experiment.train(spark, str(tmp_path), "columns", cfg, batch)
    found = experiment.load(spark, str(tmp_path), "columns").predict(batch)
    rows = found.orderBy("ds").collect()
    assert len(rows) == 40 and rows[-1]["x"] == 39 % 9 and all(r["y_pred"] is not None for r in rows)
    assert experiment.load(spark, str(tmp_path), "columns").predict(batch.unionByName(batch)).count() == 80
    for batch_id in (0, 1):
        experiment.predict_batch(spark, str(tmp_path), "columns", batch, batch_id)
    shown = experiment.recent_predictions(spark, str(tmp_path), "columns").orderBy("ds").collect()
    assert len(shown) == 7 and shown[-1]["ds"] == rows[-1]["ds"] == shown[-2]["ds"] and {r["batch_id"] for r in shown} == {0, 1}


def test_metrics_of_more_than_two_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "a"), ("c", "c")], "target string, y_pred string")
    found = {r["metric"]: r["value"] for r in experiment.score(df, "isolation").collect()}
    assert found["accuracy"] == 0.75 and found["recall"] == pytest.approx(2.5 / 3)


def test_tail_window_does_not_depend_on_ties(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "t int, x int")
    first = sorted(map(tuple, shaping.tail_window(df.repartition(3), "t", 10).collect()))
    monkeypatch.setattr(shaping, "TOP_K_ROWS", 1)
    assert sorted(map(tuple, shaping.tail_window(df.repartition(5), "t", 10).collect())) == first


@pytest.mark.parametrize("back, ahead", [(3, 0), (0, 5), (40, 25)])
def test_windows_over_segments_join_by_equality(spark, back, ahead):
    df = spark.createDataFrame([(i, i * i % 101) for i in range(300)], "t int, v int")
    def columns(w):
        return {"s": F.sum("v").over(w.rowsBetween(-back, ahead))}
    cut = over_order(df, "t", columns, back=back, ahead=ahead, limit=20)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, over_order(df, "t", columns).collect()))
    assert "NestedLoop" not in cut._jdf.queryExecution().toString() and "Cartesian" not in cut._jdf.queryExecution().toString()


def test_cuts_of_a_tree_are_the_trees_of_the_grid(spark):
    """Accuracies by cutting one large tree against fitting every candidate."""
    r = random.Random(6)
    rows = [(r.random(), r.random(), i % 3) for i in range(300)]
    rows = [(i, a, b, str(int((a > 0.4) + (b > 0.6) * (a < 0.8) + (r.random() < 0.1)))) for i, (a, b, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, a double, b double, target string")
    seen = {}
    inner = trees._accuracies
    def kept(prepared, learner, grid, folds, parallelism):
        seen["found"] = inner(prepared, learner, grid, folds, parallelism)
        for choice in product(grid["impurity"], grid["minInfoGain"], grid["maxDepth"]):
            params = dict(zip(("impurity", "minInfoGain", "maxDepth"), choice))
            mean = []
            for fold in range(folds):
                model = learner.copy({learner.getParam(n): v for n, v in params.items()}).fit(prepared.filter(F.col("_fold") != fold))
                held = model.transform(prepared.filter(F.col("_fold") == fold))
                mean.append(held.agg(F.avg((F.col("prediction") == F.col("_label")).cast("double"))).first()[0])
            assert seen["found"][choice[0], 1, choice[1], choice[2]] == pytest.approx(np.mean(mean))
        return seen["found"]
    trees._accuracies = kept
    try:
        trees.fit_tree(df, ["a", "b"], grid={"impurity": ["gini", "entropy"], "minInfoGain": [0.05, 0.01], "maxDepth": [2, 5]},
                       folds=2, fold_key=["id"])
    finally:
        trees._accuracies = inner
    assert len(seen["found"]) == 8


def test_forest_search(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7), str(int(i % 10 > 4))) for i in range(200)],
                               "id int, a double, b double, target string")
    model = trees.fit_forest(df, ["a", "b"], grid={"numTrees": [3, 6], "maxDepth": [1, 3]}, folds=2, fold_key=["id"])
    assert set(model.best) == {"numTrees", "maxDepth"}
    assert model.transform(df).filter("y_pred = target").count() > 190


def test_intermediate_tables_go_with_their_run(spark, tmp_path):
    here = Path(work_folder(spark).removeprefix("file:"))
    before = {p.name for p in here.iterdir()}
    with scoped_steps(spark):
        table = durable(spark.range(3))
        assert table.count() == 3 and {p.name for p in here.iterdir()} > before
    assert {p.name for p in here.iterdir()} == before
    rows = [(1_600_000_000_000 + 3_600_000 * i, float(i % 5), float(i % 3)) for i in range(60)]
    batch = spark.createDataFrame(rows, "ds long, a double, b double")
    cfg = {"load_object": {"name": "detection"}, "setup": {"datetime_column": "ds", "datetime_format": "ms"},
           "create_model": {"model": "dbscan", "params": {"eps": 2, "min_samples": None}}}
    experiment.train(spark, str(tmp_path), "steps", cfg, batch)
    assert {p.name for p in here.iterdir()} == before
    assert experiment.load(spark, str(tmp_path), "steps").predict(batch).count() == 60
