"""Experiments: registry, storage, batch prediction, retraining, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import shaping
from lynceus.plans import experiment, lifecycle, registry, store
from lynceus.streaming import scoring, sigma_monitor


@pytest.fixture(scope="module")
def plant(spark):
    rng = np.random.default_rng(17)
    data = []
    for i in range(400):
        state = int(rng.random() < 0.4)
        data.append((1514764800000 + i * 3_600_000, float(rng.normal(5 * state, 1)), float(rng.normal(-3 * state, 1)), state))
    return spark.createDataFrame(data, "time long, Ia double, Vc double, label int").repartition(3).cache()


ISOLATION = {
    "load_object": {"module": "isolation", "name": "FaultIsolationExperiment"},
    "setup": {"datetime_column": "time", "datetime_format": "ms", "target": "label", "predict_window": 100,
              "retrain": {"retrain_window": 300, "metric": "Accuracy", "metric_threshold": 1.01, "higher_better": True}},
    "eda": {}, "spc": {},
    "create_model": {"model": "nb", "params": {}},
}


def test_registry_lists_the_valid_names():
    assert set(registry.MODELS["detection"]) >= {"dbscan", "ee", "iforest", "pca"}
    assert set(registry.MODELS["isolation"]) >= {"dt", "rf", "nb", "bn", "hmm", "mc"}
    assert set(registry.MODELS["series"]) >= {"ae", "lstm", "prophet", "ssa", "arima", "es"}
    assert set(registry.MODELS["mining"]) >= {"apriori", "cmspam", "topk", "heuristics"}
    with pytest.raises(ValueError, match="known.*dbscan"):
        registry.get("detection", "nope")
    with pytest.raises(ValueError, match="known"):
        registry.get("nope", "dbscan")
    with pytest.raises(ValueError, match="unknown experiment"):
        experiment.Experiment({"load_object": {"name": "Nope"}}).family


def test_steps_run_in_order_and_unknown_ones_fail(plant):
    seen = []
    experiment.register_step("note")(lambda exp: seen.append(exp.layout is not None))
    cfg = {"load_object": ISOLATION["load_object"], "note": {}, "setup": ISOLATION["setup"]}
    experiment.Experiment(cfg).run(plant)
    assert seen == [False]
    with pytest.raises(ValueError, match="unknown step"):
        experiment.Experiment({**cfg, "nope": {}}).run(plant)


@pytest.mark.parametrize("name,params", [
    ("dt", {"grid": {"maxDepth": [3]}}), ("rf", {"grid": {"numTrees": [5]}}), ("nb", {}), ("bn", {"bins": 4}), ("hmm", {"n_iter": 3}), ("mc", {})])
def test_isolation_models_survive_storage(spark, plant, tmp_path, name, params):
    cfg = {**ISOLATION, "create_model": {"model": name, "params": params}}
    cfg.pop("eda"), cfg.pop("spc")
    root = str(tmp_path)
    exp = experiment.Experiment(cfg).run(plant)
    experiment.train(spark, root, "circuit", cfg, plant)
    loaded = experiment.load(spark, root, "circuit")
    a, b = (sorted(map(str, m.predict(plant).select("ds", "y_pred").collect())) for m in (exp, loaded))
    assert a == b and len(a) == 400
    assert set(store.list_reports(spark, root, "circuit")) >= {"training", "confusion"}


@pytest.mark.parametrize("name,params", [
    ("dbscan", {"eps": 0.5}), ("ee", {}), ("iforest", {"n_trees": 10}), ("pca", {})])
def test_detection_models_survive_storage(spark, plant, tmp_path, name, params):
    cfg = {"load_object": {"name": "FaultDetectionExperiment"}, "setup": {"features": ["Ia", "Vc"]},
           "create_model": {"model": name, "params": params}}
    root = str(tmp_path)
    exp = experiment.Experiment(cfg).run(plant)
    experiment.train(spark, root, "pump", cfg, plant)
    flag = "is_t2" if name == "pca" else "is_anomaly"
    a, b = (sorted(map(str, m.predict(plant).select("time", flag).collect()))
            for m in (exp, experiment.load(spark, root, "pump")))
    assert a == b


@pytest.mark.parametrize("name,params", [
    ("ae", {"window": 5}), ("lstm", {"lags": 2}), ("prophet", {"changepoints": 2}), ("ssa", {"window": 6}),
    ("arima", {"max_p": 1, "max_q": 1}), ("es", {"trend": "add", "step": 0.3})])
def test_series_models_survive_storage(spark, plant, tmp_path, name, params):
    series = plant.select("time", F.col("Ia").alias("load"))
    cfg = {"load_object": {"name": "TimeSeriesAnomalyExperiment"},
           "setup": {"datetime_column": "time", "datetime_format": "ms", "target": "load"},
           "create_model": {"model": name, "params": params}}
    root = str(tmp_path)
    train, new = series.filter("time < 1514764800000 + 300 * 3600000l"), series.filter("time >= 1514764800000 + 300 * 3600000l")
    exp = experiment.Experiment(cfg).run(train)
    experiment.train(spark, root, "grid", cfg, train)
    a, b = (sorted(map(str, m.predict(new).select("ds", "is_anomaly").collect()))
            for m in (exp, experiment.load(spark, root, "grid")))
    assert a == b and len(a) >= 90


@pytest.mark.parametrize("name,params,report", [
    ("apriori", {"min_support": 0.2}, "rules"), ("topk", {"min_conf": 0.2}, "rules"),
    ("cmspam", {"max_len": 2}, "patterns"), ("heuristics", {"min_count": 1}, "net")])
def test_mining_reports(spark, tmp_path, name, params, report):
    log = spark.createDataFrame([(c, i, a) for c, t in enumerate(["abcd", "abd", "acd", "abcd"]) for i, a in enumerate(t)],
                                "case int, t int, act string")
    cfg = {"load_object": {"name": "ProcessMiningExperiment"}, "setup": {"case": "case", "activity": "act", "order": "t"},
           "create_model": {"model": name, "params": params}}
    root = str(tmp_path)
    experiment.train(spark, root, "line", cfg, log)
    assert store.read_report(spark, root, "line", report).count() > 0
    with pytest.raises(ValueError, match="known"):
        store.read_report(spark, root, "line", "nope")


def test_nested_messages_are_shaped(spark):
    text = '{"tsdata": [{"target": "p", "date": "2024-01-01T00:00:00", "value": 1.0}, {"target": "q", "date": "2024-01-01T00:00:00", "value": 2.0}]}'
    setup = {"datetime_column": "date", "format": {"name": "pivot", "id": "tsdata", "columns": "target", "index": "date", "values": "value"}}
    out = experiment.shape(spark.createDataFrame([(text,)], "body string"), setup, "detection")
    assert set(out.columns) == {"ds", "p", "q"} and out.schema["ds"].dataType.simpleString() == "timestamp"


def test_stream_scores_appends_metrics_and_retrains(spark, plant, tmp_path):
    root, inbox = str(tmp_path / "store"), str(tmp_path / "in")
    cfg = {k: v for k, v in ISOLATION.items() if k not in ("eda", "spc")}
    rows = shaping.replay_batches(plant, "time", 0.4, depth=2).drop("row_idx")
    train = plant.join(rows.select("time"), "time", "left_anti")
    first = experiment.train(spark, root, "circuit", cfg, train)
    static = experiment.load(spark, root, "circuit")
    for number in range(4):
        rows.filter(F.col("batch_no") == number).drop("batch_no").coalesce(1).write.mode("append").parquet(inbox)
        source = scoring.file_stream(spark, inbox, plant.schema)
        scoring.stream_predict(spark, source, root, "circuit", str(tmp_path / "mark")).awaitTermination()
    predicted = store.read_batches(spark, root, "predictions", "circuit")
    assert predicted.count() == 160 and predicted.select("batch_id").distinct().count() == 4
    # the first batch is scored by the first run: stream equals batch
    batch = rows.filter("batch_no = 0").drop("batch_no")
    want = sorted(map(str, static.predict(batch).select("ds", "y_pred").collect()))
    assert sorted(map(str, predicted.filter("batch_id = 0").select("ds", "y_pred").collect())) == want
    history = store.read_batches(spark, root, "metrics", "circuit")
    assert history.count() == 16
    # the threshold cannot be met, so every batch causes a retrain on the trailing window
    found = store.runs(spark, root).orderBy("seq").collect()
    assert [r["after_batch"] for r in found] == [-1, 0, 1, 2, 3] and found[0]["run_id"] == first
    assert [r["n_rows"] for r in found] == [240, 280, 300, 300, 300]
    # a repeated batch changes nothing
    experiment.predict_batch(spark, root, "circuit", batch, 0)
    assert store.runs(spark, root).count() == 5
    assert sorted(map(str, store.read_batches(spark, root, "predictions", "circuit").filter("batch_id = 0")
                      .select("ds", "y_pred").collect())) == want


def test_retrain_decision(spark):
    history = spark.createDataFrame([(0, "mse", 1.0), (1, "mse", 3.0), (1, "r2", 0.2)], "batch_no int, metric string, value double")
    assert lifecycle.needs_retrain(history, "mse", 2.0) and not lifecycle.needs_retrain(history, "mse", 4.0)
    assert lifecycle.needs_retrain(history, "r2", 0.5, higher_better=True)
    assert not lifecycle.needs_retrain(history, "nope", 0.5)


def test_streamed_limits_equal_the_batch_form(spark, tmp_path):
    rng = np.random.default_rng(19)
    data = [(i, "ab"[i % 2], float(rng.normal(100 if i != 190 else 150, 3))) for i in range(200)]
    df = spark.createDataFrame(data, "i int, k string, y double").withColumn("batch_no", F.floor(F.col("i") / 50))
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for number in range(4):
        df.filter(F.col("batch_no") == number).drop("batch_no").write.mode("append").parquet(inbox)
        source = spark.readStream.schema("i int, k string, y double").parquet(inbox)
        sigma_monitor.stream_sigma(source, "k", out, mark).awaitTermination()
    streamed = sigma_monitor.judged_rows(spark, out)
    batch = sigma_monitor.batch_sigma(df, "k")
    pick = lambda t: sorted((r["i"], round(r["sigma"] or 0, 6), r["is_anomaly"]) for r in t.collect())
    assert pick(streamed) == pick(batch)
    assert [r["i"] for r in batch.filter("is_anomaly").collect()].count(190) == 1


def test_train_a_catalog(spark, plant, tmp_path):
    cfg = {"load_object": {"name": "detection"}, "setup": {"features": ["Ia", "Vc"]},
           "create_model": {"model": "pca", "params": {}}}
    done = experiment.train_all(spark, str(tmp_path), {"one": (cfg, plant), "two": (cfg, plant)}, parallelism=2)
    assert {r["experiment"]: r["run_id"] for r in store.runs(spark, str(tmp_path)).collect()} == done
