"""Configured experiments: train, predict batch by batch, retrain, look up.

A configuration is a dict whose keys are executed in order.  ``load_object``
names the family (and is not a step); ``setup`` shapes the table, ``eda`` and
``spc`` add report tables, ``create_model`` fits a model.  Further keys name
steps added with ``register_step``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.operators import eda, metrics, shaping
from lynceus.plans import lifecycle, store
from lynceus.plans.registry import Layout, get
from lynceus.session import scoped_steps
from lynceus.sources.messages import decode_columnar_json, explode_records

# Class names a configuration may use for the four families.
FAMILIES = {
    "FaultDetectionExperiment": "detection",
    "FaultIsolationExperiment": "isolation",
    "TimeSeriesAnomalyExperiment": "series",
    "TimeSeriesExperiment": "series",
    "ProcessMiningExperiment": "mining",
}

STEPS: dict[str, Callable[["Experiment"], None]] = {}


def register_step(name: str):
    def add(fn):
        STEPS[name] = fn
        return fn
    return add


@dataclass
class Experiment:
    cfg: dict
    data: DataFrame | None = None
    layout: Layout | None = None
    model: object = None
    reports: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def family(self) -> str:
        name = self.cfg.get("load_object", {}).get("name", "")
        if name in store_families():
            return store_families()[name]
        raise ValueError(f"unknown experiment {name!r}; known: {sorted(store_families())}")

    def run(self, data: DataFrame) -> Experiment:
        """Execute the configured steps in order."""
        self.data = data
        for name in self.cfg:
            if name == "load_object":
                continue
            if name not in STEPS:
                raise ValueError(f"unknown step {name!r}; known: {sorted(STEPS)}")
            STEPS[name](self)
        return self

    def shape(self, data: DataFrame) -> DataFrame:
        """Bring a batch into the layout of the experiment."""
        return shape(data, self.cfg.get("setup") or {}, self.family)

    def predict(self, data: DataFrame) -> DataFrame:
        """All scored rows of a batch; ``predict_window`` limits what ``recent_predictions`` shows, not what is scored."""
        return self.model.transform(self.shape(data))

    def score(self, predicted: DataFrame) -> DataFrame | None:
        """Metrics of one batch in long form (metric, value); none for the unsupervised families."""
        return score(predicted, self.family)


#: Sensors of a plant that are found by looking at the data, at most; more must be named.
MOST_SENSORS = 10_000


def store_families() -> dict[str, str]:
    return {**FAMILIES, **{f: f for f in FAMILIES.values()}}


def shape(data: DataFrame, setup: Mapping, family: str) -> DataFrame:
    """Format, convert the time column and project, as ``setup`` says."""
    fmt = setup.get("format")
    if fmt:
        if fmt.get("name", "pivot") != "pivot":
            raise ValueError(f"unknown data format {fmt!r}; known: pivot")
        if "body" in data.columns:
            data = explode_records(data, "body", field=fmt.get("id", "tsdata"))
        names = fmt.get("sensors")
        column, index, values = (fmt.get(k, v) for k, v in (("columns", "target"), ("index", "date"),
                                                            ("values", "value")))
        if not names:
            names = sorted(r[0] for r in data.select(column).distinct().limit(MOST_SENSORS + 1).collect())
            if len(names) > MOST_SENSORS:
                raise ValueError(f"column {column} has more than {MOST_SENSORS} names: it doesn't name sensors; give format.sensors")
        data = shaping.pivot_sensors(data, index, column, values, names, agg=fmt.get("agg", "strict"))
    elif "body" in data.columns and setup.get("body"):
        # column-oriented JSON, one message per row; ``body`` declares the columns
        message = [c for c in data.columns if c != "body"]
        if not message:
            # equal bodies are two messages
            message, data = ["_message"], data.withColumn("_message", F.monotonically_increasing_id())
        schema = T.StructType.fromDDL(setup["body"])
        data = decode_columnar_json(data, "body", schema, message).select(*[f.name for f in schema.fields])
    ds = setup.get("datetime_column")
    if ds:
        data = shaping.normalize_ts(data, ds, setup.get("datetime_format"))
        if ds != "ds" and family != "mining":
            data = data.withColumnRenamed(ds, "ds")
    target = setup.get("target")
    if family == "series" and target and target != "y":
        data = data.withColumnRenamed(target, "y")
    if family == "isolation" and target and target != "target" and target in data.columns:
        data = data.withColumnRenamed(target, "target")
    return data


def find_layout(data: DataFrame, setup: Mapping, family: str) -> Layout:
    key = shaping.as_list(setup.get("key"))
    order = shaping.as_list(setup.get("order")) or (["ds"] if "ds" in data.columns else [])
    if family == "mining":
        case, activity = setup.get("case", "case:concept:name"), setup.get("activity", "concept:name")
        shaping.require_columns(data, [case, activity])
        return Layout(family, [], shaping.as_list(setup.get("order", "start:timestamp")), [], None, case, activity)
    target = {"isolation": "target", "series": "y"}.get(family)
    if target:
        shaping.require_columns(data, [target])
    if family == "series":
        shaping.require_columns(data, ["ds"])
    roles = {"ds", target, *key, *order}
    features = list(setup.get("features") or [f.name for f in data.schema.fields
                                              if isinstance(f.dataType, T.NumericType) and f.name not in roles])
    return Layout(family, features, order, key, target)


@register_step("setup")
def _setup(exp: Experiment) -> None:
    setup = exp.cfg.get("setup") or {}
    exp.data = exp.shape(exp.data)
    exp.layout = find_layout(exp.data, setup, exp.family)


@register_step("eda")
def _eda(exp: Experiment) -> None:
    columns = [f.name for f in exp.data.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))]
    numeric = [c for c in columns if isinstance(exp.data.schema[c].dataType, T.NumericType)]
    exp.reports["eda_histograms"] = eda.histograms(exp.data, columns)
    exp.reports["eda_missing_values"] = eda.missing_counts(exp.data)
    if numeric:
        exp.reports["eda_correlation_matrix"] = eda.correlation_matrix(exp.data, numeric)


@register_step("spc")
def _spc(exp: Experiment) -> None:
    columns = exp.layout.features or [exp.layout.target]
    for c in columns:
        exp.reports[f"spc_{c}"] = eda.spc_zones(exp.data, c, by=exp.layout.key)


@register_step("create_model")
def _create_model(exp: Experiment) -> None:
    options = exp.cfg.get("create_model") or {}
    if exp.layout is None:
        raise ValueError("create_model needs the setup step before it")
    fitted = get(exp.family, options["model"])(exp.data, exp.layout, dict(options.get("params") or {}))
    if isinstance(fitted, dict):
        exp.reports.update(fitted)
        return
    exp.model = fitted
    if hasattr(fitted, "horizon"):
        given = options.get("params") or {}
        ahead = int(given.get("forecast_window") or given.get("periods") or 0)
        if ahead:
            exp.reports["forecast"] = fitted.horizon(exp.data, ahead)
    scored = fitted.transform(exp.data)
    exp.reports["training"] = scored
    if "is_anomaly" in scored.columns:
        exp.reports["anomaly_counts"] = eda.anomaly_counts(scored)
    if exp.family == "isolation":
        exp.reports["confusion"] = metrics.confusion(scored, "target", "y_pred")


def score(predicted: DataFrame, family: str) -> DataFrame | None:
    if family == "isolation":
        same = predicted.select(F.col("target").cast("string").alias("target"),
                                F.col("y_pred").cast("string").alias("y_pred"))
        labels = same.select(F.explode(F.array("target", "y_pred")).alias("label")).filter("label IS NOT NULL").distinct().limit(3).collect()
        # 1 is the positive class of two; of other labels every class counts alike
        wide = (metrics.classification_metrics(same, positive="1") if {r["label"] for r in labels} <= {"0", "1"}
                else metrics.macro_metrics(same))
        return wide.unpivot([], lifecycle.CLASSIFICATION, "metric", "value")
    if family == "series":
        guess = next((c for c in ("y_pred", "yhat") if c in predicted.columns), None)
        if guess:
            wide = metrics.regression_metrics(predicted, y_hat=guess)
            return wide.unpivot([], lifecycle.REGRESSION, "metric", "value")
    return None


# --- training and prediction against the store --------------------------------------------------

def train(spark: SparkSession, root: str, name: str, cfg: dict, data: DataFrame) -> str:
    """Run an experiment on a batch and store model, reports, training data and the run; returns the run id.

    Intermediate tables of the fit are deleted when all that is stored.
    """
    with scoped_steps(spark):
        return _train(spark, root, name, cfg, data)


def _train(spark: SparkSession, root: str, name: str, cfg: dict, data: DataFrame) -> str:
    exp = Experiment(cfg).run(data)
    run_id = uuid.uuid4().hex
    if exp.model is not None:
        store.save_model(spark, exp.model, store.model_folder(root, name, run_id))
    store.save_reports(spark, root, name, run_id, exp.reports)
    exp.data.write.mode("overwrite").parquet(training_path(root, name, run_id))
    n_rows = spark.read.parquet(training_path(root, name, run_id)).count()
    store.append_run(spark, root, name, run_id, (cfg.get("create_model") or {}).get("model", ""), cfg, n_rows)
    return run_id


def training_path(root: str, name: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/training/experiment={name}/run_id={run_id}"


def training_data(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    run_id = run_id or store.current_run(spark, root, name)["run_id"]
    return spark.read.parquet(training_path(root, name, run_id))


def load(spark: SparkSession, root: str, name: str, run_id: str | None = None,
         batch_id: int | None = None) -> Experiment:
    """The stored experiment, ready to predict (the current run by default)."""
    run = store.current_run(spark, root, name, batch_id, run_id)
    folder = store.model_folder(root, name, run["run_id"])
    model = store.load_model(spark, folder) if store.folder_exists(spark, folder) else None
    return Experiment(run["config"], model=model)


def predict_batch(spark: SparkSession, root: str, name: str, batch: DataFrame, batch_id: int) -> None:
    """Score one batch with the current run, append predictions and metrics, retrain when due.

    Every write is keyed by the batch id, and a batch is never scored by a run
    that it caused, so a repeated batch replaces itself.
    """
    with scoped_steps(spark):
        _predict_batch(spark, root, name, batch, batch_id)


def _predict_batch(spark: SparkSession, root: str, name: str, batch: DataFrame, batch_id: int) -> None:
    exp = load(spark, root, name, batch_id=batch_id)
    shaped = exp.shape(batch)
    store.write_batch(shaped, root, "new_data", name, batch_id)
    stored = spark.read.parquet(store.batch_path(root, "new_data", name, batch_id))
    store.write_batch(exp.model.transform(stored), root, "predictions", name, batch_id)
    predicted = spark.read.parquet(store.batch_path(root, "predictions", name, batch_id))
    found = exp.score(predicted)
    if found is None:
        return
    store.write_batch(found, root, "metrics", name, batch_id)
    rule = (exp.cfg.get("setup") or {}).get("retrain") or {}
    if rule.get("metric"):
        now = spark.read.parquet(store.batch_path(root, "metrics", name, batch_id))
        due = lifecycle.needs_retrain(now.withColumn("batch_no", F.lit(batch_id)), rule["metric"].lower(),
                                      rule.get("metric_threshold", 0.0), rule.get("higher_better", False))
        done = store.runs(spark, root).filter((F.col("experiment") == name) & (F.col("after_batch") == batch_id))
        if due and done.isEmpty():
            retrain(spark, root, name, batch_id)


def recent_predictions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The last ``predict_window`` scored rows over all batches of an experiment (0 or none: all), for display."""
    setup = store.current_run(spark, root, name)["config"].get("setup") or {}
    rows = store.read_batches(spark, root, "predictions", name)
    order = shaping.as_list(setup.get("order")) or ["ds"]
    n = int(setup.get("predict_window") or 0)
    return shaping.tail_window(rows, order, n) if n and set(order) <= set(rows.columns) else rows


def retrain(spark: SparkSession, root: str, name: str, after_batch: int = -1) -> str:
    """Fit again on the training rows plus all new batches, cut to the retrain window; becomes current."""
    run = store.current_run(spark, root, name)
    first = store.runs(spark, root).filter(F.col("experiment") == name).agg(
        F.min_by("run_id", "seq")).first()[0]
    cfg = run["config"]
    setup = dict(cfg.get("setup") or {})
    old = training_data(spark, root, name, first)
    new = store.read_batches(spark, root, "new_data", name).drop("batch_id")
    window = (setup.get("retrain") or {}).get("retrain_window", 0)
    order = shaping.as_list(setup.get("order")) or ["ds"]
    joined = shaping.join_history(old, new, order, window)
    # the rows are in the experiment's layout already
    done = {k: v for k, v in setup.items() if k not in ("format", "datetime_column", "datetime_format", "target")}
    exp = Experiment({**cfg, "setup": done}).run(joined)
    run_id = uuid.uuid4().hex
    store.save_model(spark, exp.model, store.model_folder(root, name, run_id))
    store.save_reports(spark, root, name, run_id, exp.reports)
    exp.data.write.mode("overwrite").parquet(training_path(root, name, run_id))
    n_rows = spark.read.parquet(training_path(root, name, run_id)).count()
    store.append_run(spark, root, name, run_id, run["model"], cfg, n_rows, after_batch)
    return run_id


def train_all(spark: SparkSession, root: str, catalog: Mapping[str, tuple[dict, DataFrame]],
              parallelism: int = 4) -> dict[str, str]:
    """Train every experiment of a catalog (name -> configuration, data); returns name -> run id."""
    with ThreadPoolExecutor(parallelism) as pool:
        jobs = {name: pool.submit(train, spark, root, name, cfg, data) for name, (cfg, data) in catalog.items()}
        return {name: job.result() for name, job in jobs.items()}
