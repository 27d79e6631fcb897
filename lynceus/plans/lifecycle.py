"""Metrics per batch and the decision to retrain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.metrics import classification_metrics, regression_metrics

# Metric columns of the two families of experiments.
CLASSIFICATION = ["accuracy", "f1", "precision", "recall"]
REGRESSION = ["mse", "mae", "r2", "mape"]


def metrics_history(df: DataFrame, kind: str, batch: str = "batch_no", **columns) -> DataFrame:
    """Long table (batch, metric, value) with one set of metrics per batch."""
    if kind == "classification":
        wide, names = classification_metrics(df, by=batch, **columns), CLASSIFICATION
    elif kind == "regression":
        wide, names = regression_metrics(df, by=batch, **columns), REGRESSION
    else:
        raise ValueError(f"unknown kind of metrics {kind!r}; known: classification, regression")
    return wide.unpivot([batch], names, "metric", "value")


def retrain_flags(history: DataFrame, metric: str, threshold: float, higher_better: bool = False,
                  batch: str = "batch_no") -> DataFrame:
    """Whether a retrain is due after each batch."""
    rows = history.filter(F.col("metric") == metric)
    worse = F.col("value") < threshold if higher_better else F.col("value") > threshold
    return rows.select(batch, "metric", "value", worse.alias("retrain"))


def needs_retrain(history: DataFrame, metric: str, threshold: float, higher_better: bool = False,
                  batch: str = "batch_no") -> bool:
    """The same decision for the latest batch only."""
    last = (history.filter(F.col("metric") == metric)
            .agg(F.max_by("value", batch).alias("v")).first())["v"]
    if last is None:
        return False
    return last < threshold if higher_better else last > threshold
