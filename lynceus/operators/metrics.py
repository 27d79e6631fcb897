"""Classification and regression metrics, each one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.ordering import as_list


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def label_pairs(labels: DataFrame, first: str, second: str) -> DataFrame:
    """Every ordered pair of class labels: the zero-filled grid of a state matrix."""
    one = labels.toDF("_l").filter(F.col("_l").isNotNull()).agg(F.collect_set("_l").alias("_all"))
    return (one.select(F.explode("_all").alias(first), "_all")
            .select(first, F.explode("_all").alias(second)))


def confusion(df: DataFrame, y: str, y_hat: str, normalize: bool = True) -> DataFrame:
    """Counts per (true, predicted) class with zero cells, and the share of the true class."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(y_hat).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    every = label_pairs(counts.select("y").union(counts.select("y_pred")), "y", "y_pred")
    cells = (every.join(counts, ["y", "y_pred"], "left")
             .withColumn("n", F.coalesce("n", F.lit(0))))
    if not normalize:
        return cells
    totals = cells.groupBy("y").agg(F.sum("n").alias("_t"))
    return cells.join(totals, "y").withColumn("share", _ratio(F.col("n"), F.col("_t"))).drop("_t")


def classification_metrics(df: DataFrame, y: str = "target", y_hat: str = "y_pred", positive=1,
                           by: str | Sequence[str] | None = None) -> DataFrame:
    """Accuracy, F1, precision and recall of the positive class; 0/0 is 0."""
    true, pred = F.col(y) == F.lit(positive), F.col(y_hat) == F.lit(positive)
    tp, fp = F.count(F.when(true & pred, 1)), F.count(F.when(~true & pred, 1))
    fn = F.count(F.when(true & ~pred, 1))
    n = F.count(F.lit(1))
    return df.groupBy(*as_list(by)).agg(
        (F.count(F.when(F.col(y) == F.col(y_hat), 1)) / n).alias("accuracy"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"))


def macro_metrics(df: DataFrame, y: str = "target", y_hat: str = "y_pred") -> DataFrame:
    """Unweighted means over all classes of F1, precision and recall."""
    cells = confusion(df, y, y_hat, normalize=False)
    hit = F.when(F.col("y") == F.col("y_pred"), F.col("n")).otherwise(0)
    per_true = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("t"), F.sum(hit).alias("tp"))
    per_pred = cells.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("p"))
    each = per_true.join(per_pred, "label").select(
        "t", "tp", _ratio(F.col("tp"), F.col("p")).alias("precision"),
        _ratio(F.col("tp"), F.col("t")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"))
    return each.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg("f1").alias("f1"),
                    F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


# Fixed value: smallest denominator of MAPE (double precision epsilon).
MAPE_FLOOR = 2.220446049250313e-16


def regression_metrics(df: DataFrame, y: str = "y", y_hat: str = "y_pred",
                       by: str | Sequence[str] | None = None) -> DataFrame:
    """MSE, MAE, R2 and MAPE; R2 of a constant series is 1 for a perfect fit, else 0."""
    a = F.col(y).cast("double")
    e = a - F.col(y_hat).cast("double")
    sse, spread = F.sum(e * e), F.var_pop(a) * F.count(a)
    r2 = F.when(spread > 0, 1 - sse / spread).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    rows = df.filter(a.isNotNull() & F.col(y_hat).isNotNull())
    return rows.groupBy(*as_list(by)).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"),
        F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(MAPE_FLOOR))).alias("mape"))
