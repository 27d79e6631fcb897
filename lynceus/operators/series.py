"""Series building blocks: windows, lags, forecast alignment and the anomaly rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.ordering import as_list, over_order, row_index
from lynceus.session import sized


def embed(df: DataFrame, w: int, key: str | Sequence[str] | None = None, order="ds", y: str = "y",
          out: str = "window", keep_short: bool = False, sizes=None) -> DataFrame:
    """Sliding windows of ``w`` values, stride 1: the window that starts at each row."""
    rows = over_order(df, order, lambda win: {out: F.collect_list(y).over(win.rowsBetween(0, w - 1))},
                      key=key, ahead=w - 1, sizes=sizes)
    return rows if keep_short else rows.filter(F.size(out) == w)


def lag_features(df: DataFrame, lags: int, key: str | Sequence[str] | None = None, order="ds",
                 y: str = "y", complete: bool = True) -> DataFrame:
    """Columns lag_1 .. lag_n next to the value to forecast; rows without full history drop out."""
    rows = over_order(df, order, lambda w: {f"lag_{i}": F.lag(y, i).over(w) for i in range(1, lags + 1)},
                      key=key, back=lags)
    return rows.filter(F.col(f"lag_{lags}").isNotNull()) if complete else rows


def align_forecast(forecast: DataFrame, actual: DataFrame,
                   key: str | Sequence[str] | None = None) -> DataFrame:
    """Forecast rows with an actual value: error and width of the uncertainty interval."""
    rows = forecast.join(actual, [*as_list(key), "ds"])
    rows = rows.withColumn("error", F.col("y") - F.col("yhat"))
    return rows.withColumn("uncertainty", F.col("yhat_upper") - F.col("yhat_lower"))


def flag_interval(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """Interval rule: the error exceeds factor x the interval width."""
    return df.withColumn("is_anomaly", F.abs("error") > factor * F.col("uncertainty"))


@dataclass
class SigmaRule:
    """|error| above mean + k * sigma of the training errors."""

    threshold: float

    @classmethod
    def fit(cls, df: DataFrame, k: float = 3.0, error: str = "error") -> SigmaRule:
        mean, sigma = df.agg(F.avg(F.abs(error)), F.stddev_pop(F.abs(error))).first()
        if mean is None:
            raise ValueError("no training errors")
        return cls(mean + k * sigma)

    def apply(self, df: DataFrame, error: str = "error") -> DataFrame:
        return df.withColumns({"score": F.abs(error), "threshold": F.lit(self.threshold),
                               "is_anomaly": F.abs(error) > self.threshold})


def sigma_rule_by(df: DataFrame, key: str | Sequence[str], k: float = 3.0,
                  error: str = "error") -> DataFrame:
    """The sigma rule with one threshold per series."""
    limits = df.groupBy(*as_list(key)).agg(
        (F.avg(F.abs(error)) + k * F.stddev_pop(F.abs(error))).alias("threshold"))
    return (df.join(sized(limits), as_list(key)).withColumn("score", F.abs(error))
            .withColumn("is_anomaly", F.abs(error) > F.col("threshold")))


@dataclass
class ZRule:
    """|standardised residual| above k, standardised by the training residuals."""

    mean: float
    sigma: float
    k: float

    @classmethod
    def fit(cls, df: DataFrame, k: float = 3.0, error: str = "error") -> ZRule:
        mean, sigma = df.agg(F.avg(error), F.stddev_pop(error)).first()
        if mean is None:
            raise ValueError("no training residuals")
        return cls(mean, sigma or 1.0, k)

    def apply(self, df: DataFrame, error: str = "error") -> DataFrame:
        z = (F.col(error) - self.mean) / self.sigma
        return df.withColumns({"score": z, "threshold": F.lit(float(self.k)),
                               "is_anomaly": F.abs(z) > self.k})


def flag_zscore(df: DataFrame, k: float = 3.0, error: str = "error") -> DataFrame:
    return ZRule.fit(df, k, error).apply(df, error)


def future_frame(df: DataFrame, periods: int | None = None,
                 key: str | Sequence[str] | None = None) -> DataFrame:
    """Future time axis of each series, spaced by its last gap.

    Without ``periods`` the axis has as many rows as the series and starts at
    its last time stamp; with ``periods`` it starts one gap later.
    """
    key = as_list(key)
    # one row per series: the last two time stamps
    last = df.groupBy(*key).agg(F.max("ds").alias("_last"))
    if key:
        prior = df.join(last, key).filter(F.col("ds") < F.col("_last"))
        ends = last.join(prior.groupBy(*key).agg(F.max("ds").alias("_prior")), key)
    else:
        end = last.first()["_last"]
        prior = df.filter(F.col("ds") < F.lit(end)).agg(F.max("ds")).first()[0]
        ends = last.withColumn("_prior", F.lit(prior))
    end, before = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("_last", "_prior"))
    ends = ends.filter(F.col("_prior").isNotNull()).select(*key, end.alias("_e"), (end - before).alias("_g"))
    if periods:
        steps = F.sequence(F.lit(1).cast("long"), F.lit(periods).cast("long"))
        rows = ends.withColumn("step", F.explode(steps))
    else:
        rows = row_index(df.select(*key, "ds"), "ds", key=key, name="step").drop("ds")
        rows = (rows.join(ends, key) if key else
                rows.withColumns({c: F.lit(v) for c, v in ends.first().asDict().items()}))
    return rows.select(*key, "step", F.timestamp_micros(F.col("_e") + F.col("step") * F.col("_g")).alias("ds"))
