"""ARIMA(p, d, q) by Hannan-Rissanen regression, chosen by AIC.

Stage one fits a long autoregression; its residuals stand in for the shocks.
Stage two regresses on value lags and shock lags.  All (p, q) candidates read
their normal equations out of one Gram matrix per series, so the whole search
costs two passes, for one long series as for many short ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.least_squares import dot, least_squares, ridge_solution, solve_grams, with_model
from lynceus.operators.ordering import as_list, group_sizes, over_order, row_index
from lynceus.session import durable

# Fixed value: default threshold of the sigma rule.
DEFAULT_K = 3.0
# Forecast rows handed on at a time.
BLOCK = 10_000


def _differences(df: DataFrame, d: int, key, order: str, y: str, sizes) -> DataFrame:
    """Columns ``_t0`` (the value) .. ``_t{d-1}`` and ``_w`` (the d-th difference)."""
    weights = [np.array([1.0])]
    for _ in range(d):
        weights.append(np.convolve(weights[-1], [1.0, -1.0]))

    def columns(w: WindowSpec):
        out = {}
        for i, signs in enumerate(weights):
            value = F.col(y)
            for j, s in enumerate(signs[1:], 1):
                value = value + F.lit(float(s)) * F.lag(y, j).over(w)
            out["_w" if i == d else f"_t{i}"] = value
        return out

    return over_order(df, order, columns, key=key, back=d, sizes=sizes)


@dataclass
class Arima:
    """Fitted model table (key..., p, q, coef, aic, sse, n) and the last row of lags per series."""

    model: DataFrame
    ends: DataFrame
    limits: DataFrame  # key..., threshold
    key: list[str]
    d: int
    max_p: int
    max_q: int
    y: str
    order: str
    rows: DataFrame | None = None  # training rows with their lags; not stored

    def _design(self):
        return ([F.lit(1.0)] + [F.col(f"_w{i}") for i in range(1, self.max_p + 1)]
                + [F.col(f"_e{i}") for i in range(1, self.max_q + 1)])

    def fitted(self) -> DataFrame:
        """One-step fitted values: key..., order, y, y_pred, error (rows with full history)."""
        rows = with_model(self.rows, self.model, self.key, ["coef"])
        step = dot(self._design())
        # y = w + (y - w): the differences' known part comes from earlier values
        rows = rows.withColumn("y_pred", step + F.col(self.y) - F.col("_w"))
        rows = rows.filter(F.col("y_pred").isNotNull())
        return (rows.withColumn("error", F.col(self.y) - F.col("y_pred"))
                .select(*self.key, self.order, self.y, "y_pred", "error"))

    def forecast(self, periods: int | DataFrame) -> DataFrame:
        """Forecasts 1..periods ahead per series from its last row of lags.

        ``periods`` may be a table (key..., periods) that says how far for each series.
        """
        d, key, max_p, max_q = self.d, self.key, self.max_p, self.max_q
        ends = with_periods(with_model(self.ends, self.model, key, ["coef"]), periods, key)
        fields = [ends.schema[k] for k in key]
        schema = T.StructType(fields + [T.StructField("step", T.LongType()),
                                        T.StructField("y_pred", T.DoubleType())])
        names = [f.name for f in schema.fields]

        def run(batches):
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    w = [row["_w"]] + [row[f"_w{i}"] for i in range(1, max_p + 1)]
                    e = [row["_e"]] + [row[f"_e{i}"] for i in range(1, max_q + 1)]
                    coef = np.asarray(row["coef"], float)
                    tails = [row[f"_t{i}"] for i in range(d)]
                    out = []
                    for step in range(1, int(row["periods"]) + 1):
                        x = np.array([1.0, *w[:max_p], *e[:max_q]], float)
                        value = float(coef @ np.nan_to_num(x))
                        w, e = [value, *w[:max_p]], [0.0, *e[:max_q]]
                        total = value
                        for i in reversed(range(d)):
                            total = tails[i] = tails[i] + total
                        out.append([*[row[k] for k in key], step, total])
                        if len(out) == BLOCK:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=names)

        return ends.mapInPandas(run, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """Score rows that follow the training rows against the forecast, in order."""
        return score_ahead(df, self.forecast, self.limits, self.key, self.order, self.y)


def with_periods(ends: DataFrame, periods: int | DataFrame, key: list[str]) -> DataFrame:
    """Append ``periods`` to the table of series; those that a given table lacks go."""
    if isinstance(periods, int):
        return ends.withColumn("periods", F.lit(periods))
    return with_model(ends, periods, key, ["periods"])


def score_ahead(df: DataFrame, forecast, limits: DataFrame, key: list[str], order: str, y: str) -> DataFrame:
    """The i-th new row of a series meets its i-step forecast; errors above the training limit are flagged."""
    rows = row_index(df, order, key=key, name="_step").withColumn("_step", F.col("_step") + 1)
    rows = durable(rows)
    # as many steps for each series as it has new rows
    ahead = forecast(rows.groupBy(*key).agg(F.coalesce(F.max("_step"), F.lit(0)).alias("periods"))).withColumnRenamed("step", "_step")
    rows = rows.join(ahead, [*key, "_step"], "left").drop("_step")
    rows = with_model(rows, limits, key, ["threshold"])
    rows = rows.withColumn("error", F.col(y) - F.col("y_pred"))
    return rows.withColumns({"score": F.abs("error"), "is_anomaly": F.abs("error") > F.col("threshold")})


def error_limits(fitted: DataFrame, key: list[str], k: float) -> DataFrame:
    """Sigma-rule threshold per series from the training errors."""
    return fitted.groupBy(*key).agg((F.avg(F.abs("error")) + k * F.stddev_pop(F.abs("error"))).alias("threshold"))


def choose_d(df: DataFrame, key: list[str], order: str, y: str, sizes, most: int = 2) -> int:
    """The number of differences after which the values vary least, as the mean over series of the logarithm of their deviation."""
    names = [f"_v{d}" for d in range(most + 1)]
    def columns(w: WindowSpec):
        value, out = F.col(y), {}
        steps = [F.lag(y, j).over(w) for j in range(1, most + 1)]
        out["_v0"], out["_v1"], out["_v2"] = value, value - steps[0], value - 2 * steps[0] + steps[1]
        return out
    rows = over_order(df, order, columns, key=key, back=most, sizes=sizes)
    spread = rows.groupBy(*key).agg(*[F.log(F.greatest(F.stddev_pop(n), F.lit(1e-12))).alias(n) for n in names])
    found = spread.agg(*[F.avg(n).alias(n) for n in names]).first()
    values = [found[n] for n in names]
    return min(range(most + 1), key=lambda d: (round(values[d], 6), d)) if None not in values else 0


def fit_arima(df: DataFrame, d: int | None = 1, max_p: int = 2, max_q: int = 2, start_p: int = 0, start_q: int = 0,
              key: str | Sequence[str] | None = None, order: str = "ds", y: str = "y",
              k: float = DEFAULT_K) -> Arima:
    """Fit every series with the orders of least AIC; ``d`` None lets the data choose the number of differences."""
    key = as_list(key)
    long_ar = max(max_p, max_q) + 3
    rows = df.select(*key, order, F.col(y).cast("double").alias(y))
    sizes = group_sizes(rows, key)
    d = choose_d(rows, key, order, y, sizes) if d is None else d
    rows = _differences(rows, d, key, order, y, sizes)
    rows = over_order(rows, order, lambda w: {f"_w{i}": F.lag("_w", i).over(w) for i in range(1, long_ar + 1)},
                      key=key, back=long_ar, sizes=sizes)
    rows = durable(rows)
    first = [F.lit(1.0)] + [F.col(f"_w{i}") for i in range(1, long_ar + 1)]
    ar = least_squares(rows, first, F.col("_w"), key)
    rows = with_model(rows, ar.withColumnRenamed("coef", "_ar"), key, ["_ar"])
    rows = rows.withColumn("_e", F.col("_w") - dot(first, "_ar")).drop("_ar")
    rows = over_order(rows, order, lambda w: {f"_e{i}": F.lag("_e", i).over(w) for i in range(1, max_q + 1)},
                      key=key, back=max_q, sizes=sizes) if max_q else rows
    rows = durable(rows.drop(*[f"_w{i}" for i in range(max_p + 1, long_ar + 1)]))
    design = ([F.lit(1.0)] + [F.col(f"_w{i}") for i in range(1, max_p + 1)]
              + [F.col(f"_e{i}") for i in range(1, max_q + 1)])

    width = len(design)

    def choose(g: np.ndarray, n: int) -> dict:
        best = None
        for p in range(start_p, max_p + 1):
            for q in range(start_q, max_q + 1):
                at = [0, *range(1, p + 1), *range(max_p + 1, max_p + 1 + q)]
                part = g[np.ix_([*at, width], [*at, width])]
                coef, sse = ridge_solution(part)
                aic = n * log(max(sse, 1e-300) / n) + 2 * (p + q + 1)
                if best is None or aic < best["aic"] - 1e-9:
                    full = np.zeros(width)
                    full[at] = coef
                    best = {"p": p, "q": q, "coef": full.tolist(), "aic": aic, "sse": sse, "n": n}
        return best

    model = solve_grams(rows, design, F.col("_w"), key, choose,
                        "p int, q int, coef array<double>, aic double, sse double, n long")
    state = ["_w", "_e", *[f"_w{i}" for i in range(1, max_p + 1)], *[f"_e{i}" for i in range(1, max_q + 1)],
             *[f"_t{i}" for i in range(d)]]
    last = F.max(F.struct(F.col(order).alias("_o"), *state)).alias("_last")
    ends = rows.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{c}").alias(c) for c in state])
    fit = Arima(durable(model), durable(ends), None, key, d, max_p, max_q, y, order, rows)
    fit.limits = error_limits(fit.fitted(), key, k)
    return fit


def arima_anomalies(df: DataFrame, **options) -> DataFrame:
    """Fitted values flagged by the sigma rule, with one threshold per series."""
    fit = fit_arima(df, **options)
    rows = with_model(fit.fitted(), fit.limits, fit.key, ["threshold"])
    return rows.withColumns({"score": F.abs("error"), "is_anomaly": F.abs("error") > F.col("threshold")})
