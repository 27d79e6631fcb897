"""Decomposable forecaster: piecewise-linear trend plus Fourier seasonality
(after Taylor & Letham 2018).

Changes of slope have a Laplace prior, so that few of them differ from zero;
seasons have a normal one.  The fit works on one Gram matrix per series.
Intervals widen beyond the training span by the squares of the changes of slope
seen within it (still too little: see the README).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import inf, pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.distributions import normal_quantile
from lynceus.functions.least_squares import dot, least_squares, solve_grams, sparse_solution, with_model
from lynceus.operators.ordering import as_list
from lynceus.operators.series import align_forecast, flag_interval, future_frame
from lynceus.session import durable

# Seasons as (period in days, Fourier order), changepoints, the
# share of the time span that holds them, and the width of the interval.
SEASONS = {"daily": (1.0, 4), "weekly": (7.0, 3), "yearly": (365.25, 10)}
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
INTERVAL_WIDTH = 0.8
# Prior scale of a change of slope and prior deviation of a seasonal term, for values of at most 1 over a span of 1.
SLOPE_PRIOR, SEASON_PRIOR = 0.05, 10.0
DAY = 86_400.0


def _seconds(ds: str = "ds") -> Column:
    return F.unix_micros(F.col(ds).cast("timestamp")) / F.lit(1e6)


@dataclass
class TrendSeason:
    model: DataFrame  # key..., coef, sigma, widening, start, span
    key: list[str]
    seasons: dict[str, tuple[float, int]]
    changepoints: int
    interval: float
    factor: float = 1.0

    @classmethod
    def fit(cls, df: DataFrame, key: str | Sequence[str] | None = None,
            changepoints: int = CHANGEPOINTS, seasons: Mapping | None = None,
            interval: float = INTERVAL_WIDTH, ridge: float | None = None, factor: float = 1.0,
            prior: float = SLOPE_PRIOR, season_prior: float = SEASON_PRIOR) -> TrendSeason:
        """``seasons`` defaults to those with two full periods in the data and a finer spacing; ``ridge`` asks for ridge regression instead of the priors."""
        key = as_list(key)
        rows = df.select(*key, "ds", F.col("y").cast("double").alias("y"))
        extent = rows.groupBy(*key).agg(F.min(_seconds()).alias("start"), F.count("y").alias("_n"), F.max(F.abs("y")).alias("_top"),
                                        (F.max(_seconds()) - F.min(_seconds())).alias("span"))
        if seasons is None:
            span, spacing = extent.filter("span > 0").agg(
                F.max("span"), F.avg(F.col("span") / F.greatest(F.col("_n") - 1, F.lit(1)))).first()
            seasons = {name: s for name, s in SEASONS.items()
                       if span and span >= 2 * s[0] * DAY and spacing < s[0] * DAY}
        self = cls(None, key, dict(seasons), changepoints, interval, factor)
        extent = extent.withColumn("scale", F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0))).drop("_top")
        rows = with_model(rows, extent, key, ["start", "span", "scale"])
        smooth = 2 * sum(o for _, o in seasons.values())
        scaled = F.col("y") / F.col("scale")
        if ridge is not None:
            solved = least_squares(rows, self._design(), scaled, key, [0.0, 0.0] + [ridge] * (changepoints + smooth))
        else:
            laplace = np.array([inf, inf] + [prior] * changepoints + [inf] * smooth)
            normal = np.array([inf, inf] + [inf] * changepoints + [season_prior] * smooth)

            def solve(g: np.ndarray, n: int) -> dict:
                coef, sse = sparse_solution(g, n, laplace, normal)
                return {"n": n, "coef": coef.tolist(), "sse": sse}

            solved = solve_grams(rows, self._design(), scaled, key, solve, "n long, coef array<double>, sse double")
        if key:
            model = solved.join(extent, key)
        else:
            one = extent.first()
            model = solved.withColumns({"start": F.lit(one["start"]), "span": F.lit(one["span"]), "scale": F.lit(one["scale"])})
        slopes = F.slice("coef", 3, changepoints) if changepoints else F.array(F.lit(0.0))
        # slopes go on changing with the sum of squares seen over the training span (changes that the fit has merged keep
        # theirs on average); one that comes u before a time moves it by u times its size, and u^2 integrates to a third of the cube
        squares = F.aggregate(slopes, F.lit(0.0), lambda x, y: x + y * y)
        widening = squares / F.lit(3.0) * F.col("scale") * F.col("scale")
        self.model = durable(model.select(*key, F.transform("coef", lambda x: x * F.col("scale")).alias("coef"),
                                          (F.sqrt(F.col("sse") / F.col("n")) * F.col("scale")).alias("sigma"),
                                          widening.alias("widening"), "start", "span"))
        return self

    @staticmethod
    def _time() -> Column:
        """0 at the start and 1 at the end of the training span."""
        return F.when(F.col("span") > 0, (_seconds() - F.col("start")) / F.col("span")).otherwise(F.lit(0.0))

    def _design(self) -> list[Column]:
        t = self._time()
        out = [F.lit(1.0), t]
        for i in range(1, self.changepoints + 1):
            at = CHANGEPOINT_RANGE * i / self.changepoints
            out.append(F.greatest(t - F.lit(at), F.lit(0.0)))
        for period, order in self.seasons.values():
            angle = F.lit(2 * pi / (period * DAY)) * F.pmod(_seconds(), F.lit(period * DAY))
            for n in range(1, order + 1):
                out += [F.sin(angle * n), F.cos(angle * n)]
        return out

    def predict(self, times: DataFrame) -> DataFrame:
        """Forecast of given time stamps: key..., ds, yhat, yhat_lower, yhat_upper."""
        rows = with_model(times.select(*self.key, "ds"), self.model, self.key,
                          ["coef", "sigma", "widening", "start", "span"])
        rows = rows.withColumn("yhat", dot(self._design()))
        ahead = F.greatest(self._time() - F.lit(1.0), F.lit(0.0))
        deviation = F.sqrt(F.col("sigma") * F.col("sigma") + F.col("widening") * ahead * ahead * ahead)
        half = F.lit(normal_quantile(0.5 + self.interval / 2)) * deviation
        return rows.select(*self.key, "ds", "yhat", (F.col("yhat") - half).alias("yhat_lower"),
                           (F.col("yhat") + half).alias("yhat_upper"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Actual rows against their forecast, flagged by the interval rule."""
        forecast = self.predict(df.select(*self.key, "ds").distinct())
        return flag_interval(align_forecast(forecast, df, self.key), self.factor)

    def horizon(self, df: DataFrame, periods: int | None = None) -> DataFrame:
        return self.predict(future_frame(df, periods, self.key))
