"""Sparse changes of slope and intervals that widen with the horizon."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from lynceus.functions import least_squares
from lynceus.operators.trend_season import TrendSeason

START = datetime(2021, 1, 4)
SPAN = 200, 60  # days trained on, days ahead


def gram_of(x, y):
    v = np.column_stack((x, y))
    return v.T @ v


def objective(x, y, coef, noise, laplace, normal):
    return ((y - x @ coef) ** 2).sum() / 2 + noise * (np.abs(coef) / laplace).sum() + noise * ((coef / normal) ** 2).sum() / 2


@pytest.mark.parametrize("seed", range(4))
def test_no_step_lowers_the_penalised_error(seed):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, 300)
    x = np.column_stack([np.ones(300), t, *[np.maximum(t - 0.8 * i / 12, 0) for i in range(1, 13)], np.sin(30 * t), np.zeros(300)])
    y = 0.3 * t - 1.1 * np.maximum(t - 0.4, 0) + 0.1 * np.sin(30 * t) + rng.normal(0, 0.03, 300)
    laplace = np.array([np.inf] * 2 + [0.05] * 12 + [np.inf, 0.05])
    normal = np.array([np.inf] * 14 + [10.0, np.inf])
    coef, sse = least_squares.sparse_solution(gram_of(x, y), 300, laplace, normal)
    noise = sse / 300
    assert sse == pytest.approx(((y - x @ coef) ** 2).sum(), rel=1e-6)
    here = objective(x, y, coef, noise, laplace, normal)
    for i in range(len(coef)):
        for step in (1e-3, -1e-3, -coef[i]):
            other = coef.copy()
            other[i] += step
            assert objective(x, y, other, noise, laplace, normal) >= here - 1e-9
    for _ in range(200):
        assert objective(x, y, coef + rng.normal(0, 1e-3, len(coef)), noise, laplace, normal) >= here - 1e-9


def test_planted_changes_are_found_and_the_rest_is_zero(spark):
    rng = np.random.default_rng(3)
    n = 400
    t = np.arange(n) / (n - 1)
    y = 50 + 40 * t - 160 * np.maximum(t - 0.32, 0) + 200 * np.maximum(t - 0.64, 0) + rng.normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"ds": [START + timedelta(days=i) for i in range(n)], "y": y}))
    model = TrendSeason.fit(df, seasons={})
    slopes = np.array(model.model.first()["coef"][2:])
    at = 0.8 * np.arange(1, 26) / 25
    assert (slopes == 0).sum() >= 12
    for place, size in ((0.32, -160), (0.64, 200)):
        near = slopes[np.abs(at - place) < 0.07].sum()
        assert near == pytest.approx(size, rel=0.15)
    assert np.abs(slopes[(np.abs(at - 0.32) >= 0.07) & (np.abs(at - 0.64) >= 0.07)]).sum() < 30


@pytest.fixture(scope="module")
def forecast(spark):
    """Series of the model's own kind: slopes change at random in the first four fifths of the training span and after its end."""
    rng = np.random.default_rng(6)
    rows, (n, ahead) = [], SPAN
    for k in range(60):
        slope, level, values = rng.normal(0, 0.5), 100.0, []
        for i in range(n + ahead):
            slope += rng.laplace(0, 0.3) if rng.random() < 25 / n and not 0.8 * n <= i < n else 0.0
            level += slope
            values.append(level + rng.normal(0, 1))
        rows.append(pd.DataFrame({"k": k, "i": range(n + ahead), "ds": [START + timedelta(days=i) for i in range(n + ahead)], "y": values}))
    df = spark.createDataFrame(pd.concat(rows)).cache()
    model = TrendSeason.fit(df.filter(f"i < {n}"), "k", seasons={})
    out = model.predict(df).join(df, ["k", "ds"]).toPandas()
    df.unpersist()
    return out


def test_intervals_widen_beyond_the_training_span(forecast):
    n, ahead = SPAN
    width = (forecast.yhat_upper - forecast.yhat_lower).groupby(forecast.i).mean()
    assert width[n + ahead - 1] > 2 * width[n - 1] and width[0] == pytest.approx(width[n - 1])


@pytest.mark.xfail(reason="covers 0.587 of these values at a nominal 0.8: slopes at the end and sizes of changes are shrunk by the prior")
def test_intervals_cover_series_that_go_on_changing(forecast):
    late = forecast[forecast.i >= SPAN[0] + 10]
    assert 0.6 <= ((late.y >= late.yhat_lower) & (late.y <= late.yhat_upper)).mean() <= 0.98


def test_flat_short_and_constant_series(spark):
    rows = [("one", START, 4.0), *[("flat", START + timedelta(days=i), 0.0) for i in range(9)],
            *[("same", START + timedelta(days=i), 5.0) for i in range(9)], ("hole", START, None), ("hole", START + timedelta(days=1), 2.0)]
    df = spark.createDataFrame(rows, "k string, ds timestamp, y double")
    got = {(r["k"], r["ds"]): r for r in TrendSeason.fit(df, "k", seasons={}).predict(df.select("k", "ds")).collect()}
    assert len(got) == len(rows)
    assert all(abs(got[k, ds]["yhat"] - (y if y is not None else 2.0)) < 1e-3 for k, ds, y in rows if k != "hole" or y is not None)
