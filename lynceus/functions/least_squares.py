"""Least squares from Gram matrices: one pass over the data, tiny solves per series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.moments import gram
from lynceus.operators.ordering import as_list
from lynceus.session import sized

Solve = Callable[[np.ndarray, int], dict]


def solve_grams(df: DataFrame, design: Sequence[Column], y: Column, by, solve: Solve,
                out: str) -> DataFrame:
    """Per ``by``: Gram matrix of (design..., y), handed to ``solve(gram, n)`` for one output row."""
    by = as_list(by)
    p = len(design) + 1
    rows = df.select(*by, F.array(*[c.cast("double") for c in design], y.cast("double")).alias("_v"))
    complete = ~F.exists("_v", lambda v: v.isNull() | F.isnan(v))
    sums = gram(rows.filter(complete), "_v", p, by)
    schema = T.StructType([rows.schema[b] for b in by] + T.StructType.fromDDL(out).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [solve(np.asarray(g, float).reshape(p, p), int(n)) for g, n in zip(pdf["gram"], pdf["n"])]
            yield pd.concat([pdf[by].reset_index(drop=True), pd.DataFrame(
                found, columns=[f.name for f in schema.fields[len(by):]])], axis=1)

    return sums.mapInPandas(run, schema)


def ridge_solution(g: np.ndarray, penalty: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares from the Gram matrix of (design, y)."""
    xtx, xty, yty = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    lhs = xtx + np.diag(np.broadcast_to(np.asarray(penalty, float), len(xtx)))
    scale = np.sqrt(np.maximum(np.diag(lhs), 1e-300))
    coef = np.linalg.lstsq(lhs / np.outer(scale, scale), xty / scale, rcond=1e-13)[0] / scale
    sse = float(yty - 2 * coef @ xty + coef @ xtx @ coef)
    return coef, max(sse, 0.0)


#: Most rounds of the noise variance, and most signs tried for each weighted column in a round.
NOISE_ROUNDS, TRIES = 50, 40


def _lasso(a: np.ndarray, c: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least b'ab / 2 - c'b + sum of weight |b|, from ``start``: a search over signs, columns without weight eliminated.

    For given signs the least is linear; on the way there, the best point at which a sign changes is taken.
    """
    h, s = np.flatnonzero(weight > 0), np.flatnonzero(weight <= 0)
    scale = np.sqrt(np.maximum(np.diag(a)[s], 1e-300))
    inverse = np.linalg.pinv(a[np.ix_(s, s)] / np.outer(scale, scale), rcond=1e-13) / np.outer(scale, scale)
    across = a[np.ix_(s, h)]
    b, d, w = a[np.ix_(h, h)] - across.T @ inverse @ across, c[h] - across.T @ (inverse @ c[s]), weight[h]
    # a column that the others make up explains nothing of its own
    able = np.diag(b) > 1e-12 * np.maximum(np.diag(a)[h], 1e-300)
    x = np.where(able, start[h], 0.0)
    sign = np.sign(x)

    def value(z: np.ndarray) -> float:
        return float(z @ b @ z / 2 - d @ z + w @ np.abs(z))

    for _ in range(TRIES * max(len(h), 1)):
        on = np.flatnonzero(sign)
        settled = True
        if len(on):
            y = np.zeros(len(h))
            y[on] = np.linalg.lstsq(b[np.ix_(on, on)], d[on] - w[on] * sign[on], rcond=1e-13)[0]
            shares = [1.0] + [float(x[k] / (x[k] - y[k])) for k in on if x[k] * y[k] < 0]
            points = [np.where(np.abs(x + r * (y - x)) <= 1e-14 * (np.abs(x) + np.abs(y)), 0.0, x + r * (y - x)) for r in shares]
            settled = bool((np.sign(y[on]) == sign[on]).all())
            x = points[0] if settled else min(points, key=value)
            sign = np.sign(x)
        if settled:
            excess = np.where(able & (sign == 0), np.abs(d - b @ x) - w * (1 + 1e-9), -1.0)
            k = int(np.argmax(excess)) if len(h) else 0
            if not len(h) or excess[k] <= 0:
                break
            sign[k] = np.sign((d - b @ x)[k])
    out = np.zeros(len(c))
    out[h] = x
    out[s] = inverse @ (c[s] - across @ x)
    return out


def sparse_solution(g: np.ndarray, n: int, laplace: np.ndarray, normal: np.ndarray) -> tuple[np.ndarray, float]:
    """Most probable coefficients under priors of scale ``laplace`` and deviation ``normal`` per column (infinite: none).

    The noise variance is the mean squared residual, found in turn with the coefficients.
    Returns the coefficients and the residual sum of squares.
    """
    xtx, xty, yty = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    least = 1e-12 * max(yty / max(n, 1), 1e-300)
    sse = ridge_solution(g)[1]
    noise = max(sse / max(n, 1), least)
    coef = np.zeros(len(xty))
    for _ in range(NOISE_ROUNDS):
        coef = _lasso(xtx + np.diag(noise / normal ** 2), xty, noise / laplace, coef)
        sse = max(float(yty - 2 * coef @ xty + coef @ xtx @ coef), 0.0)
        before, noise = noise, max(sse / max(n, 1), least)
        if abs(noise - before) <= 1e-7 * before:
            break
    return coef, sse


def least_squares(df: DataFrame, design: Sequence[Column], y: Column, by=None,
                  penalty: Sequence[float] | None = None) -> DataFrame:
    """by..., n, coef, sse; ``penalty`` holds ridge weights per design column, times n."""
    weights = np.zeros(len(design)) if penalty is None else np.asarray(penalty, float)

    def solve(g: np.ndarray, n: int) -> dict:
        coef, sse = ridge_solution(g, weights * n)
        return {"n": n, "coef": coef.tolist(), "sse": sse}

    return solve_grams(df, design, y, by, solve, "n long, coef array<double>, sse double")


def with_model(rows: DataFrame, model: DataFrame, by, columns: Sequence[str]) -> DataFrame:
    """Attach model columns: by an equi-join per series, or as literals of the single model row."""
    by = as_list(by)
    if by:
        return rows.join(sized(model.select(*by, *columns)), by)
    one = model.select(*columns).first()
    if one is None:
        raise ValueError("no complete rows to fit a model on")
    return rows.withColumns({c: _literal(one[c]) for c in columns})


def _literal(value) -> Column:
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def dot(design: Sequence[Column], coef: str = "coef") -> Column:
    out = F.lit(0.0)
    for i, c in enumerate(design):
        out = out + F.col(coef)[i] * c
    return out
