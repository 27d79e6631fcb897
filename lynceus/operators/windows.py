"""Models on sliding windows: singular spectrum analysis, window reconstruction,
and the lagged forecaster."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.least_squares import least_squares, with_model
from lynceus.functions.moments import gram, linear, symmetric_eigen
from lynceus.operators.ordering import as_list, group_sizes, over_order, row_index
from lynceus.operators.series import ZRule, embed, lag_features
from lynceus.session import durable, keep_cached

# Defaults of the three detectors.
SSA_WINDOW, SSA_FREQUENCY, SSA_CONTRIBUTION = 10, 0.05, 0.975
WINDOW, THRESHOLD = 10, 3.0
TRAIN_SHARE = 0.8
GROUPS = ["trend", "seasonal", "residual"]


def scale_stats(df: DataFrame, col: str, key=None) -> DataFrame:
    """Mean ``_m`` and population sigma ``_sd`` (0 counts as 1) per series."""
    sd = F.stddev_pop(col)
    return df.groupBy(*as_list(key)).agg(F.avg(col).alias("_m"),
                                         F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("_sd"))


def standardise(df: DataFrame, col: str, out: str, stats: DataFrame, key=None) -> DataFrame:
    rows = with_model(df, stats, key, ["_m", "_sd"])
    return rows.withColumn(out, (F.col(col) - F.col("_m")) / F.col("_sd")).drop("_m", "_sd")


def spectral_groups(vectors: np.ndarray, f_bound: float, contribution: float) -> list[int]:
    """Group of every eigenvector by its periodogram: 0 trend, 1 seasonal, 2 residual.

    Trend: the share of power below ``f_bound`` exceeds ``contribution``.
    Residual: the share below a quarter (the lower half of the spectrum) does not.
    """
    frequencies = np.fft.rfftfreq(len(vectors))
    out = []
    for v in vectors.T:
        power = np.abs(np.fft.rfft(v)) ** 2
        total = power.sum() or 1.0
        if power[frequencies < f_bound].sum() / total > contribution:
            out.append(0)
        elif power[frequencies < 0.25].sum() / total < contribution:
            out.append(2)
        else:
            out.append(1)
    return out


def group_projections(g: np.ndarray, f_bound: float, contribution: float) -> np.ndarray:
    """Projection matrices (3 x L x L) of the three groups."""
    _, vectors = symmetric_eigen(g)
    groups = spectral_groups(vectors, f_bound, contribution)
    return np.stack([sum((np.outer(v, v) for v, k in zip(vectors.T, groups) if k == which),
                         np.zeros_like(g)) for which in range(3)])


def _diagonal_weights(projections: np.ndarray, a: int, b: int, L: int) -> np.ndarray:
    """Weights (3 x (a+b+1)) that map the values around a point to its reconstruction.

    The point has ``a`` neighbours behind and ``b`` ahead (each at most L-1);
    the reconstruction is the mean over all windows that cover it.
    """
    out = np.zeros((3, a + b + 1))
    starts = range(-a, b - L + 2)
    for o in starts:
        out[:, o + a:o + a + L] += projections[:, -o, :]
    return out / max(len(starts), 1)


def _complete_mean(stack: np.ndarray, values: np.ndarray, a: int, b: int, L: int) -> np.ndarray:
    """Reconstructions of points without a null near them; one stack for all rows, or one each."""
    if stack.ndim == 3:
        return values @ _diagonal_weights(stack, a, b, L).T
    return np.einsum("ign,in->ig", np.stack([_diagonal_weights(p, a, b, L) for p in stack]), values)


def _partial_mean(stack: np.ndarray, values: np.ndarray, a: int, b: int, L: int) -> np.ndarray:
    """The same mean over the windows without nulls only; NaN where there is none."""
    total, count = np.zeros((len(values), 3)), np.zeros((len(values), 1))
    each = "gn,in->ig" if stack.ndim == 3 else "ign,in->ig"
    for o in range(-a, b - L + 2):
        window = values[:, o + a:o + a + L]
        good = ~np.isnan(window).any(axis=1)[:, None]
        total += np.where(good, np.einsum(each, stack[..., -o, :], np.nan_to_num(window)), 0.0)
        count += good
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def decompose(df: DataFrame, stats: DataFrame, window: int, f_bound: float, contribution: float,
              key: list[str], order: str, y: str) -> DataFrame:
    """Trend, seasonal and residual parts of the scaled series.

    Diagonal averaging makes every reconstructed value a weighted mean of its
    neighbours within window - 1 rows, so no window is ever exploded.  Windows
    that hold a null count neither for the spectrum nor for any mean; a row that no
    other window covers, a null one in particular, has null parts.
    """
    L = window
    known = group_sizes(df, key)
    rows = standardise(df, y, "_z", stats, key)

    def frames(w):
        # structs keep the places of nulls, which a list of values would close
        def listed(frame):
            return F.transform(F.collect_list(F.struct("_z")).over(frame), lambda s: s["_z"])

        return {"_back": listed(w.rowsBetween(-(L - 1), -1)), "_win": listed(w.rowsBetween(0, L - 1))}

    rows = over_order(rows, order, frames, key=key, back=L - 1, ahead=L - 1, sizes=known)
    whole = (F.size("_win") == L) & ~F.exists("_win", lambda z: z.isNull())
    grams = gram(rows.filter(whole), "_win", L, key)
    result = T.StructType([T.StructField(g, T.DoubleType()) for g in GROUPS])

    def reconstruct(back: pd.Series, win: pd.Series, projections) -> pd.DataFrame:
        """``projections(at)`` is the (3, L, L) stack of all rows, or of each of the rows ``at``."""
        out = np.full((len(back), 3), np.nan)
        sizes = pd.DataFrame({"a": back.map(len).to_numpy(), "b": win.map(len).to_numpy() - 1})
        for (a, b), at in sizes.groupby(["a", "b"]).indices.items():
            if a + b + 1 < L:
                continue
            values = np.stack([np.concatenate([back.iloc[i], win.iloc[i]]) for i in at]).astype(float)
            broken = np.isnan(values).any(axis=1)
            for some, mean in ((~broken, _complete_mean), (broken, _partial_mean)):
                if some.any():
                    out[at[some]] = mean(projections(at[some]), values[some], a, b, L)
        return pd.DataFrame(out, columns=GROUPS)

    if key:
        def solve(batches):
            for pdf in batches:
                pdf["_p"] = [group_projections(np.asarray(g, float).reshape(L, L), f_bound, contribution)
                             .ravel().tolist() for g in pdf["gram"]]
                yield pdf[[*key, "_p"]]

        schema = T.StructType([grams.schema[c] for c in key]
                              + [T.StructField("_p", T.ArrayType(T.DoubleType()))])
        rows = rows.join(grams.mapInPandas(solve, schema), key)

        @F.pandas_udf(result)
        def parts(back: pd.Series, win: pd.Series, p: pd.Series) -> pd.DataFrame:
            stacks = [np.asarray(v, float).reshape(3, L, L) for v in p]
            return reconstruct(back, win, lambda at: np.stack([stacks[i] for i in at]))

        rows = rows.withColumn("_parts", parts("_back", "_win", "_p")).drop("_p")
    else:
        one = grams.first()
        if one is None:
            raise ValueError(f"the series is shorter than the window of {L} rows")
        stack = group_projections(np.asarray(one["gram"], float).reshape(L, L), f_bound, contribution)

        @F.pandas_udf(result)
        def parts(back: pd.Series, win: pd.Series) -> pd.DataFrame:
            return reconstruct(back, win, lambda at: stack)

        rows = rows.withColumn("_parts", parts("_back", "_win"))
    return rows.select(*df.columns, *[F.nanvl(F.col(f"_parts.{g}"), F.lit(None).cast("double")).alias(g)
                                      for g in GROUPS])


@dataclass
class Ssa:
    """Singular spectrum analysis; large residuals on the training scale are flagged."""

    scale: DataFrame
    residual_scale: DataFrame
    window: int
    f_bound: float
    contribution: float
    k: float
    key: list[str]
    order: str
    y: str

    @classmethod
    def fit(cls, df: DataFrame, window: int = SSA_WINDOW, f_bound: float = SSA_FREQUENCY,
            contribution: float = SSA_CONTRIBUTION, k: float = THRESHOLD, key=None, order: str = "ds",
            y: str = "y") -> Ssa:
        key = as_list(key)
        scale = durable(scale_stats(df, y, key))
        parts = decompose(df, scale, window, f_bound, contribution, key, order, y)
        return cls(scale, durable(scale_stats(parts, "residual", key)), window, f_bound, contribution, float(k),
                   key, order, y)

    def transform(self, df: DataFrame) -> DataFrame:
        parts = decompose(df, self.scale, self.window, self.f_bound, self.contribution, self.key, self.order,
                          self.y)
        rows = standardise(parts, "residual", "score", self.residual_scale, self.key)
        return rows.withColumns({"threshold": F.lit(self.k), "is_anomaly": F.abs("score") > self.k})


@dataclass
class WindowReconstruction:
    """Linear autoencoder on windows: mean absolute reconstruction error with a sigma rule.

    The encoder and the threshold come from the windows inside the first 80 %
    of each series; the score of a row is the mean error of the windows that
    cover it.
    """

    scale: DataFrame
    limits: DataFrame  # key..., threshold
    projection: np.ndarray
    window: int
    key: list[str]
    order: str
    y: str

    @classmethod
    def fit(cls, df: DataFrame, window: int = WINDOW, components: int = 3, k: float = THRESHOLD, key=None,
            order: str = "ds", y: str = "y") -> WindowReconstruction:
        key, w = as_list(key), window
        known = group_sizes(df, key)
        scale = durable(scale_stats(df, y, key))
        rows = row_index(standardise(df, y, "_z", scale, key), order, key=key, name="_i", sizes=known)
        sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        rows = with_model(rows, sizes, key, ["_n"])
        rows = embed(rows, w, key=key, order=order, y="_z", out="_win", sizes=known)
        train = rows.filter(F.col("_i") + w <= F.floor(F.col("_n") * TRAIN_SHARE))
        # one encoder for all series: they are on the same scale
        one = gram(train, "_win", w).first()
        if one is None:
            raise ValueError("no full training window")
        _, vectors = symmetric_eigen(np.asarray(one["gram"], float).reshape(w, w))
        model = cls(scale, None, vectors[:, :components] @ vectors[:, :components].T, w, key, order, y)
        loss = train.withColumn("_loss", model._loss()("_win"))
        model.limits = durable(loss.groupBy(*key).agg(
            (F.avg("_loss") + k * F.stddev_pop("_loss")).alias("threshold")))
        return model

    def _loss(self):
        p = self.projection

        @F.pandas_udf(T.DoubleType())
        def error(win: pd.Series) -> pd.Series:
            x = np.stack(win.to_numpy()) if len(win) else np.zeros((0, len(p)))
            return pd.Series(np.abs(x - x @ p).mean(axis=1))

        return error

    def transform(self, df: DataFrame) -> DataFrame:
        w, known = self.window, group_sizes(df, self.key)
        rows = standardise(df, self.y, "_z", self.scale, self.key)
        rows = embed(rows, w, key=self.key, order=self.order, y="_z", out="_win", keep_short=True, sizes=known)
        full = F.size("_win") == w
        padded = F.when(full, F.col("_win")).otherwise(F.array_repeat(F.lit(0.0), w))
        rows = rows.withColumn("_loss", F.when(full, self._loss()(padded))).drop("_win", "_z")
        rows = over_order(rows, self.order, lambda win: {
            "score": F.avg("_loss").over(win.rowsBetween(-(w - 1), 0))}, key=self.key, back=w - 1, sizes=known)
        rows = with_model(rows.drop("_loss"), self.limits, self.key, ["threshold"])
        return rows.withColumn("is_anomaly", F.col("score") > F.col("threshold"))


@dataclass
class LagForecaster:
    """Next-value forecast from the last values; large standardised residuals are flagged.

    ``linear``: one regression over all series; ``gbt``: gradient-boosted trees.
    """

    lags: int
    coef: list[float] | None
    trees: PipelineModel | None
    rule: ZRule | None
    key: list[str]
    order: str
    y: str

    @classmethod
    def fit(cls, df: DataFrame, lags: int = 5, learner: str = "linear", k: float = THRESHOLD, key=None,
            order: str = "ds", y: str = "y") -> LagForecaster:
        model = cls(lags, None, None, None, as_list(key), order, y)
        rows = lag_features(df, lags, key=key, order=order, y=y)
        if learner == "linear":
            one = least_squares(rows, model._design(), F.col(y)).first()
            if one is None:
                raise ValueError(f"no rows with {lags} earlier values")
            model.coef = list(one["coef"])
        elif learner == "gbt":
            steps = [VectorAssembler(inputCols=model._names(), outputCol="_x"),
                     GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="y_pred", maxIter=20, seed=42)]
            train = keep_cached(rows.select(*model._names(), y))
            try:
                model.trees = Pipeline(stages=steps).fit(train)
            finally:
                train.unpersist()
        else:
            raise ValueError(f"unknown learner {learner!r}; known: linear, gbt")
        model.rule = ZRule.fit(model._predict(rows), k)
        return model

    def _names(self) -> list[str]:
        return [f"lag_{i}" for i in range(1, self.lags + 1)]

    def _design(self) -> list[Column]:
        return [F.lit(1.0), *[F.col(n).cast("double") for n in self._names()]]

    def _predict(self, rows: DataFrame) -> DataFrame:
        if self.trees is not None:
            rows = self.trees.transform(rows).drop("_x")
        else:
            rows = rows.withColumn("y_pred", linear(self._design(), self.coef))
        return rows.withColumn("error", F.col(self.y) - F.col("y_pred"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with enough earlier values in ``df``, with forecast and flag."""
        rows = lag_features(df, self.lags, key=self.key, order=self.order, y=self.y)
        return self.rule.apply(self._predict(rows)).drop(*self._names())
