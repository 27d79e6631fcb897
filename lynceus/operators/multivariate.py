"""Mahalanobis distance, robust elliptic envelope, and PCA monitoring (T2 and SPE)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.distributions import chi2_quantile, normal_quantile
from lynceus.functions.moments import NARROW, covariance, linear, symmetric_eigen
from lynceus.functions.quantiles import exact_quantiles
from lynceus.operators.eda import Scaler

# Reweighting quantile and default contamination of the envelope.
REWEIGHT_QUANTILE = 0.975
DEFAULT_CONTAMINATION = 0.1
# Rows of the driver-side start sample, random starts, and steps on the full data.
START_ROWS, STARTS, MAX_STEPS = 2_000, 30, 30


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def distance2(cols: Sequence[Column], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance (whitening by the Cholesky factor)."""
    white = np.linalg.inv(np.linalg.cholesky(cov))
    if len(mean) > NARROW:
        return _wide(lambda x: ((x - mean) @ white.T) ** 2 @ np.ones((len(mean), 1)), ["d2"], cols)["d2"]
    centred = [c - F.lit(float(m)) for c, m in zip(cols, mean)]
    return _sum([F.pow(linear(centred[:k + 1], white[k, :k + 1]), 2) for k in range(len(mean))])


def _wide(compute, names: Sequence[str], cols: Sequence[Column]) -> Column:
    """A struct of values computed by numpy from batches of wide rows; null for incomplete rows."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    names, width = list(names), len(cols)

    @F.pandas_udf(schema)
    def block(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, width))
        return pd.DataFrame(compute(x.astype(float)), columns=names)

    row = F.array(*cols)
    complete = ~F.exists(row, lambda x: x.isNull())
    return F.when(complete, block(F.transform(row, lambda x: F.coalesce(x, F.lit(0.0)))))


def mahalanobis(df: DataFrame, cols: Sequence[str], contamination: float = DEFAULT_CONTAMINATION) -> DataFrame:
    """Classical distance with the population covariance; the largest distances are flagged."""
    m = covariance(df, cols)
    rows = df.withColumn("score", distance2([F.col(c) for c in cols], m.mean, m.cov))
    limit = exact_quantiles(rows, ["score"], [1 - contamination])["score"][0]
    return rows.withColumns({"threshold": F.lit(limit), "is_anomaly": F.col("score") > limit})


@dataclass
class EllipticEnvelope:
    """Minimum covariance determinant on scaled columns (Rousseeuw & Van Driessen 1999)."""

    scaler: Scaler
    mean: np.ndarray
    cov: np.ndarray
    threshold: float
    steps: int

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], contamination: float = DEFAULT_CONTAMINATION,
            seed: int = 0) -> EllipticEnvelope:
        if not 0 < contamination < 0.5:
            raise ValueError("contamination must lie between 0 and 0.5")
        scaler = Scaler.fit(df, cols)
        p = len(cols)
        names = [f"_z{i}" for i in range(p)]
        scaled = [scaler.scaled(c).alias(n) for c, n in zip(cols, names)]
        # a start sample of fixed size, the same for every partitioning
        sample = np.array([r[:p] for r in (
            df.select(*scaled, F.xxhash64(F.lit(seed), *df.columns).alias("_h")).na.drop()
            .orderBy("_h", *names).limit(START_ROWS).collect())], dtype=float)
        if len(sample) <= p:
            raise ValueError("too few complete rows for an envelope")
        mean, cov = _best_start(sample, seed)
        rows = df.select(*scaled).na.drop().persist()
        try:
            n = rows.count()
            h = (n + p + 1) // 2
            z = [F.col(c) for c in names]
            last, steps = np.inf, 0
            while steps < MAX_STEPS:
                steps += 1
                d2 = distance2(z, mean, cov)
                cut = exact_quantiles(rows.select(d2.alias("d")), ["d"], [(h - 1) / (n - 1)])["d"][0]
                m = covariance(rows, names, keep=d2 <= cut * (1 + 1e-12))
                mean, cov = m.mean, _solid(m.cov)
                det = np.linalg.slogdet(cov)[1]
                if last - det < 1e-9:
                    break
                last = det
            d2 = distance2(z, mean, cov)
            median = exact_quantiles(rows.select(d2.alias("d")), ["d"], [0.5])["d"][0]
            cov = cov * median / chi2_quantile(0.5, p)
            kept = covariance(rows, names, keep=distance2(z, mean, cov) < chi2_quantile(REWEIGHT_QUANTILE, p))
            mean, cov = kept.mean, _solid(kept.cov)
            d2 = distance2(z, mean, cov)
            limit = exact_quantiles(rows.select(d2.alias("d")), ["d"], [1 - contamination])["d"][0]
        finally:
            rows.unpersist()
        return cls(scaler, mean, cov, limit, steps)

    def transform(self, df: DataFrame) -> DataFrame:
        z = [self.scaler.scaled(c) for c in self.scaler.cols]
        rows = df.withColumn("score", distance2(z, self.mean, self.cov))
        return rows.withColumns({"threshold": F.lit(self.threshold),
                                 "is_anomaly": F.col("score") > self.threshold})


def _solid(cov: np.ndarray) -> np.ndarray:
    """Keep a covariance invertible when columns are exactly dependent."""
    floor = 1e-12 * max(1.0, float(np.trace(cov)))
    return cov + floor * np.eye(len(cov)) if np.linalg.eigvalsh(cov)[0] < floor else cov


def _concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    off = x - mean
    d2 = np.einsum("ij,ij->i", off @ np.linalg.inv(cov), off)
    kept = x[np.argpartition(d2, h - 1)[:h]]
    return kept.mean(axis=0), _solid(np.cov(kept.T, bias=True).reshape(x.shape[1], -1))


def _best_start(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Best of several random starts on the fixed-size sample."""
    n, p = x.shape
    h = (n + p + 1) // 2
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(STARTS):
        pick = x[rng.choice(n, p + 1, replace=False)]
        mean, cov = pick.mean(axis=0), _solid(np.cov(pick.T, bias=True).reshape(p, p))
        for _ in range(10):
            mean, cov = _concentrate(x, mean, cov, h)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = (det, mean, cov)
    return best[1], best[2]


@dataclass
class PcaMonitor:
    """PCA of scaled columns with Hotelling T2 and SPE (Q) control limits."""

    scaler: Scaler
    eigenvalues: np.ndarray
    loadings: np.ndarray  # p x k
    t2_limit: float
    spe_limit: float

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], n_components: float | int = 0.95,
            alpha: float = 0.05) -> PcaMonitor:
        scaler = Scaler.fit(df, cols)
        m = covariance(df, [scaler.scaled(c) for c in cols])
        values, vectors = symmetric_eigen(m.cov)
        values = np.maximum(values, 0.0)
        if isinstance(n_components, int):
            k = min(n_components, len(cols))
        else:
            share = np.cumsum(values) / values.sum()
            k = int(min(len(cols), np.searchsorted(share, n_components - 1e-12) + 1))
        return cls(scaler, values, vectors[:, :k], chi2_quantile(1 - alpha, k),
                   spe_control_limit(values[k:], alpha))

    @property
    def k(self) -> int:
        return self.loadings.shape[1]

    def scores(self) -> list[Column]:
        z = [self.scaler.scaled(c) for c in self.scaler.cols]
        return [linear(z, self.loadings[:, j]) for j in range(self.k)]

    def _statistics(self, df: DataFrame) -> DataFrame:
        z = [self.scaler.scaled(c) for c in self.scaler.cols]
        if len(z) > NARROW:
            loadings, roots = self.loadings, np.sqrt(np.maximum(self.eigenvalues[:self.k], 1e-300))

            def both(x: np.ndarray) -> np.ndarray:
                t = x @ loadings
                return np.column_stack([((t / roots) ** 2).sum(axis=1), ((x - t @ loadings.T) ** 2).sum(axis=1)])

            rows = df.withColumn("_both", _wide(both, ["t2", "spe"], z))
            return rows.withColumns({n: F.col(f"_both.{n}") for n in ("t2", "spe")}).drop("_both")
        names = [f"_t{j}" for j in range(self.k)]
        rows = df.withColumns(dict(zip(names, self.scores())))
        t = [F.col(n) for n in names]
        t2 = _sum([F.pow(c, 2) / F.lit(float(max(v, 1e-300))) for c, v in zip(t, self.eigenvalues)])
        left = [zi - linear(t, self.loadings[i]) for i, zi in enumerate(z)]
        spe = _sum([F.pow(c, 2) for c in left])
        return rows.withColumns({"t2": t2, "spe": spe}).drop(*names)

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self._statistics(df)
        return rows.withColumns({
            "t2_limit": F.lit(self.t2_limit), "is_t2": F.col("t2") > self.t2_limit,
            "spe_limit": F.lit(self.spe_limit), "is_spe": F.col("spe") > self.spe_limit})

    def biplot_scores(self, df: DataFrame) -> DataFrame:
        """First two scores and the class of every row: inlier, t2, spe or both."""
        rows = df.withColumns({f"pc{j + 1}": c for j, c in enumerate(self.scores()[:2])})
        rows = self.transform(rows)
        kind = (F.when(F.col("is_t2") & F.col("is_spe"), "both").when(F.col("is_t2"), "t2")
                .when(F.col("is_spe"), "spe").otherwise("inlier"))
        return rows.withColumn("outlier_class", kind)

    def loading_rows(self) -> list[tuple[str, int, float]]:
        """(column, component from 1, loading): p x k rows."""
        return [(c, j + 1, float(self.loadings[i, j]))
                for i, c in enumerate(self.scaler.cols) for j in range(self.k)]

    def explained_variance(self) -> list[tuple[int, float, float, float]]:
        """(component, eigenvalue, ratio, cumulative ratio): p rows."""
        total = self.eigenvalues.sum()
        ratios = self.eigenvalues / total
        return [(i + 1, float(v), float(r), float(c)) for i, (v, r, c) in
                enumerate(zip(self.eigenvalues, ratios, np.cumsum(ratios)))]


def spe_control_limit(left: np.ndarray, alpha: float) -> float:
    """Jackson & Mudholkar (1979) limit of the squared residual; 0 when nothing is left out."""
    theta = [float((left ** i).sum()) for i in (1, 2, 3)]
    if theta[0] <= 1e-12:
        return 1e-9
    h0 = 1 - 2 * theta[0] * theta[2] / (3 * theta[1] ** 2)
    c = normal_quantile(1 - alpha)
    inner = (c * (2 * theta[1] * h0 ** 2) ** 0.5 / theta[0] + 1
             + theta[1] * h0 * (h0 - 1) / theta[0] ** 2)
    return theta[0] * max(inner, 0.0) ** (1 / h0)
