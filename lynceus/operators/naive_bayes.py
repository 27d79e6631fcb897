"""Gaussian naive Bayes on scaled columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators.eda import Scaler

# Fixed value: share of the largest column variance added to every variance.
VARIANCE_SMOOTHING = 1e-9


@dataclass
class GaussianNB:
    scaler: Scaler
    classes: list
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], target: str = "target") -> GaussianNB:
        scaler = Scaler.fit(df, cols)
        z = [scaler.scaled(c) for c in cols]
        rows = (df.filter(F.col(target).isNotNull()).groupBy(target)
                .agg(F.count(F.lit(1)), *[F.avg(c) for c in z], *[F.var_pop(c) for c in z])
                .orderBy(target).collect())  # one row per class
        n, p = sum(r[1] for r in rows), len(cols)
        floor = VARIANCE_SMOOTHING  # the scaled columns have variance 1
        return cls(scaler, [r[0] for r in rows], [r[1] / n for r in rows],
                   [list(r[2:2 + p]) for r in rows], [[v + floor for v in r[2 + p:]] for r in rows])

    def _log_joint(self, i: int) -> Column:
        terms = [F.lit(log(self.priors[i]))]
        for c, m, v in zip(self.scaler.cols, self.means[i], self.variances[i]):
            terms.append(F.lit(-0.5 * log(2 * pi * v))
                         - F.pow(self.scaler.scaled(c) - F.lit(m), 2) / F.lit(2 * v))
        return reduce(lambda a, b: a + b, terms)

    def transform(self, df: DataFrame) -> DataFrame:
        """Most probable class (ties: smallest label) and its log joint density."""
        names = [f"_j{i}" for i in range(len(self.classes))]
        rows = df.withColumns({n: self._log_joint(i) for i, n in enumerate(names)})
        best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        rows = rows.withColumn("log_joint", best)
        label = F.lit(None)
        for name, c in reversed(list(zip(names, self.classes))):
            label = F.when(F.col(name) == F.col("log_joint"), F.lit(c)).otherwise(label)
        return rows.withColumn("y_pred", label).drop(*names)
