"""Isolation forest (Liu, Ting & Zhou 2008).

Each tree grows from a fixed number of rows, so growing is one small grouped
task per tree, and scoring is a vectorised map over the rows.  Columns are not
scaled: the trees are the same on any scale.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.quantiles import exact_quantiles
from lynceus.operators.ordering import spread

SUBSAMPLE = 256
EULER = 0.5772156649015329
NODES = "tree int, node int, feature int, cut double, low int, high int, length double"


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (log(n - 1) + EULER) - 2 * (n - 1) / n


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """One random tree; leaves carry the expected path length of their rows."""
    rng = np.random.default_rng([seed, tree])
    limit = ceil(log(max(len(x), 2), 2))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 if side == "low" else 5] = me
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append([tree, me, -1, 0.0, me, me, depth + average_path(len(rows))])
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] <= cut
        nodes.append([tree, me, f, cut, 0, 0, 0.0])
        todo += [(rows[below], depth + 1, me, "low"), (rows[~below], depth + 1, me, "high")]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "length"])


@dataclass
class IsolationForest:
    cols: list[str]
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    subsample: int
    threshold: float

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], row_key: str | Sequence[str] | None = None,
            n_trees: int = 100, contamination: float | str = "auto", seed: int = 0) -> IsolationForest:
        """``row_key`` names columns that are unique per row.

        Without it equal rows are merged into weighted ones first, at the price
        of one shuffle, so that copies of a row are drawn in proportion.
        """
        names = [f"_z{i}" for i in range(len(cols))]
        plain = [F.col(c).cast("double").alias(z) for c, z in zip(cols, names)]
        if row_key:
            keys = [row_key] if isinstance(row_key, str) else list(row_key)
            rows = df.select(*plain, F.lit(1).alias("w"), F.xxhash64(F.lit(seed), *keys).alias("_h"))
        else:
            rows = df.select(*plain).groupBy(*names).agg(F.count(F.lit(1)).alias("w"))
            rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), *names))
        rows = rows.na.drop(subset=names)
        n = rows.agg(F.sum("w")).first()[0]
        psi = min(SUBSAMPLE, n)
        # expected rows per tree: psi and some slack, of which exactly psi are kept
        share = min(1.0, (psi + 6 * sqrt(psi) + 6) / n)

        # u decides the first tree a row enters (a geometric draw), so that almost
        # all rows leave after one hash; each later tree is an own draw
        chance = F.col("w") * F.lit(share)
        uniform = lambda *c: F.pmod(F.xxhash64(*c), F.lit(2 ** 53)) / F.lit(2.0 ** 53)
        first = F.when(chance >= 1, 0.0).otherwise(F.floor(F.log1p(-uniform("_h")) / F.log1p(-chance)))
        drawn = rows.withColumns({"_p": chance, "_first": first}).filter(F.col("_first") < n_trees)

        def copies(tree: Column) -> Column:
            hit = F.when(uniform(tree, "_h") < F.col("_p") - F.floor("_p"), 1).otherwise(0)
            single = F.when(tree == F.col("_first"), 1).when(tree > F.col("_first"), hit).otherwise(0)
            return F.when(F.col("_p") >= 1, F.floor("_p") + hit).otherwise(single)

        draws = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                            lambda t: F.struct(t.alias("tree"), copies(t).alias("copies")))
        drawn = (drawn.select("_h", *names, F.explode(F.filter(draws, lambda d: d["copies"] > 0)).alias("_d"))
                 .select("_d.tree", "_d.copies", "_h", *names))

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_h", *names])
            x = np.repeat(pdf[names].to_numpy(float), pdf["copies"].to_numpy(), axis=0)
            tree = int(key[0])
            keep = np.random.default_rng([seed, tree, 1]).permutation(len(x))[:psi]
            return _grow(tree, x[np.sort(keep)], seed)

        # n_trees x at most 2 * psi nodes: a size fixed by the parameters
        nodes = spread(drawn, "tree", psi * n_trees).groupBy("tree").applyInPandas(grow, NODES).toPandas()
        width = int(nodes["node"].max()) + 1
        index = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())

        def packed(name: str, dtype, fill):
            out = np.full((n_trees, width), fill, dtype)
            out[index] = nodes[name].to_numpy()
            return out

        model = cls(list(cols), packed("feature", np.int32, -1), packed("cut", float, 0.0),
                    packed("low", np.int32, 0), packed("high", np.int32, 0),
                    packed("length", float, 0.0), psi, 0.5)
        if contamination != "auto":
            scored = df.select(model.score().alias("score"))
            model.threshold = exact_quantiles(scored, ["score"], [1 - float(contamination)])["score"][0]
        return model

    def score(self) -> Column:
        """Anomaly score 2**(-mean path / c(psi)); null for incomplete rows."""
        feature, cut, low, high, length = self.feature, self.cut, self.low, self.high, self.length
        scale = average_path(self.subsample) or 1.0

        @F.pandas_udf(T.DoubleType())
        def path_score(block: pd.DataFrame) -> pd.Series:
            x = block.to_numpy(float)
            at = np.arange(len(x))
            total = np.zeros(len(x))
            for t in range(len(feature)):
                node = np.zeros(len(x), np.int32)
                active = feature[t, node] >= 0
                while active.any():
                    f = np.where(active, feature[t, node], 0)
                    node = np.where(active, np.where(x[at, f] <= cut[t, node], low[t, node], high[t, node]), node)
                    active = feature[t, node] >= 0
                total += length[t, node]
            out = 2.0 ** (-total / len(feature) / scale)
            return pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, out))

        value = path_score(F.struct(*[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(self.cols)]))
        return F.nanvl(value, F.lit(None).cast("double"))

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("score", self.score())
        flag = F.col("score") > self.threshold
        return rows.withColumns({"threshold": F.lit(self.threshold), "is_anomaly": flag,
                                 "label": F.when(flag, -1).otherwise(1)})
