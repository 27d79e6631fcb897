"""Exploratory statistics, scaling and the tables behind the reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.quantiles import exact_quantiles
from lynceus.operators.ordering import as_list
from lynceus.operators.shaping import require_columns
from lynceus.session import sized


def _long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name: str = "sensor",
          value: str = "value") -> DataFrame:
    require_columns(df, [*cols, *keep])
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(keep), list(cols), name, value)


def _extent(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(F.col(c).cast("double")) for c in cols for f in (F.min, F.max)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}


def _bin_number(value: Column, low: Column, width: Column, bins: int) -> Column:
    return (F.when(width > 0, F.least(F.floor((value - low) / width), F.lit(bins - 1)))
            .otherwise(F.lit(0)).cast("int"))


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram of numeric columns, value counts of the others (one pass each)."""
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    other = [c for c in cols if c not in numeric]
    parts = []
    if numeric:
        ends = {c: e for c, e in _extent(df, numeric).items() if e[0] is not None}
        low, width = F.lit(None).cast("double"), F.lit(None).cast("double")
        for c, (first, last) in ends.items():
            low = F.when(F.col("sensor") == c, F.lit(first)).otherwise(low)
            width = F.when(F.col("sensor") == c, F.lit((last - first) / bins)).otherwise(width)
        rows = (_long(df, list(ends)).filter(F.col("value").isNotNull())
                .withColumns({"_low": low, "_width": width}))
        number = _bin_number(F.col("value"), F.col("_low"), F.col("_width"), bins)
        parts.append(rows.groupBy("sensor", number.alias("bin"), "_low", "_width")
                     .agg(F.count(F.lit(1)).alias("n"))
                     .select("sensor", F.lit(None).cast("string").alias("category"), "bin",
                             (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_from"), "n"))
    if other:
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in other])
        parts.append(texts.unpivot([], other, "sensor", "category")
                     .groupBy("sensor", "category").agg(F.count(F.lit(1)).alias("n"))
                     .select("sensor", "category", F.lit(None).cast("int").alias("bin"),
                             F.lit(None).cast("double").alias("bin_from"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def binned_counts(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Fixed number of bins over [min, max], right edge closed, with bin centres; empty bins are 0."""
    low, high = _extent(df, [col])[col]
    if low is None:
        raise ValueError(f"column {col} has no values")
    width = (high - low) / bins
    value = F.col(col).cast("double")
    counts = (df.filter(value.isNotNull())
              .groupBy(_bin_number(value, F.lit(low), F.lit(width), bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (every.join(counts, "bin", "left")
            .select("bin", (F.lit(low) + (F.col("bin") + 0.5) * width).alias("centre"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (rows complete in the pair), long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"),
                                  F.col(f"c{i}").alias("corr")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return one.unpivot([], cols, "col_name", "n_missing")


def spc_zones(df: DataFrame, col: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Control limits (mean, 1/2/3 sigma) and the zone of every row.

    C: within one sigma, B: within two, A: within three, OUT: beyond.
    """
    by = as_list(by)
    value = F.col(col).cast("double")
    stats = [F.avg(value).alias("centre"), F.stddev_pop(value).alias("sigma")]
    if by:
        rows = df.join(sized(df.groupBy(*by).agg(*stats)), by)
    else:
        one = df.agg(*stats).first()
        rows = df.withColumns({"centre": F.lit(one[0]), "sigma": F.lit(one[1])})
    off = F.abs(value - F.col("centre"))
    zone = F.when(value.isNull(), None)
    for k, name in ((1, "C"), (2, "B"), (3, "A")):
        zone = zone.when(off <= k * F.col("sigma"), name)
    limits = {f"{side}{k}": F.col("centre") + sign * k * F.col("sigma")
              for side, sign in (("ucl", 1), ("lcl", -1)) for k in (1, 2, 3)}
    return rows.withColumns({**limits, "zone": zone.otherwise("OUT")})


@dataclass
class Scaler:
    """Standard scaling with the population sigma; a constant column has sigma 1."""

    mean: dict[str, float]
    sigma: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> Scaler:
        require_columns(df, cols)
        row = df.agg(*[f(F.col(c).cast("double")) for c in cols for f in (F.avg, F.stddev_pop)]).first()
        if any(v is None for v in row):
            raise ValueError("cannot scale columns without values")
        return cls({c: row[2 * i] for i, c in enumerate(cols)},
                   {c: row[2 * i + 1] or 1.0 for i, c in enumerate(cols)})

    @property
    def cols(self) -> list[str]:
        return list(self.mean)

    def scaled(self, col: str) -> Column:
        return (F.col(col).cast("double") - F.lit(self.mean[col])) / F.lit(self.sigma[col])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.cols})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.sigma[c]) + F.lit(self.mean[c])
                               for c in self.cols})


def anomaly_counts(df: DataFrame, by: str | Sequence[str] | None = None,
                   flag: str = "is_anomaly") -> DataFrame:
    hits = F.count(F.when(F.col(flag), 1))
    return df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"), hits.alias("n_anomalies"),
                                        (hits / F.count(F.lit(1))).alias("anomaly_ratio"))


def class_series(df: DataFrame, cols: Sequence[str], class_col: str, ds: str = "ds",
                 keep: Sequence[str] = ()) -> DataFrame:
    """One long table (ds, class, sensor, value) behind the per-class charts."""
    return _long(df, cols, [ds, class_col, *keep])


def outlier_overlay(df: DataFrame, cols: Sequence[str], flag: str = "is_anomaly", ds: str = "ds",
                    only_outliers: bool = False) -> DataFrame:
    rows = df.filter(F.col(flag)) if only_outliers else df
    return _long(rows, cols, [ds, flag])


# Up to this many bin edges are compared one by one.
CODEGEN_EDGES = 32


@dataclass
class QuantileBinner:
    """Quantile binning with frozen edges; repeated edges are dropped.

    Bins are closed on the right, the first also on the left; values outside
    the training range fall into the first or last bin.
    """

    edges: dict[str, list[float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], q: int = 100) -> QuantileBinner:
        found = exact_quantiles(df, cols, [i / q for i in range(q + 1)])
        return cls({c: sorted(set(found[c])) for c in cols})

    def bins(self, col: str) -> int:
        return max(1, len(self.edges[col]) - 1)

    def bin_of(self, col: str) -> Column:
        inner = self.edges[col][1:-1]
        if not inner:
            return F.when(F.col(col).isNotNull(), F.lit(0))
        if len(inner) <= CODEGEN_EDGES:
            # plain comparisons stay inside generated code
            number = F.lit(0)
            for e in inner:
                number = number + (F.col(col) > F.lit(float(e))).cast("int")
            return number
        edges = F.array(*[F.lit(float(e)) for e in inner])
        return F.when(F.col(col).isNotNull(), F.size(F.filter(edges, lambda e: e < F.col(col))))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.bin_of(c) for c in self.edges})


def fit_table(actual: DataFrame, fitted: DataFrame, key: str | Sequence[str] | None = None,
              y: str = "y", y_hat: str = "y_pred") -> DataFrame:
    """Fit-versus-actual rows (ds, y, fitted value, error) behind the series reports."""
    return (actual.join(fitted, [*as_list(key), "ds"])
            .select(*as_list(key), "ds", y, y_hat, (F.col(y) - F.col(y_hat)).alias("error")))
