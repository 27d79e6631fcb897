"""Density outliers: the noise points of DBSCAN, found with a grid.

A point is noise when no core point lies within ``eps``; a core point has at
least ``min_samples`` rows (itself included) within ``eps``.  Clusters
themselves are never needed, so neither is a connected-components search.

Equal points are merged into one weighted point first.  Cells have a diagonal
of ``eps``: a cell with ``min_samples`` rows consists of core points, and only
the points of the other, sparse cells have to look at their neighbourhood.
They compare themselves with the bounding boxes of neighbour cells; a box that
is neither wholly inside nor wholly outside the radius is split into halves
until it holds few points.  So a crowded cell is never joined point by point.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators.eda import Scaler
from lynceus.session import durable

# A cell with at most this many distinct points is compared point by point.
LEAF_POINTS = 64
# Neighbour cells are looked up through at most this many leading dimensions.
LOOKUP_DIMS = 4
# Fixed value: default radius in units of sigma.
DEFAULT_EPS = 2.0


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


class _Grid:
    """Counts of weighted points within ``eps`` of query points."""

    def __init__(self, p: int, eps: float):
        self.p, self.eps, self.side = p, eps, eps / sqrt(p)
        self.x = [f"x{i}" for i in range(p)]
        self.reach = ceil(sqrt(p) - 1e-12)

    def cell(self, level: int = 0) -> Column:
        return F.array(*[F.floor(F.col(c) / F.lit(self.side / 2 ** level)) for c in self.x])

    def boxes(self, points: DataFrame, level: int) -> DataFrame:
        """Non-empty cells: rows, marked rows, distinct points and bounding box."""
        ends = [f(c).alias(f"{n}{i}") for i, c in enumerate(self.x) for n, f in (("lo", F.min), ("hi", F.max))]
        return points.groupBy(self.cell(level).alias("cell")).agg(
            F.sum("w").alias("cw"), F.sum(F.col("w") * F.col("mark")).alias("cm"),
            F.count(F.lit(1)).alias("cn"), *ends)

    def diagonal2(self) -> Column:
        return _sum([F.pow(F.col(f"hi{i}") - F.col(f"lo{i}"), 2) for i in range(self.p)])

    def _gap2(self, far: bool) -> Column:
        def one(i: int) -> Column:
            below, above = F.col(f"lo{i}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"hi{i}")
            if far:
                return F.pow(F.greatest(F.abs(below), F.abs(above)), 2)
            return F.pow(F.greatest(below, above, F.lit(0.0)), 2)
        return _sum([one(i) for i in range(self.p)])

    def neighbour_cells(self, query_cells: DataFrame, cells: DataFrame) -> DataFrame:
        """(qcell, cell and its columns): cells that can hold points within reach."""
        dims = range(min(self.p, LOOKUP_DIMS))
        block = lambda c, i: F.floor(F.col(c)[i] / F.lit(self.reach))
        looked = query_cells.select(F.col("cell").alias("qcell"))
        for i in dims:
            near = F.array(*[block("qcell", i) + o for o in (-1, 0, 1)])
            looked = looked.withColumn(f"b{i}", F.explode(near))
        listed = cells.withColumns({f"b{i}": block("cell", i) for i in dims})
        pairs = looked.join(listed, [f"b{i}" for i in dims])
        for i in range(self.p):
            pairs = pairs.filter(F.abs(F.col("qcell")[i] - F.col("cell")[i]) <= self.reach)
        return pairs.drop(*[f"b{i}" for i in dims])

    def within(self, queries: DataFrame, points: DataFrame) -> DataFrame:
        """Per query ``pid``: rows (``weight``) and marked rows (``marked``) within eps.

        ``queries`` has pid and x0..; ``points`` has x0.., w and mark (0/1).
        Queries without any neighbour are absent from the result.
        """
        e2 = self.eps ** 2
        points = points.select(*self.x, "w", "mark")
        near, far = self._gap2(far=False), self._gap2(far=True)
        asked = queries.select("pid", *self.x, self.cell().alias("qcell"))
        pairs = self.neighbour_cells(asked.select(F.col("qcell").alias("cell")).distinct(),
                                     self.boxes(points, 0))
        open_pairs = asked.join(pairs, "qcell").filter(near <= e2)
        counted = []
        level = 0
        while True:
            open_pairs = durable(open_pairs.select("pid", *self.x, "cell", "cw", "cm", "cn",
                                                   (far <= e2).alias("inside")))
            counted.append(open_pairs.filter("inside").select(
                "pid", F.col("cw").alias("weight"), F.col("cm").alias("marked")))
            unsure = open_pairs.filter("not inside")
            small = unsure.filter(F.col("cn") <= LEAF_POINTS).select(
                "pid", "cell", *[F.col(c).alias(f"q{i}") for i, c in enumerate(self.x)])
            placed = points.withColumn("cell", self.cell(level))
            gap = _sum([F.pow(F.col(f"q{i}") - F.col(c), 2) for i, c in enumerate(self.x)])
            counted.append(small.join(placed, "cell").filter(gap <= e2).select(
                "pid", F.col("w").alias("weight"), (F.col("w") * F.col("mark")).alias("marked")))
            big = unsure.filter(F.col("cn") > LEAF_POINTS)
            if big.isEmpty():
                break
            level += 1
            inner = points.join(big.select("cell").distinct(), self.cell(level - 1) == F.col("cell"),
                                "left_semi")
            parent = F.transform("cell", lambda k: F.floor(k / F.lit(2)))
            children = self.boxes(inner, level).withColumn("parent", parent)
            open_pairs = (big.select("pid", *self.x, F.col("cell").alias("parent"))
                          .join(children, "parent").filter(near <= e2))
        return (reduce(lambda a, b: a.unionByName(b), counted).groupBy("pid")
                .agg(F.sum("weight").alias("weight"), F.sum("marked").alias("marked")))


def _weighted(df: DataFrame, scaler: Scaler, grid: _Grid) -> DataFrame:
    """Distinct scaled points with their number of rows and an id."""
    scaled = df.select(*[scaler.scaled(c).alias(x) for c, x in zip(scaler.cols, grid.x)])
    points = scaled.na.drop().groupBy(*grid.x).agg(F.count(F.lit(1)).alias("w"))
    return durable(points.withColumn("pid", F.monotonically_increasing_id()))


def _core_and_noise(points: DataFrame, grid: _Grid, min_samples: int) -> tuple[DataFrame, DataFrame]:
    dense = (grid.boxes(points.withColumn("mark", F.lit(0)), 0)
             .filter((F.col("cw") >= min_samples) & (grid.diagonal2() <= grid.eps ** 2))
             .select("cell", F.lit(1).alias("mark")))
    placed = durable(points.withColumn("cell", grid.cell()).join(dense, "cell", "left")
                     .na.fill(0, ["mark"]).drop("cell"))
    crowded, sparse = placed.filter("mark = 1"), placed.filter("mark = 0")
    near = grid.within(sparse, placed)
    found = durable(sparse.drop("mark").join(near, "pid", "left").na.fill(0, ["weight", "marked"]))
    is_core = F.col("weight") >= min_samples
    sparse_core = found.filter(is_core).select(*grid.x, "w")
    rest = found.filter(~is_core & (F.col("marked") == 0)).select("pid", *grid.x)
    edge = grid.within(rest, sparse_core.withColumn("mark", F.lit(0)))
    noise = rest.join(edge, "pid", "left_anti").select(*grid.x)
    return durable(crowded.select(*grid.x).unionByName(sparse_core.select(*grid.x))), durable(noise)


@dataclass
class DensityOutliers:
    """Fitted noise detector: scaler, radius, and the core points of the training rows."""

    scaler: Scaler
    eps: float
    min_samples: int
    core: DataFrame
    noise: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], eps: float = DEFAULT_EPS,
            min_samples: int | None = None) -> DensityOutliers:
        scaler = Scaler.fit(df, cols)
        min_samples = min_samples or 2 * len(cols)
        grid = _Grid(len(cols), eps)
        core, noise = _core_and_noise(_weighted(df, scaler, grid), grid, min_samples)
        return cls(scaler, eps, min_samples, core, noise)

    def _flag(self, df: DataFrame, noise: DataFrame) -> DataFrame:
        x = [f"x{i}" for i in range(len(self.scaler.cols))]
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in x])
        rows = df.withColumns({n: self.scaler.scaled(c) for n, c in zip(x, self.scaler.cols)})
        rows = rows.join(noise.select(*x, F.lit(True).alias("_hit")), x, "left")
        return (rows.withColumn("is_anomaly", F.when(known, F.coalesce("_hit", F.lit(False))))
                .drop("_hit", *x))

    def training_flags(self, df: DataFrame) -> DataFrame:
        """Flags of the rows the detector was fitted on."""
        return self._flag(df, self.noise)

    def transform(self, df: DataFrame, refit: bool = False) -> DataFrame:
        """Flag new rows: noise when no stored core point is within eps.

        ``refit=True`` clusters the new rows on their own, in the training scale.
        """
        grid = _Grid(len(self.scaler.cols), self.eps)
        points = _weighted(df, self.scaler, grid)
        if refit:
            return self._flag(df, _core_and_noise(points, grid, self.min_samples)[1])
        core = self.core.withColumns({"w": F.lit(1), "mark": F.lit(0)})
        # points that share a cell with a core point lie within eps of it
        held = core.select(grid.cell().alias("cell")).distinct()
        apart = durable(points.withColumn("cell", grid.cell()).join(held, "cell", "left_anti").drop("cell"))
        return self._flag(df, apart.join(grid.within(apart, core), "pid", "left_anti"))
