"""Means, covariances and Gram matrices of distributed data.

Few columns: one Catalyst aggregation.  Wide vectors: every task adds up its
own Gram matrix from Arrow batches, and only these partial sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.operators.ordering import as_list


# Up to this many columns moments and projections are Catalyst expressions; wider
# vectors go through Arrow batches and numpy.
NARROW = 16


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray  # population covariance


def covariance(df: DataFrame, cols: Sequence[str | Column], keep: Column | None = None) -> Moments:
    """Moments over the complete rows (of those that satisfy ``keep``), in one pass."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols]
    if keep is not None:
        df = df.filter(keep)
    p = len(cols)
    rows = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(cols)]).na.drop()
    cols = [F.col(f"_c{i}") for i in range(p)]
    if p > NARROW:
        return vector_moments(rows.select(F.array(*cols).alias("_v")), "_v", p)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols],
                 *[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).first()
    if not row[0]:
        raise ValueError("no rows to compute a covariance from")
    cov = np.zeros((p, p))
    for (i, j), value in zip(pairs, row[1 + p:]):
        cov[i, j] = cov[j, i] = value
    return Moments(row[0], np.array(row[1:1 + p], dtype=float), cov)


def gram(df: DataFrame, vector: str, p: int, by: str | Sequence[str] | None = None) -> DataFrame:
    """Sum of x x' over the vectors ``vector`` (array<double> of length p), per ``by``.

    Returns by..., ``n`` and ``gram`` (p*p values, row by row).
    """
    by = as_list(by)
    rows = df.select(*by, F.col(vector).cast("array<double>").alias("_x")).filter(F.col("_x").isNotNull())
    fields = [rows.schema[b] for b in by]
    partial = T.StructType(fields + [T.StructField("n", T.LongType()),
                                     T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[int, np.ndarray]] = {}
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = types or [batch.schema.field(b).type for b in by]
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            if by:
                keys = pd.MultiIndex.from_arrays([batch.column(b).to_pylist() for b in by])
                groups = pd.Series(np.arange(len(x))).groupby(keys, sort=False, dropna=False).indices.items()
            else:
                groups = [((), slice(None))]
            for name, at in groups:
                name = name if isinstance(name, tuple) else (name,)
                part = x[at]
                n, s = sums.get(name, (0, 0.0))
                sums[name] = (n + len(part), s + part.T @ part)
            if len(sums) * p * p > 4_000_000:
                yield flush(sums, types)
                sums = {}
        if sums:
            yield flush(sums, types)

    def flush(sums: dict, types: list) -> pa.RecordBatch:
        names = list(sums)
        arrays = [pa.array([k[i] for k in names], type=types[i]) for i in range(len(by))]
        arrays.append(pa.array([sums[k][0] for k in names], type=pa.int64()))
        arrays.append(pa.array([sums[k][1].ravel() for k in names], type=pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(arrays, names=[*by, "n", "gram"])

    cells = (rows.mapInArrow(add_up, partial)
             .select(*by, F.posexplode("gram").alias("_pos", "_s"), "n")
             .groupBy(*by, "_pos").agg(F.sum("_s").alias("_s"), F.sum("n").alias("n")))
    # p*p cells per key: a size fixed by the width of the vectors
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_s")))
    return (cells.groupBy(*by).agg(F.max("n").alias("n"), ordered.alias("_cells"))
            .select(*by, "n", F.transform("_cells", lambda c: c["_s"]).alias("gram")))


def vector_moments(df: DataFrame, vector: str, p: int) -> Moments:
    """Moments of wide vectors; sums are taken around the first row for precision."""
    origin = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null").first()
    if origin is None:
        raise ValueError("no rows to compute a covariance from")
    c = np.array(origin[0])
    shifted = F.transform(F.zip_with(F.col(vector).cast("array<double>"),
                                     F.array(*[F.lit(float(v)) for v in c]), lambda a, b: a - b),
                          lambda a: a)
    one = df.withColumn("_v", F.concat(F.array(F.lit(1.0)), shifted))
    row = gram(one, "_v", p + 1).first()
    g = np.array(row["gram"]).reshape(p + 1, p + 1)
    n = g[0, 0]
    d = g[0, 1:] / n
    return Moments(int(n), c + d, g[1:, 1:] / n - np.outer(d, d))


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and vectors whose first largest entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = np.abs(vectors)
    # entries that tie up to rounding count as equal
    first = (size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
    return values, vectors * np.where(vectors[first, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def linear(cols: Sequence[Column], weights: Sequence[float], constant: float = 0.0) -> Column:
    """constant + sum of weight * column, as one expression."""
    out = F.lit(float(constant))
    for col, w in zip(cols, weights):
        out = out + F.lit(float(w)) * col
    return out
