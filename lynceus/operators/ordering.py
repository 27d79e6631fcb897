"""Order-dependent columns without handing a large group to one task.

A window over ``partitionBy(key)`` is the right plan while every group fits a
task.  The size is therefore checked first: groups of at most
``max_rows_per_task()`` rows use that plan.  Larger data is range-partitioned
on (key, order), which also cuts a hot key into consecutive segments, and
windows run per (key, segment).  Frames that reach over a segment edge see the
missing neighbours as copied halo rows; the number of halo rows is bounded by
segments x reach, because only one key can straddle an edge.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lynceus.session import BROADCAST_ROWS, durable

ROWS_SETTING = "spark.lynceus.maxRowsPerTask"
DEFAULT_ROWS = 1_000_000


def as_list(names: str | Sequence[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def max_rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_SETTING, str(DEFAULT_ROWS)))


def group_sizes(df: DataFrame, key: str | Sequence[str] | None = None) -> tuple[int, int]:
    """(rows of the largest group, rows in all)."""
    key = as_list(key)
    if not key:
        n = df.count()
        return n, n
    row = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
           .agg(F.max("n"), F.sum("n")).first())
    return row[0] or 0, row[1] or 0




# A grouped Python task should get at least this many rows while cores are idle.
PYTHON_TASK_ROWS = 5_000


def spread(df: DataFrame, by: str | Sequence[str], n_rows: int) -> DataFrame:
    """Hash-partition the input of a grouped Python function by its grouping columns.

    Adaptive coalescing sizes partitions in bytes, far too large for Python
    work on small rows; the partition count is set by rows instead.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = max(min(4 * cores, n_rows // PYTHON_TASK_ROWS), ceil(n_rows / max_rows_per_task(spark)), 1)
    return df.repartition(parts, *as_list(by))


class _Segments:
    """Rows cut into consecutive, size-bounded segments of the total order."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str], rows: int, limit: int):
        parts = max(2, ceil(2 * rows / limit))
        self.key, self.order = key, order
        self.rows = durable(df.repartitionByRange(parts, *key, *order)
                            .withColumn("_seg", F.spark_partition_id()))
        sizes = self.rows.groupBy(*key, "_seg").agg(F.count(F.lit(1)).alias("_n"))
        if key:
            span = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("_pieces")).filter("_pieces > 1")
            sizes = sizes.join(span.select(*[F.col(k).alias(f"_k_{k}") for k in key]),
                               _same_as(sizes, key), "left_semi")
        # at most two (key, segment) pairs per segment edge: at most 2 * parts rows
        self.bounded = 2 * parts <= BROADCAST_ROWS
        before = Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        self.pieces = sizes.select(*key, "_seg", "_n",
                                   F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def _hinted(self, pieces: DataFrame) -> DataFrame:
        return F.broadcast(pieces) if self.bounded else pieces

    def indexed(self) -> DataFrame:
        """Rows with ``_rn`` (1.. in the segment), ``_n`` and ``_before`` (null unless the key is cut)."""
        within = Window.partitionBy(*self.key, "_seg").orderBy(*self.order)
        rows = self.rows.withColumn("_rn", F.row_number().over(within))
        pieces = self.pieces.select(*[F.col(k).alias(f"_k_{k}") for k in self.key],
                                    F.col("_seg").alias("_k_seg"), "_n", "_before")
        cond = _same_as(rows, self.key) & (rows["_seg"] == F.col("_k_seg"))
        return (rows.join(self._hinted(pieces), cond, "left")
                .drop("_k_seg", *[f"_k_{k}" for k in self.key]))

    def with_halo(self, back: int, ahead: int) -> DataFrame:
        cols = self.rows.columns
        body = self.rows.withColumn("_halo", F.lit(False))
        edge = (self.indexed().filter(F.col("_n").isNotNull())
                .filter((F.col("_n") - F.col("_rn") < back) | (F.col("_rn") <= ahead))
                .withColumn("_idx", F.col("_before") + F.col("_rn"))
                .drop("_rn", "_n", "_before"))
        # row numbers in buckets as long as the reach: what a segment lacks lies in the buckets of its ends,
        # so that the join has an equality even where there is no key
        reach = max(back, ahead, 1)
        bucket = lambda c: F.floor(c / F.lit(reach)).cast("long")
        first, last = F.col("_first"), F.col("_last")
        target = (self.pieces.select(*[F.col(k).alias(f"_k_{k}") for k in self.key],
                                     F.col("_seg").alias("_to"), F.col("_before").alias("_first"),
                                     (F.col("_before") + F.col("_n")).alias("_last"))
                  .withColumn("_k_bucket", F.explode(F.array_distinct(F.array(
                      bucket(first - back + 1), bucket(first), bucket(last + 1), bucket(last + ahead))))))
        edge = edge.withColumn("_bucket", bucket(F.col("_idx")))
        near = (((F.col("_idx") > F.col("_first") - back) & (F.col("_idx") <= F.col("_first")))
                | ((F.col("_idx") > F.col("_last")) & (F.col("_idx") <= F.col("_last") + ahead)))
        halo = (edge.join(self._hinted(target), _same_as(edge, self.key) & (F.col("_bucket") == F.col("_k_bucket")) & near)
                .withColumn("_seg", F.col("_to")).select(*cols, F.lit(True).alias("_halo")))
        return body.unionByName(halo)


def _same_as(left: DataFrame, key: list[str]) -> Column:
    cond = F.lit(True)
    for name in key:
        cond = cond & left[name].eqNullSafe(F.col(f"_k_{name}"))
    return cond


def over_order(df: DataFrame, order: str | Sequence[str],
               columns: Callable[[WindowSpec], dict[str, Column]],
               key: str | Sequence[str] | None = None, back: int = 0, ahead: int = 0,
               limit: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Append columns that look at most ``back`` rows behind and ``ahead`` rows in front.

    ``columns`` receives a window partitioned by the key and ordered by
    ``order`` (which must be a total order within a key).  ``sizes`` passes on
    a known ``group_sizes`` of the rows, or an upper bound of it.
    """
    key, order = as_list(key), as_list(order)
    limit = limit or max_rows_per_task(df.sparkSession)
    largest, total = sizes or group_sizes(df, key)
    if largest <= limit:
        new = columns(Window.partitionBy(*key).orderBy(*order))
        return df.select("*", *[c.alias(n) for n, c in new.items()])
    rows = _Segments(df, key, order, total, limit).with_halo(back, ahead)
    new = columns(Window.partitionBy(*key, "_seg").orderBy(*order))
    rows = rows.select("*", *[c.alias(n) for n, c in new.items()])
    return rows.filter(~F.col("_halo")).drop("_halo", "_seg")


def row_index(df: DataFrame, order: str | Sequence[str], key: str | Sequence[str] | None = None,
              name: str = "row_idx", limit: int | None = None,
              sizes: tuple[int, int] | None = None) -> DataFrame:
    """Number the rows 0, 1, 2, ... along ``order`` (per key, when one is given)."""
    key, order = as_list(key), as_list(order)
    limit = limit or max_rows_per_task(df.sparkSession)
    largest, total = sizes or group_sizes(df, key)
    if largest <= limit:
        number = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        return df.withColumn(name, (number - 1).cast("long"))
    rows = _Segments(df, key, order, total, limit).indexed()
    return (rows.withColumn(name, (F.col("_rn") - 1 + F.coalesce("_before", F.lit(0))).cast("long"))
            .drop("_seg", "_rn", "_n", "_before"))
