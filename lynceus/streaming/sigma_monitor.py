"""Running control limit per series, carried across batches.

The rows of a batch are judged by the mean and sigma of all earlier batches.
A batch reaches the carried state only as one partial aggregate per series
(count, mean, sum of squared deviations), so a busy series costs no more state
or shuffle than a quiet one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lynceus.operators.ordering import as_list
from lynceus.plans.store import folder_exists

DEFAULT_K = 3.0


def partial_moments(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"),
                               (F.var_pop(y) * F.count(y)).alias("m2"))


def merge_moments(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combine partial moments: the total mean first, then deviations within the parts and of their means from it."""
    parts = parts.filter(F.col("n") > 0)
    total = (parts.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("total_mean"))
             .select(*[F.col(c).alias(f"_k_{c}") for c in by], "total_mean"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    apart = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("total_mean"), 2)
    return (parts.join(total, same).groupBy(*by)
            .agg(F.sum("n").alias("n"), F.first("total_mean").alias("mean"), F.sum(apart).alias("m2")))


def judge(rows: DataFrame, state: DataFrame, by: Sequence[str], y: str, k: float) -> DataFrame:
    """Flag rows outside mean +- k sigma of the state; series without a state are not flagged."""
    limits = state.select(*by, "mean", F.sqrt(F.col("m2") / F.col("n")).alias("sigma"))
    out = rows.join(limits, list(by), "left")
    flag = F.coalesce(F.abs(F.col(y) - F.col("mean")) > k * F.col("sigma"), F.lit(False))
    return out.withColumn("is_anomaly", flag)


def batch_sigma(df: DataFrame, key: str | Sequence[str], batch: str = "batch_no", y: str = "y",
                k: float = DEFAULT_K) -> DataFrame:
    """The monitor over a table whose ``batch`` column numbers the batches."""
    by = as_list(key)
    parts = partial_moments(df, [*by, batch], y)
    # one row per series and batch
    earlier = Window.partitionBy(*by).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    # means count from the series' first one, so that a large offset doesn't swallow the deviations
    start = F.first("mean", ignorenulls=True).over(
        Window.partitionBy(*by).orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.withColumn("_start", start).withColumn("_d", F.col("mean") - F.col("_start"))
    total = F.sum("n").over(earlier)
    shift = F.sum(F.col("n") * F.col("_d")).over(earlier) / total
    spread = (F.sum("m2").over(earlier) + F.sum(F.col("n") * F.pow("_d", 2)).over(earlier)
              - total * F.pow(shift, 2))
    state = parts.select(*by, batch, total.alias("n"), (F.col("_start") + shift).alias("mean"),
                         F.greatest(spread, F.lit(0.0)).alias("m2")).filter("n > 0")
    return judge(df, state, [*by, batch], y, k)


def stream_sigma(source: DataFrame, key: str | Sequence[str], out: str, checkpoint: str, y: str = "y",
                 k: float = DEFAULT_K, continuous: bool = False) -> StreamingQuery:
    """Judge every micro-batch by the earlier ones; rows go to ``out``/rows, one folder per batch.

    The state after every batch is stored under its id and a batch starts from
    that of the batch before it, so a repeated batch gives the same result.
    """
    by = as_list(key)
    out = out.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            parts = partial_moments(batch, by, y)
            before = f"{out}/state/batch_id={batch_id - 1}"
            state = spark.read.parquet(before) if folder_exists(spark, before) else parts.filter(F.lit(False))
            judge(batch, state, by, y, k).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
            merge_moments(state.unionByName(parts), by).write.mode("overwrite").parquet(
                f"{out}/state/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.start() if continuous else writer.trigger(availableNow=True).start()


def judged_rows(spark: SparkSession, out: str) -> DataFrame:
    path = f"{out.rstrip('/')}/rows"
    if not folder_exists(spark, path):
        raise ValueError(f"no judged rows under {out}")
    return spark.read.parquet(path)
