"""Shaping of sensor tables: pivot, time stamps, canonical frames, splits, windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.operators.ordering import as_list, group_sizes, row_index
from lynceus.session import sized

# Strftime directives and the datetime pattern letters they stand for.
STRFTIME_PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%z": "xx",
}

# Epoch units and the number of microseconds in each.
EPOCH_UNITS = {"D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000,
               "ms": 1_000, "us": 1}


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def pivot_sensors(df: DataFrame, index: str, columns: str, values: str, sensors: Sequence[str],
                  agg: str = "avg") -> DataFrame:
    """Long to wide: one row per ``index``, one column per listed sensor.

    ``agg="strict"`` fails on two readings of a sensor at one index value.
    """
    require_columns(df, [index, columns, values])

    def cell(sensor: str) -> Column:
        value = F.when(F.col(columns) == sensor, F.col(values))
        if agg == "strict":
            return F.when(F.count(value) > 1,
                          F.raise_error(F.lit(f"two readings of {sensor} at one {index}"))
                          ).otherwise(F.max(value))
        return getattr(F, agg)(value)

    return df.groupBy(index).agg(*[cell(s).alias(s) for s in sensors])


def datetime_pattern(fmt: str) -> str:
    out = fmt
    for directive, letters in STRFTIME_PATTERNS.items():
        out = out.replace(directive, letters)
    if "%" in out:
        raise ValueError(f"datetime format {fmt!r} has an unknown directive")
    return out


def normalize_ts(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """Epoch integers with a unit, strings with a strftime format, anything else by cast."""
    require_columns(df, [col])
    kind = df.schema[col].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        unit = fmt or "ms"
        if unit == "ns":
            micros = F.expr(f"`{col}` div 1000")
        elif unit in EPOCH_UNITS:
            micros = F.col(col).cast("long") * F.lit(EPOCH_UNITS[unit])
        else:
            raise ValueError(f"unknown epoch unit {unit!r}; known: {sorted(EPOCH_UNITS)} and 'ns'")
        return df.withColumn(col, F.timestamp_micros(micros))
    if isinstance(kind, T.StringType) and fmt:
        return df.withColumn(col, F.try_to_timestamp(F.col(col), F.lit(datetime_pattern(fmt))))
    if isinstance(kind, T.StringType):
        return df.withColumn(col, F.try_to_timestamp(F.col(col)))
    return df.withColumn(col, F.col(col).cast("timestamp"))


def to_series(df: DataFrame, ds: str, y: str, series: str | None = None) -> DataFrame:
    """Canonical univariate frame: ``[series_id,] ds, y``."""
    require_columns(df, [c for c in (ds, y, series) if c])
    key = [F.col(series).alias("series_id")] if series else []
    return df.select(*key, F.col(ds).alias("ds"), F.col(y).cast("double").alias("y"))


def to_labelled(df: DataFrame, target: str, features: Sequence[str],
                keep: Sequence[str] = ()) -> DataFrame:
    """Canonical labelled frame: kept columns, double features, ``target``."""
    require_columns(df, [target, *features, *keep])
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features],
                     F.col(target).alias("target"))


def encode_target(df: DataFrame, col: str = "target", out: str = "target_code") -> DataFrame:
    """Category codes 0, 1, ... in label order."""
    require_columns(df, [col])
    labels = df.select(col).filter(F.col(col).isNotNull()).distinct()
    codes = row_index(labels, col, name=out)
    return df.join(sized(codes), col, "left")


def chrono_split(df: DataFrame, order: str | Sequence[str], frac: float,
                 out: str = "is_test") -> DataFrame:
    """Mark the last ceil(n * frac) rows along ``order`` as the test part."""
    sizes = group_sizes(df)
    n = sizes[1]
    rows = row_index(df, order, name="row_idx", sizes=sizes)
    return rows.withColumn(out, F.col("row_idx") >= n - ceil(n * frac))


def batch_starts(n: int, depth: int) -> list[int]:
    """First index of each of the 2**depth batches of ``n`` rows, halving recursively."""
    pieces = [(0, n)]
    for _ in range(depth):
        halves = []
        for start, size in pieces:
            first = size // 2
            halves += [(start, first), (start + first, size - first)]
        pieces = halves
    return [start for start, _ in pieces]


def replay_batches(df: DataFrame, order: str | Sequence[str], frac: float = 0.3,
                   depth: int = 3) -> DataFrame:
    """The test tail in order, cut into 2**depth consecutive batches (``batch_no``)."""
    sizes = group_sizes(df)
    n = sizes[1]
    tail = ceil(n * frac)
    rows = row_index(df, order, name="row_idx", sizes=sizes).filter(F.col("row_idx") >= n - tail)
    at = F.col("row_idx") - F.lit(n - tail)
    number = sum((at >= start).cast("int") for start in batch_starts(tail, depth)[1:])
    return rows.withColumn("batch_no", number)


def assign_regular_ts(df: DataFrame, order: str | Sequence[str], start: datetime,
                      step: timedelta, out: str = "ds") -> DataFrame:
    """The i-th row along ``order`` gets the time start + i * step."""
    micros = (step.days * 86_400 + step.seconds) * 1_000_000 + step.microseconds
    rows = row_index(df, order, name="row_idx")
    first = F.lit(start.isoformat(sep=" ")).cast("timestamp")
    return rows.withColumn(out, F.timestamp_micros(F.unix_micros(first) + F.col("row_idx") * micros))


def hash_split(df: DataFrame, key: str | Sequence[str], frac: float, seed: int = 42,
               out: str = "is_test") -> DataFrame:
    """Seeded random split that does not depend on the partitioning."""
    share = F.pmod(F.xxhash64(F.lit(seed), *as_list(key)), F.lit(1_000_000))
    return df.withColumn(out, share < int(frac * 1_000_000))


# Beyond this many rows the tail is cut by row number instead of a top-k merge.
TOP_K_ROWS = 100_000


def tail_window(df: DataFrame, order: str | Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows along ``order``, ties by a hash of the whole row; 0 keeps all rows."""
    if n == 0:
        return df
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    rows, order = df.withColumn("_tie", F.xxhash64(*hashed)), [*as_list(order), "_tie"]
    if n <= TOP_K_ROWS:
        return rows.orderBy(*[F.col(c).desc() for c in order]).limit(n).drop("_tie")
    sizes = group_sizes(rows)
    return row_index(rows, order, name="_row", sizes=sizes).filter(F.col("_row") >= sizes[1] - n).drop("_row", "_tie")


def join_history(train: DataFrame, new: DataFrame, order: str | Sequence[str],
                 window: int = 0) -> DataFrame:
    """Training rows plus new rows, cut to the trailing retrain window."""
    return tail_window(train.unionByName(new, allowMissingColumns=True), order, window)
