"""Row addresses and global row numbers that survive retries and need no single-task window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.session import durable


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column has that name (upper and lower case count as equal)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def addressed(df: DataFrame, name: str = "row_at") -> DataFrame:
    """Append a column that tells every row apart, repeated rows too, and stays the same when a task is repeated.

    Rows read from files are named by (hash of the file's path, row number in
    the file), which the reader provides.  Any other frame is written to the
    shared folder first and read back.
    """
    def of_files(rows: DataFrame) -> DataFrame:
        meta = rows.metadataColumn("_metadata")
        out = rows.select("*", F.struct(F.xxhash64(meta["file_path"]).alias("file"),
                                        meta["row_index"].alias("row")).alias(name))
        out.schema  # resolves the plan: fails here when the frame isn't a plain read of files
        return out

    try:
        return of_files(df)
    except AnalysisException:
        return of_files(durable(df))


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Append the position 0, 1, 2, ... of every row along ``order``, which must be a total order.

    Rows are range-partitioned on the whole order, so that no key can fill a
    task, and written once; a row's number is its position in its range plus
    the rows in all ranges before it.  The table of ranges has one row per
    partition.
    """
    part, pos = free_name(df, "range_no"), free_name(df, "range_pos")
    placed = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn(pos, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(pos, 33).cast("int"))
        .withColumn(pos, F.col(pos).bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (placed.groupBy(part).agg(F.count(F.lit(1)).alias("n_in_range"))
             .select(F.col(part).alias("range_key"),
                     F.coalesce(F.sum("n_in_range").over(before), F.lit(0)).alias("rows_before")))
    return (placed.join(F.broadcast(sizes), placed[part] == sizes["range_key"])
            .withColumn(name, F.col("rows_before") + F.col(pos))
            .drop("range_key", "rows_before", part, pos))
