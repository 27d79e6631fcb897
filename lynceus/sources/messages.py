"""Decoders of JSON batch messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.operators.ordering import as_list


def decode_columnar_json(df: DataFrame, col: str, schema: T.StructType,
                         message: str | Sequence[str]) -> DataFrame:
    """Rows of column-oriented JSON messages ``{"col": {"row": value}}``.

    ``message`` identifies a message; the row label comes back as ``row_key``.
    """
    message = as_list(message)
    columns = F.from_json(col, "map<string, map<string, string>>")
    cells = (df.select(*message, F.explode(columns).alias("_name", "_cells"))
             .select(*message, "_name", F.explode("_cells").alias("row_key", "_value")))
    # one row per message and row label, one cell per declared column
    value = lambda f: F.max(F.when(F.col("_name") == f.name, F.col("_value")))
    return (cells.groupBy(*message, "row_key")
            .agg(*[value(f).cast(f.dataType).alias(f.name) for f in schema.fields]))


def encode_columnar_json(df: DataFrame, message: str | Sequence[str], row_key: str,
                         cols: Sequence[str], out: str = "body") -> DataFrame:
    """The message format a client sends: one JSON text per batch, column by column."""
    def column(c: str):
        cell = F.struct(F.col(row_key).cast("string"), F.col(c).cast("string"))
        return F.map_from_entries(F.collect_list(cell)).alias(c)

    return (df.groupBy(*as_list(message)).agg(*[column(c) for c in cols])
            .select(*as_list(message), F.to_json(F.struct(*cols)).alias(out)))


TSDATA = "target string, date string, value double"


def explode_records(df: DataFrame, col: str, record: str = TSDATA, field: str = "tsdata") -> DataFrame:
    """Flatten ``{"tsdata": [{...}, ...]}`` messages, one row per record."""
    body = F.from_json(F.col(col), f"struct<`{field}`: array<struct<{_typed(record)}>>>")
    kept = [c for c in df.columns if c != col]
    return (df.select(*kept, F.explode(body[field]).alias("_r")).select(*kept, "_r.*"))


def _typed(ddl: str) -> str:
    return ", ".join(":".join(part.strip().split(None, 1)) for part in ddl.split(","))
