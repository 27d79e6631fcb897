"""Tabular files in, JSON and report tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".txt": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Read a file or folder by its extension with a declared schema (txt is read as csv)."""
    kind = next((f for ending, f in FORMATS.items() if path.rstrip("/").lower().endswith(ending)), None)
    if kind is None:
        raise ValueError(f"cannot tell the format of {path}; known endings: {sorted(FORMATS)}")
    reader = spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("sep", sep)
    return reader.format(kind).load(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with a number that grows along each file."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_path(root: str, experiment: str, run_id: str, name: str) -> str:
    return f"{root.rstrip('/')}/experiment={experiment}/run_id={run_id}/report={name}"


def write_report(df: DataFrame, root: str, experiment: str, run_id: str, name: str) -> None:
    """Store one report table; writing it again replaces it."""
    df.write.mode("overwrite").parquet(report_path(root, experiment, run_id, name))
