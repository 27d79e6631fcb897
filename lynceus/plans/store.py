"""Stored models, runs, reports, predictions and metrics: parquet tables under one root folder.

A model is stored field by field: small values as JSON, DataFrames as parquet,
MLlib models in their own format.
"""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from importlib import import_module

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.sources.files import report_path, write_report

RUNS = "experiment string, run_id string, seq long, model string, config string, n_rows long, after_batch long"
REPORTS = "experiment string, run_id string, report string"


def _qualified(value) -> str:
    return f"{type(value).__module__}:{type(value).__qualname__}"


def _pack(value, path: str):
    """JSON form of a value; tables and MLlib models are written below ``path``."""
    if isinstance(value, DataFrame):
        value.write.mode("overwrite").parquet(path)
        return {"_table": path.rsplit("/", 1)[1]}
    if isinstance(value, PipelineModel):
        value.write().overwrite().save(path)
        return {"_mllib": path.rsplit("/", 1)[1]}
    if isinstance(value, np.ndarray):
        return {"_array": value.tolist(), "dtype": str(value.dtype)}
    if is_dataclass(value):
        skip = {"rows"}  # training rows are not part of a stored model
        found = {f.name: _pack(getattr(value, f.name), f"{path}.{f.name}")
                 for f in fields(value) if f.name not in skip}
        return {"_class": _qualified(value), "fields": found}
    if isinstance(value, dict):
        return {"_dict": [[k, _pack(v, f"{path}.{i}")] for i, (k, v) in enumerate(value.items())]}
    if isinstance(value, (list, tuple)):
        return [_pack(v, f"{path}.{i}") for i, v in enumerate(value)]
    if isinstance(value, np.generic):
        return value.item()
    return value


def _unpack(spark: SparkSession, value, folder: str):
    if isinstance(value, list):
        return [_unpack(spark, v, folder) for v in value]
    if not isinstance(value, dict):
        return value
    if "_table" in value:
        return spark.read.parquet(f"{folder}/{value['_table']}")
    if "_mllib" in value:
        return PipelineModel.load(f"{folder}/{value['_mllib']}")
    if "_array" in value:
        return np.array(value["_array"], dtype=value["dtype"])
    if "_dict" in value:
        return {k: _unpack(spark, v, folder) for k, v in value["_dict"]}
    module, name = value["_class"].split(":")
    if module.split(".")[0] != __name__.split(".")[0]:
        raise ValueError(f"refusing to load a model of {module}")
    made = getattr(import_module(module), name)
    return made(**{k: _unpack(spark, v, folder) for k, v in value["fields"].items()})


def save_model(spark: SparkSession, model, folder: str) -> None:
    folder = folder.rstrip("/")
    text = json.dumps(_pack(model, f"{folder}/part"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model.json")


def load_model(spark: SparkSession, folder: str):
    folder = folder.rstrip("/")
    text = spark.read.text(f"{folder}/model.json", wholetext=True).first()[0]
    return _unpack(spark, json.loads(text), folder)


def model_folder(root: str, experiment: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/models/experiment={experiment}/run_id={run_id}"


# --- run registry -------------------------------------------------------------------------------

def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the store with one folder per run; empty before the first write."""
    path = f"{root.rstrip('/')}/{name}"
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*empty.columns) if folder_exists(spark, path) else empty


def folder_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def append_run(spark: SparkSession, root: str, experiment: str, run_id: str, model: str, config: dict,
               n_rows: int, after_batch: int = -1) -> None:
    """Register a finished run; the newest registered run of an experiment is its current one.

    ``after_batch`` is the batch that caused a retrain.
    """
    seq = (runs(spark, root).filter(F.col("experiment") == experiment).agg(F.max("seq")).first()[0] or 0) + 1
    row = [(experiment, run_id, seq, model, json.dumps(config, default=str), n_rows, after_batch)]
    spark.createDataFrame(row, RUNS).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/runs/of={run_id}")


def runs(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "runs", RUNS)


def current_run(spark: SparkSession, root: str, experiment: str, batch_id: int | None = None,
                run_id: str | None = None) -> dict:
    """The newest run, the newest one that may score a batch, or a given run."""
    found = runs(spark, root).filter(F.col("experiment") == experiment)
    if run_id is not None:
        found = found.filter(F.col("run_id") == run_id)
    if batch_id is not None:
        found = found.filter(F.col("after_batch") < batch_id)
    row = found.orderBy(F.col("seq").desc()).limit(1).first()
    if row is None:
        known = sorted(r[0] for r in runs(spark, root).select("experiment").distinct().collect())
        raise ValueError(f"no such run of experiment {experiment!r}; known experiments: {known}")
    return {**row.asDict(), "config": json.loads(row["config"])}


# --- reports ------------------------------------------------------------------------------------

def save_reports(spark: SparkSession, root: str, experiment: str, run_id: str,
                 reports: dict[str, DataFrame]) -> None:
    for name, table in reports.items():
        write_report(table, f"{root.rstrip('/')}/report_tables", experiment, run_id, name)
    if reports:
        rows = [(experiment, run_id, name) for name in reports]
        spark.createDataFrame(rows, REPORTS).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/reports/of={run_id}")


def list_reports(spark: SparkSession, root: str, experiment: str, run_id: str | None = None) -> list[str]:
    run_id = run_id or current_run(spark, root, experiment)["run_id"]
    rows = _table(spark, root, "reports", REPORTS).filter(
        (F.col("experiment") == experiment) & (F.col("run_id") == run_id))
    return sorted(r[0] for r in rows.select("report").distinct().collect())


def read_report(spark: SparkSession, root: str, experiment: str, name: str,
                run_id: str | None = None) -> DataFrame:
    run_id = run_id or current_run(spark, root, experiment)["run_id"]
    known = list_reports(spark, root, experiment, run_id)
    if name not in known:
        raise ValueError(f"experiment {experiment!r} has no report {name!r}; known: {known}")
    return spark.read.parquet(report_path(f"{root.rstrip('/')}/report_tables", experiment, run_id, name))


# --- batches ------------------------------------------------------------------------------------

def batch_path(root: str, table: str, experiment: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/{table}/experiment={experiment}/batch_id={batch_id}"


def write_batch(df: DataFrame, root: str, table: str, experiment: str, batch_id: int) -> None:
    """Store the rows of one batch; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(batch_path(root, table, experiment, batch_id))


def read_batches(spark: SparkSession, root: str, table: str, experiment: str) -> DataFrame:
    """All batches of an experiment with their ``batch_id``."""
    path = f"{root.rstrip('/')}/{table}/experiment={experiment}"
    return spark.read.option("mergeSchema", True).parquet(path)
