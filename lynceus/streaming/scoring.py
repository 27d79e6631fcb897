"""Streaming prediction: one file of the source is one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lynceus.plans.experiment import predict_batch


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                pattern: str | None = None) -> DataFrame:
    """Batches in file order, one file per micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", 1)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def stream_predict(spark: SparkSession, source: DataFrame, root: str, name: str, checkpoint: str,
                   continuous: bool = False) -> StreamingQuery:
    """Score each micro-batch with the run that is current when it starts.

    The current run is looked up per batch, so a retrained model takes over
    between two batches; outputs are keyed by the batch id.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        predict_batch(batch.sparkSession, root, name, batch, batch_id)

    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.start() if continuous else writer.trigger(availableNow=True).start()
