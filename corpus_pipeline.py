"""The document pipeline: language, exact copies, near copies, mixture, packing.

Each stage reads the Parquet table that the one before has written.  All but the
last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lynceus.llm import exact_dedup, language_id, mixing, near_dup, packing
from lynceus.session import new_folder, scoped_steps


#: Documents of the pipeline whose shingle sets are this similar, in percent, are near copies; op4_hamming_join asks for more.
NEAR_PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier names; it learns from those that state theirs."""
    return language_id.accepted_documents(docs, language_id.fit(docs))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset); a document taken twice is packed twice."""
    rows = packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                    ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rows.withColumnRenamed("id", "doc_id").drop("row_at")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The cube method and the MinHash signatures are not for SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written to the shared folder and read again; a stage's own tables go with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        with scoped_steps(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
