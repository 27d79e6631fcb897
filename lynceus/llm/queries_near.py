"""Near duplicates of whole documents.  SQL would compare all pairs; a test does that on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.llm import fingerprints, near_dup
from lynceus.llm.catalog import query, table


@query("op4_hamming_join")
def hamming_join(spark, d):
    rows = near_dup.group_near_duplicates(table(spark, d, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                       F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op10_local_parsing")
def local_parsing(spark, d):
    return fingerprints.fingerprint(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")
