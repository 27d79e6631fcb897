"""Queries over whole documents: mixing, packing and token counts.  SQL can't express them; tests hold them against plain Python."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lynceus.llm import mixing, packing, token_counts
from lynceus.llm.catalog import query, table


@query("op3_cube_mix")
def cube_mix(spark, d):
    return (mixing.mix(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")
            .select("doc_id", "size", "source_size", "target", "taken", "source", "repeats"))


@query("op5_best_fit")
def best_fit(spark, d):
    rows = packing.packed_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_two_tier_counts")
def two_tier_counts(spark, d):
    rows = token_counts.count_tokens(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
