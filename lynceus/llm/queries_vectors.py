"""Queries over embeddings.  SQL has no eigenvectors; a test compares with a dense computation."""

from __future__ import annotations

from lynceus.llm import whitening
from lynceus.llm.catalog import query, table


@query("op11_block_whitening")
def block_whitening(spark, d):
    return whitening.whiten(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")
