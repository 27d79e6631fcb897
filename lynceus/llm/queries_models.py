"""Queries that learn from the documents.  SQL can't express them; tests measure held-out accuracy and compare with plain Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lynceus.llm import language_id, toxicity
from lynceus.llm.catalog import query, table


def fold(folds: int) -> Column:
    """The fold of a document: the checksum of its id, as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


@query("op2_bayes_language")
def bayes_language(spark, d):
    docs = table(spark, d, "documents")
    model = language_id.fit(docs.filter(fold(3) != 1))
    return (language_id.identify(docs, model).withColumnRenamed("id", "doc_id").withColumn("held_out", fold(3) == 1)
            .select("doc_id", "held_out", "lang_pred", "score"))


@query("op8_kneser_ney_toxicity")
def kneser_ney_toxicity(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "labels").filter(fold(5) != 0))
    return (toxicity.score(docs, model).withColumnRenamed("id", "doc_id").withColumn("held_out", fold(5) == 0)
            .select("doc_id", "held_out", "score", "predicted"))
