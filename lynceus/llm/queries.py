"""Loads every query module of this package, and the pipeline."""

import corpus_pipeline
from lynceus.llm import queries_conversations, queries_mix, queries_models, queries_near, queries_rows, queries_rules, queries_vectors, queries_web  # noqa: F401
from lynceus.llm.catalog import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
