from collections import Counter

import corpus_pipeline
from lynceus.llm import language_id
from lynceus.llm.queries import QUERIES
from tests.llm.conftest import EXTRA
from tests.llm.test_near import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    language, exact, near, mixed, packed = kept
    read = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(language) == sum(any(c.isalpha() for c in r["text"] or "") for r in read)
    last = {}
    for r in language:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(last.values())
    assert {r["doc_id"] for r in near} == {c for _, _, c in brute(exact, corpus_pipeline.NEAR_PERCENT)}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    assert Counter(r["doc_id"] for r in mixed) == Counter(r["doc_id"] for r in packed if r["piece"] == 0)


def test_run_is_a_query(spark):
    assert QUERIES["pipeline"](spark, FOLDER).count() > 0


def test_awkward_and_empty_tables(spark, awkward, tmp_path):
    for label, docs in (("awkward", awkward), ("empty", awkward.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, FOLDER).write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
            assert name == "packing" or set(EXTRA.split()[::2]) <= set(docs.columns)
        assert (docs.count() > 0) == (label == "awkward")


def test_clean_documents_stay(spark, documents):
    assert language_id.accepted_documents(documents, language_id.fit(documents)).count() >= documents.count() - 2
