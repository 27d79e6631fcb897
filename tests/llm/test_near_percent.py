import numpy as np
import pytest

import corpus_pipeline
from lynceus.llm import near_dup


def text(words):
    return " ".join(words)


@pytest.fixture(scope="module")
def between(spark):
    """Hundred-shingle texts, each with a copy at 90 / 110 = 0.82, one at 85 / 115 = 0.74, and texts just below and at 0.8."""
    rows = []
    for family in range(12):
        words = [f"w{family}x{i}" for i in range(104)]
        rows.append((10 * family, text(words)))
        rows.append((10 * family + 1, text(["a" if i in (30, 60) else w for i, w in enumerate(words)])))
        rows.append((10 * family + 2, text(["b" if i in (20, 50, 80) else w for i, w in enumerate(words)])))
    few = [f"f{i}" for i in range(8)]
    rows += [(500, text(few)), (501, text([*few, "end"])), (502, text(few[:7] + ["other", "ending"]))]  # sets of 4, 5 and 5; 4 / 5 is 0.8
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_pipeline_links_from_80_percent_on(spark, between):
    left = {r["doc_id"] for r in corpus_pipeline.no_near_copies(spark, between, "").collect()}
    want = {10 * f + k for f in range(12) for k in (0, 2)} | {500, 502}
    assert left == want


def test_the_thin_operator_stays_at_85(between):
    assert near_dup.drop_near_duplicates(between).count() == between.count()


def test_schemes():
    assert near_dup.scheme(85) == near_dup.Scheme(85, 48, 11)
    for percent in (80, 85, 90):
        how, r = near_dup.scheme(percent), np.random.default_rng(percent)
        assert how.loss < 5e-7 and len(how.slots) <= 64
        for n in [how.distance] * 100 + list(range(how.distance)):
            differ = np.zeros((1, how.symbols), bool)
            differ[0, r.choice(how.symbols, n, replace=False)] = True
            assert sum(near_dup._at_first_key(differ, k, how)[0] for k in range(how.symbols)) == 1
    with pytest.raises(ValueError):
        near_dup.scheme(50)
