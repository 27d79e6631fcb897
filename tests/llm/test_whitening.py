"""Whitening against a dense computation in exact integers and numpy."""

import math

import numpy as np
import pytest

from lynceus.llm import queries_vectors, whitening


def dense(vectors: list[list[float]], k: int):
    """Deviations, whitened rows and shares of variance, computed whole."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    d = [[n * a - s for a, s in zip(row, sums)] for row in x]
    y = np.array([[a / n for a in row] for row in d])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return [sum(a * a for a in row) for row in d], (y @ u)[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(out, ids, vectors, k):
    deviations, white, shares = dense(vectors, k)
    rows = {(r["id"], r["component"]): r for r in out.collect()}
    assert len(rows) == len(ids) * k
    found = np.array([[rows[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((found * white).sum(0))
    assert np.abs(found - white * signs).max() < 1e-6
    for at, i in enumerate(ids):
        assert all(rows[i, c + 1]["deviation"] == deviations[at] and rows[i, c + 1]["n"] == len(ids) for c in range(k))
    assert np.allclose([rows[ids[0], c + 1]["explained"] for c in range(k)], shares, rtol=1e-6)
    errors = {r["identity_error"] for r in rows.values()}
    assert len(errors) == 1 and errors.pop() < 1e-8


@pytest.mark.parametrize("p,parts,tall", [(1, 1, 4096), (3, 7, 16), (40, 3, 64)])
def test_against_dense(spark, p, parts, tall):
    r = np.random.default_rng(p)
    vectors = (r.normal(size=(300, p)) @ r.normal(size=(p, p)) + 5).tolist()
    df = spark.createDataFrame([(i * 2**33 - 7, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(parts)
    check(whitening.whiten(df, rows_per_block=tall), [i * 2**33 - 7 for i in range(300)], vectors, min(p, 32))


def test_columns_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "COLUMNS_PER_BLOCK", 6)
    vectors = np.random.default_rng(2).normal(size=(200, 14)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    check(whitening.whiten(df), list(range(200)), vectors, 14)


def test_the_query_on_the_small_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    out = queries_vectors.block_whitening(spark, "/root/testdata/sf0.001").withColumnRenamed("vec_id", "id")
    check(out, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [3.0, 1.0], None), (2, None, "b"), (3, [1.0, None], "b"), (4, [nan, 1.0], "b"),
            (5, [inf, 1.0], "b"), (6, [], "b"), (7, [1.0], "b"), (8, [0.5, -4.0], "c"), (9, [1e300, 0.0], "c")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, component string").repartition(3)
    out = whitening.whiten(df).collect()
    assert sorted(str(r["id"]) for r in out if r["component"] == 1) == ["1", "1", "8", "None"]
    assert {r["n"] for r in out} == {4} and all(r["whitened"] is not None for r in out)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_no_rows_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])], schema)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [
        (1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in flat)


def test_large_numbers_stay_exact(spark):
    """Deviations beyond a long are null; those below are exact though their factors exceed what a double holds."""
    vectors = [[float(2**20 * i), 0.0] for i in range(5)] + [[2.0**39, 1.0]]
    out = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    expected = dense(vectors, 2)[0]
    found = {r["id"]: r["deviation"] for r in out.collect()}
    assert found == {i: d if d < 2**63 else None for i, d in enumerate(expected)}
    assert None in found.values()
