"""Exact quantiles of long columns: values, ties, and jobs that follow the length alone."""

import numpy as np
import pandas as pd
import pytest

from lynceus.functions import quantiles


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(2)
    n = 6_000
    columns = {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "same": np.full(n, 7.0),
               "heavy": np.where(rng.random(n) < 0.4, 0.0, rng.exponential(size=n) ** 4), "whole": rng.integers(-9, 10 ** 9, n)}
    return columns, spark.createDataFrame(pd.DataFrame(columns)).repartition(5)


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_values_are_those_of_a_sort(table, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "SHARES", 5)
    columns, df = table
    probs = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, list(columns), probs, limit=40)
    for c, values in columns.items():
        assert np.allclose(got[c], np.quantile(values.astype(float), probs), rtol=1e-12, atol=1e-12), c


def test_nulls_and_nan(spark):
    df = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN double('NaN') ELSE double(id) END AS v, "
                   "CAST(NULL AS double) AS nothing FROM range(900)")
    got = quantiles.exact_quantiles(df, ["v", "nothing"], [0.0, 0.25, 1.0], limit=10)
    assert got["nothing"] == [] and got["v"][0] == 2.0 and np.isnan(got["v"][2])
    assert got["v"][1] == pytest.approx(np.quantile(np.arange(2.0, 900, 3), 149.75 / 299))


def test_jobs_do_not_grow_with_columns_or_probabilities(spark, table):
    columns, df = table
    df = df.cache()
    df.count()

    def jobs(cols, probs):
        spark.sparkContext.setJobGroup(name := f"q{len(cols)}-{len(probs)}", name)
        quantiles.exact_quantiles(df, cols, probs, limit=500)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    few, many = jobs(["normal"], [0.35]), jobs(["normal", "heavy", "whole"], [i / 100 for i in range(101)])
    df.unpersist()
    assert many <= few + 3
