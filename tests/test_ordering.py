"""The segmented plans give what a plain window gives, hot keys and null keys included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lynceus.functions.quantiles import exact_quantiles
from lynceus.operators import markov, process_graph, series, shaping
from lynceus.operators.ordering import over_order, row_index


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(600):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        data.append((key, i, rng.random(), rng.choice("xyz")))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t long, y double, s string").repartition(5).cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("key", [None, "k"])
def test_row_index(rows, key):
    plain = row_index(rows, "t", key=key)
    assert plain.count() == 600
    same(plain, row_index(rows, "t", key=key, limit=40))


@pytest.mark.parametrize("key", [None, "k"])
@pytest.mark.parametrize("reach", [1, 3, 70])
def test_neighbours(rows, key, reach):
    def columns(w):
        return {"b": F.lag("y", reach).over(w), "f": F.lead("y", reach).over(w),
                "m": F.round(F.avg("y").over(w.rowsBetween(-reach, reach)), 9),
                "c": F.collect_list("t").over(w.rowsBetween(0, reach))}

    plain = over_order(rows, "t", columns, key=key, back=reach, ahead=reach)
    same(plain, over_order(rows, "t", columns, key=key, back=reach, ahead=reach, limit=30))


def test_index_matches_window(rows):
    w = Window.partitionBy("k").orderBy("t")
    same(rows.withColumn("row_idx", (F.row_number().over(w) - 1).cast("long")), row_index(rows, "t", key="k", limit=25))


def test_operators_do_not_depend_on_the_task_size(spark, rows, small_tasks):
    def results():
        return [sorted(map(str, f().collect())) for f in (
            lambda: series.embed(rows, 5, key="k", order="t").select("t", "window"),
            lambda: series.lag_features(rows, 4, key="k", order="t"),
            lambda: markov.transition_matrix(rows, "s", "t", "k"),
            lambda: process_graph.heuristics_net(rows, "k", "t", "s", 1),
            lambda: shaping.replay_batches(rows, "t", 0.5),
            lambda: shaping.encode_target(rows, "t", "code"),
        )]

    whole = results()
    small_tasks(37)
    assert results() == whole


@pytest.mark.parametrize("parts", [1, 13])
def test_partitioning_does_not_matter(rows, parts):
    a = series.lag_features(rows.repartition(parts), 2, key="k", order="t", complete=False)
    same(series.lag_features(rows, 2, key="k", order="t", complete=False), a)
    b = shaping.hash_split(rows.repartition(parts), ["k", "t"], 0.33)
    same(shaping.hash_split(rows, ["k", "t"], 0.33), b)


@pytest.mark.parametrize("values", [
    [random.Random(2).gauss(0, 1) for _ in range(3000)],
    [1.0] * 1500 + [2.0] * 1000 + [float(i) for i in range(500)],
    [0.0] * 2999 + [1e9],
])
def test_exact_quantiles(spark, values):
    import numpy as np
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    probs = [0.0, 0.013, 0.25, 0.5, 0.9, 0.9999, 1.0]
    want = np.quantile(values, probs)
    for limit in (10_000, 50):
        got = exact_quantiles(df, ["v"], probs, limit=limit)["v"]
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12)
