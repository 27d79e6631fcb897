"""Structure search of Bayesian networks: contingency counts, bounds, wide tables."""

import itertools
from collections import Counter
from math import log

import numpy as np
import pytest

from lynceus.operators import bayes_net


def table_of(spark, columns: dict) -> object:
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(4)


def plain_score(rows: list[dict], child: str, parents) -> float:
    """BIC of a family straight from its definition."""
    parents = sorted(parents)
    joint = Counter(tuple(r[c] for c in [*parents, child]) for r in rows)
    upper = Counter(tuple(r[c] for c in parents) for r in rows)
    fit = sum(n * log(n / upper[k[:-1]]) for k, n in joint.items())
    q = np.prod([len({r[p] for r in rows}) for p in parents]) if parents else 1
    return fit - 0.5 * log(len(rows)) * q * (len({r[child] for r in rows}) - 1)


def acyclic(cols, edges) -> bool:
    left = set(cols)
    while left:
        free = {c for c in left if not any(b == c and a in left for a, b in edges)}
        if not free:
            return False
        left -= free
    return True


def plain_search(rows, cols):
    """Hill climbing over whole graphs, every neighbour scored in full."""
    def total(edges):
        return sum(plain_score(rows, c, [a for a, b in edges if b == c]) for c in cols)
    edges, here = frozenset(), total(frozenset())
    while True:
        around = []
        for a, b in itertools.permutations(sorted(cols), 2):
            if (a, b) in edges:
                around += [edges - {(a, b)}, edges - {(a, b)} | {(b, a)}]
            elif (b, a) not in edges:
                around.append(edges | {(a, b)})
        best, most = None, here + 1e-6
        for e in around:
            if acyclic(cols, e) and (t := total(e)) > most:
                best, most = e, t + 1e-6
        if best is None:
            return sorted(edges)
        edges, here = best, total(best)


@pytest.mark.parametrize("dense", [1, 1 << 17])
def test_scores_and_search_follow_the_definition(spark, monkeypatch, dense):
    monkeypatch.setattr(bayes_net, "DENSE_CELLS", dense)
    monkeypatch.setattr(bayes_net, "COUNT_ROWS", 100)
    monkeypatch.setattr(bayes_net, "JOB_CELLS", 1 << 21)
    monkeypatch.setattr(bayes_net, "SPARSE_CELLS", 3)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, 900), rng.integers(0, 2, 900)
    c = np.where(rng.random(900) < 0.8, (a + b) % 3, rng.integers(0, 3, 900))
    d = np.where(rng.random(900) < 0.7, c > 1, rng.random(900) < 0.5)
    columns = {"a": a, "b": b.astype(float), "c": [f"v{x}" for x in c], "d": d}
    df = table_of(spark, columns)
    rows = [dict(zip(columns, r)) for r in zip(*columns.values())]
    scores = bayes_net.FamilyScores(df, list(columns))
    for child in columns:
        others = [x for x in columns if x != child]
        for k in range(4):
            for parents in itertools.combinations(others, k):
                assert scores.family(child, parents) == pytest.approx(plain_score(rows, child, parents), abs=1e-6)
    assert bayes_net.learn_structure(df, list(columns)) == plain_search(rows, list(columns))
    assert all(b != "d" or a == "c" for a, b in bayes_net.learn_structure(df, list(columns), max_parents=1))


def test_fifty_columns_of_a_hundred_bins(spark):
    """Ten chains of five; the jobs grow with the edges found, not with the candidate families."""
    rng = np.random.default_rng(8)
    n, columns = 20_000, {}
    for chain in range(10):
        value = rng.integers(0, 100, n)
        for link in range(5):
            # nine levels of ten carry on, few parameters to be paid for: neighbours of ten bins each
            columns[f"x{chain}_{link}"] = value if link % 2 == 0 else value // 25
            value = np.where(rng.random(n) < 0.9, value, rng.integers(0, 100, n))
    df = table_of(spark, columns)
    scores = bayes_net.FamilyScores(df, list(columns))
    edges = bayes_net.learn_structure(df, list(columns), scores=scores)
    assert edges and all(a.split("_")[0] == b.split("_")[0] for a, b in edges)
    # every coarse link is tied to its chain
    assert {x for e in edges for x in e} >= {f"x{c}_{k}" for c in range(10) for k in (1, 3)}
    # all 1,225 pairs and what follows an edge; one more job for each step at most
    assert scores.jobs <= 2 * (len(edges) + 2)
    assert not any(len(s) > 3 for s in scores.sums)


def test_empty_null_and_unbounded_columns(spark, monkeypatch):
    empty = spark.createDataFrame([], "a int, b string")
    assert bayes_net.learn_structure(empty, ["a", "b"]) == []
    holes = spark.createDataFrame([(None, "x"), (1, "x"), (1, None), (2, "y"), (None, None)] * 20, "a int, b string")
    scores = bayes_net.FamilyScores(holes, ["a", "b"])
    assert scores.levels == {"a": 2, "b": 2}
    assert scores.sums[frozenset()] == pytest.approx(100 * log(100))
    scores.load([frozenset("ab")])
    assert scores.sums[frozenset("ab")] == pytest.approx(5 * 20 * log(20))
    monkeypatch.setattr(bayes_net, "MOST_LEVELS", 10)
    with pytest.raises(ValueError, match="more than 10 values"):
        bayes_net.FamilyScores(spark.range(1000).selectExpr("id", "id % 3 AS k"), ["id", "k"])


def test_times_and_signed_zeros_are_levels(spark):
    rows = spark.sql("SELECT timestamp'2020-10-25 02:30:00' + make_interval(0,0,0,0,id % 3) AS t, "
                     "CASE WHEN id % 2 = 0 THEN 0.0D ELSE -0.0D END AS z FROM range(90)")
    scores = bayes_net.FamilyScores(rows, ["t", "z"])
    assert scores.levels == {"t": 3, "z": 1}
    assert np.isfinite(scores.family("z", ["t"]))
