"""Trees over merged rows against trees over the rows, and the bootstrap of merged rows against its law."""

import random

import numpy as np
import pytest

from lynceus.operators import tree_cells, trees

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def alike(spark):
    """6,000 rows of few values: 20 x 5 x 3 of them, and a label that depends on two columns."""
    r, rows = random.Random(3), []
    for i in range(20_000):
        a, b, c = r.randrange(20) / 2, r.randrange(5), r.randrange(3)
        rows.append((i, a, float(b), float(c), str(int((a > 4.6) != (b > 2))) if r.random() > 0.1 else "2"))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, target string").persist()


@pytest.fixture
def merging(monkeypatch):
    monkeypatch.setattr(tree_cells, "MERGE_ROWS", 1_000)
    # a long table must not reach an estimator row by row
    seen, inner = [], trees.keep_cached

    def kept(df, *more):
        out = inner(df, *more)
        seen.append(out.count())
        return out
    monkeypatch.setattr(trees, "keep_cached", kept)
    return seen


GRID = {"impurity": ["gini", "entropy"], "minInfoGain": [0.1, 0.001], "maxDepth": [2, 4]}


def predicted(model, df):
    return {r["id"]: r["y_pred"] for r in model.transform(df).collect()}


@pytest.mark.parametrize("grid", [GRID, {"maxDepth": [4]}, {"maxDepth": [5], "ccp_alpha": [0.0, 0.01]}])
def test_a_tree_of_cells_is_the_tree_of_the_rows(alike, merging, monkeypatch, grid):
    cells = trees.fit_tree(alike, COLS, grid=grid, fold_key=["id"])
    assert merging == [n for n in merging if n <= 20 * 5 * 3 * 3 * trees.FOLDS] and merging
    monkeypatch.setattr(tree_cells, "MERGE_ROWS", 10 ** 9)
    rows = trees.fit_tree(alike, COLS, grid=grid, fold_key=["id"])
    assert cells.best == rows.best
    assert predicted(cells, alike) == predicted(rows, alike)
    assert [v for _, v in cells.importance()] == pytest.approx([v for _, v in rows.importance()])


def test_a_forest_of_cells_predicts_as_that_of_the_rows(spark, alike, merging, monkeypatch):
    grid = {"impurity": ["gini", "entropy"], "numTrees": [20, 40], "minInfoGain": [0.1, 0.001], "maxDepth": [2, 4]}
    cells = trees.fit_forest(alike, COLS, grid=grid, fold_key=["id"])
    assert merging and max(merging) <= 20 * 5 * 3 * 3 * trees.FOLDS
    again = trees.fit_forest(alike.repartition(7), COLS, grid=grid, fold_key=["id"])
    assert predicted(cells, alike) == predicted(again, alike)
    monkeypatch.setattr(tree_cells, "MERGE_ROWS", 10 ** 9)
    rows = trees.fit_forest(alike, COLS, grid=grid, fold_key=["id"])
    hits = [m.transform(alike).filter("y_pred = target").count() for m in (cells, rows)]
    assert min(hits) > 17_000 and abs(hits[0] - hits[1]) < 200
    forest = cells.model.stages[1]
    assert forest.getNumTrees == cells.best["numTrees"] and max(t.depth for t in forest.trees) <= cells.best["maxDepth"]


def test_many_trees_of_cells_use_the_columns_as_those_of_the_rows(alike, merging, monkeypatch):
    one = {"numTrees": [100], "minInfoGain": [0.001], "maxDepth": [4]}
    cells = trees.fit_forest(alike, COLS, grid=one, fold_key=["id"])
    monkeypatch.setattr(tree_cells, "MERGE_ROWS", 10 ** 9)
    rows = trees.fit_forest(alike, COLS, grid=one, fold_key=["id"])
    # a tree whose subsets leave out the second column after the first split raises the first one: some trees in ten
    assert [v for _, v in cells.importance()] == pytest.approx([v for _, v in rows.importance()], abs=0.2)


def test_rows_are_drawn_one_by_one(spark, alike):
    """A root's votes in many trees vary as sums of Poisson(1) counts of rows, not of whole cells."""
    x = [f"{c} * 2 as _z{i}" for i, c in enumerate(COLS)]
    rows = alike.selectExpr(*x, "cast(target as double) as _label", "id % 5 as _fold")
    names = ["_z0", "_z1", "_z2"]
    cells = rows.groupBy(*names, "_label", "_fold").count().selectExpr(*[f"int({c}) as {c}" for c in names], "_label", "_fold", "double(count) as _n")
    from pyspark.ml.feature import VectorAssembler
    ready = VectorAssembler(inputCols=names, outputCol="_features").transform(cells)
    grown = tree_cells.grow(tree_cells.blocks_of(ready), 3, 32, 3, [("gini", -1)], 300, 1, 0.0, 7)
    sums = np.array([t["counts"][0].sum() for t in grown["gini", -1]])
    assert abs(sums.mean() - 20_000) < 40 and 120 < sums.std() < 165


def test_cuts_hold_all_of_few_values_and_quantiles_of_many(spark):
    df = spark.range(4_000).selectExpr("id % 4 * 1.0 as few", "double(id) as many", "1.0 as one")
    few, many, one = tree_cells.cuts_of(df, ["few", "many", "one"], 8)
    assert few == [0.5, 1.5, 2.5] and one == []
    assert len(many) == 7 and all(abs(v - 500 * (i + 1)) <= 5 for i, v in enumerate(many))
    assert tree_cells.merged(df.selectExpr("few as x", "'a' as t", "0 as f"), ["x"], "t", "f", 8, 1) is None
