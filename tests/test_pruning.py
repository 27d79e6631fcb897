"""Cost-complexity pruning against an independent recursion, and its search against fitting every candidate."""

import random
from itertools import product

import numpy as np
import pytest

from lynceus.operators import trees

ALPHAS = [0.0005, 0.004, 0.1]


@pytest.fixture(scope="module")
def noisy(spark):
    r = random.Random(11)
    rows = []
    for i in range(500):
        a, b = r.random(), r.random()
        rows.append((i, a, b, str((a > 0.5) + 2 * (b > 0.5) if r.random() > 0.2 else r.randrange(4))))
    return spark.createDataFrame(rows, "id int, a double, b double, target string")


def cost(node, alpha):
    """(cost, leaves as nested lists): the least cost of risk plus alpha for each leaf; the smaller tree when costs tie."""
    kind, risk, *children = node
    if kind == "leaf":
        return risk + alpha, None
    parts = [cost(c, alpha) for c in children]
    below = sum(p[0] for p in parts)
    return (risk + alpha, None) if risk + alpha <= below + 1e-12 else (below, [p[1] for p in parts])


def nested(tree, i=0):
    if tree["leftChild"][i] < 0:
        return ("leaf", tree["risk"][i])
    return ("node", tree["risk"][i], nested(tree, tree["leftChild"][i]), nested(tree, tree["rightChild"][i]))


def shape(tree, i=0):
    return None if tree["leftChild"][i] < 0 else [shape(tree, tree["leftChild"][i]), shape(tree, tree["rightChild"][i])]


@pytest.mark.parametrize("fit,grid", [(trees.fit_tree, {"maxDepth": [6]}), (trees.fit_forest, {"maxDepth": [4], "numTrees": [3]})])
def test_pruned_model_has_the_least_cost(spark, noisy, fit, grid):
    model = fit(noisy, ["a", "b"], grid=grid, fold_key=["id"]).model.stages[1]
    whole = trees._nodes(model, spark)
    sizes = []
    for alpha in ALPHAS:
        left = trees._nodes(trees.pruned(model, alpha, spark), spark)
        assert [shape(t) for t in left] == [cost(nested(t), alpha)[1] for t in whole]
        sizes.append(sum(len(t["gain"]) for t in left))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1]


def test_one_alpha(noisy):
    model = trees.fit_tree(noisy, ["a", "b"], grid={"maxDepth": [6], "ccp_alpha": [0.02]}, fold_key=["id"])
    assert model.best == {"maxDepth": 6, "ccp_alpha": 0.02}
    assert model.transform(noisy).filter("y_pred = target").count() > 350


def test_search_of_alphas_is_that_of_fitted_candidates(spark, noisy, monkeypatch):
    seen, inner = {}, trees._accuracies

    def kept(prepared, learner, grid, folds, parallelism):
        seen.update(found=inner(prepared, learner, grid, folds, parallelism))
        for depth, alpha in product(grid["maxDepth"], grid["ccp_alpha"]):
            means = []
            for fold in range(folds):
                model = learner.copy({learner.maxDepth: depth}).fit(prepared.filter(f"_fold <> {fold}"))
                held = trees.pruned(model, alpha, spark).transform(prepared.filter(f"_fold = {fold}"))
                means.append(held.selectExpr("avg(cast(prediction = _label as double))").first()[0])
            assert seen["found"]["gini", 1, 0.0, depth, alpha] == pytest.approx(np.mean(means))
        return seen["found"]

    monkeypatch.setattr(trees, "_accuracies", kept)
    model = trees.fit_tree(noisy, ["a", "b"], grid={"maxDepth": [2, 6], "ccp_alpha": [0.0, 0.004, 0.02]}, folds=2, fold_key=["id"])
    assert len(seen["found"]) == 6 and set(model.best) == {"maxDepth", "ccp_alpha"}


def test_alpha_beside_other_parameters_is_refused(noisy):
    with pytest.raises(ValueError, match="ccp_alpha"):
        trees.fit_tree(noisy, ["a", "b"], grid={"ccp_alpha": [0.1, 0.2], "maxBins": [8, 16]}, fold_key=["id"])
