"""Decision tree and random forest with a grid search over hash-assigned folds.

A tree of less depth, or with a larger least gain, is a larger tree cut short, and
cost-complexity pruning (``ccp_alpha``) cuts it further from its node statistics.  So each fold
grows the largest candidate once, and the held-out rows are scored for all of its cuts in one
pass.  A forest of fewer trees is taken for the first ones of a larger forest, which
approximates a search that fits each of them.  Long tables are merged into weighted cells first (``tree_cells``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.eda import Scaler
from lynceus.operators.tree_cells import blocks_of, grow, merged, one_of_each
from lynceus.session import drop_steps, keep_cached, new_folder

# The full search grids.  Log loss and entropy are the same
# criterion; a minimum gain stands in for ccp_alpha unless a grid names that.
TREE_GRID = {"impurity": ["gini", "entropy"], "minInfoGain": [0.1, 0.01, 0.001],
             "maxDepth": [2, 3, 4, 5, 6, 7, 8, 9]}
FOREST_GRID = {"numTrees": [10, 50, 100], "minInfoGain": [0.1, 0.01, 0.001], "maxDepth": [2, 3, 4, 5]}
FOLDS = 5


@dataclass
class TreeClassifier:
    """Scaled inputs, fitted tree model, and the column names."""

    scaler: Scaler
    model: PipelineModel
    best: dict

    @property
    def cols(self) -> list[str]:
        return self.scaler.cols

    def transform(self, df: DataFrame) -> DataFrame:
        """Predicted label ``y_pred`` next to all input columns; null where an input is null."""
        names = [f"_z{i}" for i in range(len(self.cols))]
        known = F.lit(True)
        for c in self.cols:
            known = known & F.col(c).isNotNull()
        # the stand-in for a missing input is never seen: its row's prediction is taken back
        rows = df.withColumns({n: F.coalesce(self.scaler.scaled(c), F.lit(0.0)) for n, c in zip(names, self.cols)})
        out = self.model.transform(rows.withColumn("_known", known))
        return (out.withColumn("y_pred", F.when(F.col("_known"), F.col("y_pred")))
                .drop(*names, "_known", "_features", "_label", "rawPrediction", "probability", "prediction"))

    def importance(self) -> list[tuple[str, float]]:
        """(column, importance): one pair per input column."""
        return list(zip(self.cols, map(float, self.model.stages[1].featureImportances.toArray())))


#: Parameters whose candidates are cuts of one model, beside the impurity.
CUTS = ("numTrees", "minInfoGain", "maxDepth")
PRUNING = "ccp_alpha"


def _stored(model, spark, path: str) -> DataFrame:
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data")
    return rows.select("treeID", "nodeData.*") if "nodeData" in rows.columns else rows.withColumn("treeID", F.lit(0))


def _nodes(model, spark) -> list[dict[str, np.ndarray]]:
    """The nodes of each tree, as arrays by node number (parents before children), from the model's stored form."""
    path = new_folder(spark, "trees")
    try:
        found = _stored(model, spark, path).select(
            "treeID", "id", "impurity", "impurityStats", "gain", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("at")).toPandas()
    finally:
        drop_steps(spark, [path])
    out = []
    for _, tree in found.sort_values(["treeID", "id"]).groupby("treeID"):
        votes = np.stack(tree["impurityStats"].to_numpy())
        weight = votes.sum(axis=1)
        out.append({"votes": votes / np.maximum(weight[:, None], 1e-300), "risk": tree["impurity"].to_numpy() * weight / max(weight[0], 1e-300),
                    **{c: tree[c].to_numpy() for c in ("gain", "leftChild", "rightChild", "feature")},
                    "at": tree["at"].fillna(0.0).to_numpy()})
    return out


def splitting(tree: Mapping[str, np.ndarray], gain: float, depth: int) -> np.ndarray:
    """Which nodes split in the tree of this least gain and depth; a split into leaves of one prediction is none, as in a fitted tree."""
    left, right, best = tree["leftChild"], tree["rightChild"], tree["votes"].argmax(axis=1)
    splits, level = np.zeros(len(left), bool), np.full(len(left), depth)
    level[0] = 0
    for i in range(len(left)):
        if left[i] >= 0 and tree["gain"][i] >= gain and level[i] < depth:
            splits[i] = True
            level[left[i]] = level[right[i]] = level[i] + 1
    for i in np.flatnonzero(splits)[::-1]:
        splits[i] = splits[left[i]] or splits[right[i]] or best[left[i]] != best[right[i]]
    return splits


def pruning_strengths(tree: Mapping[str, np.ndarray], splits: np.ndarray) -> np.ndarray:
    """For every node that splits, the least alpha of cost-complexity pruning that makes it go; -1 for others.

    The weakest link goes first: the node whose subtree lowers the risk (impurity
    by share of rows) least for each leaf that it adds.  What hangs below it goes with it.
    """
    left, right, risk = tree["leftChild"], tree["rightChild"], tree["risk"]
    alive, strength = splits.copy(), np.full(len(left), -1.0)
    leaves, below, parent = np.ones(len(left)), risk.astype(float), np.full(len(left), -1)
    for i in np.flatnonzero(splits)[::-1]:
        parent[left[i]] = parent[right[i]] = i
        leaves[i], below[i] = leaves[left[i]] + leaves[right[i]], below[left[i]] + below[right[i]]
    reached = 0.0
    while alive.any():
        at = np.flatnonzero(alive)
        links = (risk[at] - below[at]) / (leaves[at] - 1)
        weakest = int(at[links.argmin()])
        reached = max(reached, float(links.min()))
        fewer, more, above = leaves[weakest] - 1, risk[weakest] - below[weakest], weakest
        while above >= 0:
            leaves[above], below[above], above = leaves[above] - fewer, below[above] + more, parent[above]
        going = [weakest]
        while going:
            i = going.pop()
            if alive[i]:
                alive[i], strength[i] = False, reached
                going += [left[i], right[i]]
    return strength


def _leaf_of(tree: Mapping[str, np.ndarray], splits: np.ndarray) -> np.ndarray:
    """For every node, the leaf of the cut tree that its rows fall into."""
    out = np.zeros(len(splits), np.int64)
    for i in range(len(splits)):
        for child in (tree["leftChild"][i], tree["rightChild"][i]):
            if child >= 0:
                out[child] = child if out[i] == i and splits[i] else out[i]
    return out


def cut_leaves(tree: Mapping[str, np.ndarray], gains: Sequence[float], depths: Sequence[int], alphas: Sequence[float]) -> np.ndarray:
    """gains x depths x alphas x nodes: the leaf of every node in every cut.  An alpha of 0 prunes nothing."""
    out = np.empty((len(gains), len(depths), len(alphas), len(tree["gain"])), np.int64)
    for (g, gain), (d, depth) in product(enumerate(gains), enumerate(depths)):
        splits = splitting(tree, gain, depth)
        strength = pruning_strengths(tree, splits) if any(alphas) else None
        for a, alpha in enumerate(alphas):
            out[g, d, a] = _leaf_of(tree, splits & (strength > alpha) if alpha else splits)
    return out


def cut_hits(x: np.ndarray, label: np.ndarray, n: np.ndarray, trees: list[dict], leaves: list[np.ndarray], counts: Sequence[int]) -> np.ndarray:
    """Right predictions of every cut: counts x gains x depths x alphas.  Rows, each standing for ``n``, walk each tree once, to its last leaf."""
    shape, row = leaves[0].shape[:3], np.arange(len(x))
    hits, votes = np.zeros((len(counts), *shape), np.int64), np.zeros((*shape, len(x), trees[0]["votes"].shape[1]))
    for number, (tree, cuts) in enumerate(zip(trees, leaves), 1):
        node = np.zeros(len(x), np.int64)
        while (split := tree["leftChild"][node] >= 0).any():
            left = x[row, np.maximum(tree["feature"][node], 0)] <= tree["at"][node]
            node = np.where(split, np.where(left, tree["leftChild"][node], tree["rightChild"][node]), node)
        for cut in np.ndindex(shape):
            votes[cut] += tree["votes"][cuts[cut][node]]
        if number in counts:
            hits[counts.index(number)] = (votes.argmax(axis=4) == label) @ n
    return hits


def pruned(model, alpha: float, spark):
    """The fitted tree or forest after cost-complexity pruning of every tree; the model itself where alpha is 0."""
    if not alpha:
        return model
    keeps = []
    for tree in _nodes(model, spark):
        leaf = _leaf_of(tree, pruning_strengths(tree, tree["leftChild"] >= 0) > alpha)
        kept = np.flatnonzero(leaf == np.arange(len(leaf)))
        # children of a kept node are kept both or not at all
        keeps.append({int(old): new for new, old in enumerate(kept)})
    path = new_folder(spark, "pruned")
    try:
        model.write().save(path)
        stored = spark.read.parquet(f"{path}/data")
        rows = []
        for row in stored.collect():
            row = row.asDict(recursive=True)
            node, names = row.get("nodeData", row), keeps[row.get("treeID", 0)]
            if node["id"] not in names:
                continue
            if node["leftChild"] not in names:
                node.update(leftChild=-1, rightChild=-1, gain=-1.0,
                            split={"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1})
            node.update(id=names[node["id"]], leftChild=names.get(node["leftChild"], -1), rightChild=names.get(node["rightChild"], -1))
            rows.append(row)
        spark.createDataFrame(rows, stored.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
        return type(model).load(path)
    finally:
        drop_steps(spark, [path])


def _accuracies(prepared: DataFrame, learner, grid: Mapping[str, Sequence], folds: int, parallelism: int) -> dict[tuple, float]:
    """Mean accuracy over the folds of every combination (impurity, numTrees, minInfoGain, maxDepth), and ccp_alpha if the grid has it."""
    spark = prepared.sparkSession
    def default(name):
        return learner.getOrDefault(name) if learner.hasParam(name) else 1
    values = {name: sorted(grid.get(name, [default(name)])) for name in CUTS}
    counts, gains, depths = (values[name] for name in CUTS)
    alphas = sorted(grid.get(PRUNING, [0.0]))
    impurities = list(grid.get("impurity", [default("impurity")]))
    cells = "_n" in prepared.columns
    grown = _grown(prepared, learner, [(i, fold) for i in impurities for fold in range(folds)], counts[-1], depths[-1], gains[0]) if cells and forest(learner) else None

    def one(impurity: str, fold: int) -> np.ndarray | None:
        largest = {"impurity": impurity, "minInfoGain": gains[0], "maxDepth": depths[-1], "numTrees": counts[-1]}
        if grown:
            trees = grown[impurity, fold]
        else:
            trees = _nodes(learner.copy({learner.getParam(n): v for n, v in largest.items() if learner.hasParam(n)}).fit(
                prepared.filter(F.col("_fold") != fold)), spark)
        leaves = [cut_leaves(tree, gains, depths, alphas) for tree in trees]

        def score(batches):
            for pdf in batches:
                if len(pdf):
                    n = pdf["n"].to_numpy()
                    found = cut_hits(np.stack(pdf["x"].to_numpy()), pdf["label"].to_numpy(), n, trees, leaves, counts).ravel()
                    yield pd.DataFrame({"cut": np.arange(len(found)), "hits": found, "n": n.sum()})

        held = prepared.filter(F.col("_fold") == fold).select(vector_to_array("_features").alias("x"), F.col("_label").alias("label"),
                                                              (F.col("_n") if cells else F.lit(1)).cast("long").alias("n"))
        sums = held.mapInPandas(score, "cut int, hits long, n long").groupBy("cut").agg(F.sum("hits").alias("h"), F.sum("n").alias("n"))
        rows = sums.orderBy("cut").collect()
        return np.array([r["h"] / r["n"] for r in rows]) if rows else None

    with ThreadPoolExecutor(parallelism) as pool:
        jobs = {i: [pool.submit(one, i, fold) for fold in range(folds)] for i in impurities}
        out = {}
        for impurity, parts in jobs.items():
            found = [r for r in (job.result() for job in parts) if r is not None]
            for key, mean in zip(product(counts, gains, depths, *([alphas] if PRUNING in grid else [])), np.mean(found, axis=0)):
                out[(impurity, *key)] = float(mean)
    return out


def forest(learner) -> bool:
    return isinstance(learner, RandomForestClassifier)


def _grown(cells: DataFrame, learner, models: list[tuple[str, int]], n_trees: int, depth: int, least: float) -> dict:
    p = len(cells.select("_features").first()[0])
    classes = len(cells.schema["_label"].metadata["ml_attr"]["vals"])
    blocks = blocks_of(cells).persist()
    try:
        return grow(blocks, p, learner.getMaxBins(), classes, models, n_trees, depth, least, learner.getSeed() & 0x7FFFFFFF)
    finally:
        blocks.unpersist()


def _fit_cells(cells: DataFrame, cuts: list[list[float]], learner, choice: Mapping):
    """The model of one candidate, fitted to cells, with its thresholds among the values."""
    spark, chosen = cells.sparkSession, learner.copy(choice)
    trees = None
    if forest(learner):
        impurity, depth, least = chosen.getImpurity(), chosen.getMaxDepth(), chosen.getMinInfoGain()
        trees = _grown(cells, chosen, [(impurity, -1)], chosen.getNumTrees(), depth, least)[impurity, -1]
        labels = cells.schema["_label"].metadata
        model = chosen.fit(one_of_each(cells).withMetadata("_label", labels))
    else:
        model = chosen.fit(cells)
    path = new_folder(spark, "cells")
    try:
        model.write().save(path)
        stored = spark.read.parquet(f"{path}/data")
        if trees is None:
            rows = [r.asDict(recursive=True) for r in stored.collect()]
        else:
            rows = [{"treeID": t, "nodeData": node} for t, tree in enumerate(trees) for node in _stored_nodes(tree, least, depth)]
        for row in rows:
            split = row.get("nodeData", row)["split"]
            if split["featureIndex"] >= 0:
                # a threshold between two codes is the cut above the lower one
                split["leftCategoriesOrThreshold"] = [cuts[split["featureIndex"]][int(np.floor(split["leftCategoriesOrThreshold"][0]))]]
        spark.createDataFrame(rows, stored.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
        return type(model).load(path)
    finally:
        drop_steps(spark, [path])


def _stored_nodes(tree: Mapping[str, np.ndarray], least: float, depth: int) -> list[dict]:
    """The nodes of a grown tree as a model stores them; splits into leaves of one prediction are undone, as in a fitted tree."""
    splits = splitting(tree, least, depth)
    kept = np.flatnonzero(_leaf_of(tree, splits) == np.arange(len(splits))).tolist()
    name = {old: new for new, old in enumerate(kept)}
    out = []
    for i in kept:
        split = bool(splits[i])
        out.append({"id": name[i], "prediction": float(tree["votes"][i].argmax()), "impurity": float(tree["impurity"][i]),
                    "impurityStats": tree["counts"][i].tolist(), "rawCount": int(tree["counts"][i].sum()), "gain": float(tree["gain"][i]) if split else -1.0,
                    "leftChild": name[int(tree["leftChild"][i])] if split else -1, "rightChild": name[int(tree["rightChild"][i])] if split else -1,
                    "split": {"featureIndex": int(tree["feature"][i]) if split else -1, "leftCategoriesOrThreshold": [float(tree["at"][i])] if split else [], "numCategories": -1}})
    return out


def _fit(df: DataFrame, cols: Sequence[str], target: str, learner, grid: Mapping[str, Sequence],
         folds: int, parallelism: int, fold_key: Sequence[str] | None, seed: int) -> TreeClassifier:
    scaler = Scaler.fit(df, cols)
    names = [f"_z{i}" for i in range(len(cols))]
    rows = df.select(*[scaler.scaled(c).alias(n) for c, n in zip(cols, names)],
                     F.col(target).cast("string").alias("_target"),
                     F.pmod(F.xxhash64(F.lit(seed), *(fold_key or df.columns)), F.lit(folds))
                     .cast("int").alias("_fold")).na.drop()
    assemble = VectorAssembler(inputCols=names, outputCol="_features")
    index = StringIndexer(inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    whole = merged(rows, names, "_target", "_fold", learner.getMaxBins(), folds * len(index.labels)) if set(grid) <= {"impurity", PRUNING, *CUTS} else None
    cells, cuts = whole or (rows, None)
    if cuts is not None and not forest(learner):
        learner = learner.copy({learner.weightCol: "_n"})
    prepared = keep_cached(index.transform(assemble.transform(cells)).select("_features", "_label", "_fold", *(["_n"] if cuts is not None else [])))

    def fit_one(choice: Mapping):
        return learner.fit(prepared, choice) if cuts is None else _fit_cells(prepared, cuts, learner, choice)

    try:
        of = [dict(zip(grid, values)) for values in product(*grid.values())]
        choices = [{learner.getParam(n): v for n, v in c.items() if n != PRUNING} for c in of]
        if len(of) == 1:
            best = of[0]
            fitted = fit_one(choices[0])
        elif set(grid) <= {"impurity", PRUNING, *CUTS}:
            found = _accuracies(prepared, learner, grid, folds, parallelism)
            names = ("impurity", *CUTS, *([PRUNING] if PRUNING in grid else []))
            def full(c):
                return tuple(c.get(n, learner.getOrDefault(n) if learner.hasParam(n) else 1) for n in names)
            chosen = max(range(len(of)), key=lambda i: (found[full(of[i])], -i))
            best = of[chosen]
            fitted = fit_one(choices[chosen])
        elif PRUNING in grid:
            raise ValueError(f"{PRUNING} is searched beside {', '.join(('impurity', *CUTS))}, not beside {sorted(set(grid) - {PRUNING})}")
        else:
            search = CrossValidator(
                estimator=learner, estimatorParamMaps=choices, numFolds=folds, foldCol="_fold",
                evaluator=MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy"),
                parallelism=parallelism)
            result = search.fit(prepared)
            fitted = result.bestModel
            scores = result.avgMetrics
            best = of[max(range(len(scores)), key=lambda i: (scores[i], -i))]
        fitted = pruned(fitted, best.get(PRUNING, 0.0), df.sparkSession)
    finally:
        prepared.unpersist()
    back = IndexToString(inputCol="prediction", outputCol="y_pred", labels=index.labels)
    model = PipelineModel([assemble, fitted, back])
    return TreeClassifier(scaler, model, dict(best))


def fit_tree(df: DataFrame, cols: Sequence[str], target: str = "target", grid: Mapping | None = None,
             folds: int = FOLDS, parallelism: int = 4,
             fold_key: Sequence[str] | None = None, seed: int = 42) -> TreeClassifier:
    """Decision tree, best of a grid (the full one unless given) by accuracy over the folds."""
    learner = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", seed=seed)
    return _fit(df, cols, target, learner, grid or TREE_GRID, folds, parallelism, fold_key, seed)


def fit_forest(df: DataFrame, cols: Sequence[str], target: str = "target", grid: Mapping | None = None,
               folds: int = FOLDS, parallelism: int = 4,
               fold_key: Sequence[str] | None = None, seed: int = 42) -> TreeClassifier:
    """Random forest, best of a grid (the full one unless given) by accuracy over the folds."""
    learner = RandomForestClassifier(featuresCol="_features", labelCol="_label", seed=seed)
    return _fit(df, cols, target, learner, grid or FOREST_GRID, folds, parallelism, fold_key, seed)
