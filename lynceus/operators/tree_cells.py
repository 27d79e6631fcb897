"""Trees over merged rows: values become codes of at most ``maxBins`` bins, and equal rows become one cell with a count.

A tree sees nothing of a row but its bins, so that a tree over weighted cells is the tree over
the rows.  Cells of few columns are bounded by the bins, however long the table is.  A
forest draws its bootstrap by row: a cell of n rows gets a Poisson(n) weight in each tree, the sum of its rows'
Poisson(1) counts.  All trees of all folds and impurities grow a level a job; tasks add up histograms of cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, prod, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shorter tables are searched row by row; longer ones are merged where that leaves a fourth of the rows or less.
MERGE_ROWS, MERGE_SHARE = 50_000, 4
#: Cells of a block, whose bootstrap weights are drawn together; bytes of histograms that a task holds.
BLOCK_CELLS, HISTOGRAM_BYTES = 4_096, 64 << 20
#: Rank error of the cuts of a column with more values than bins, a thirtieth of a bin.
RANK_ERROR = 0.001


def cuts_of(rows: DataFrame, names: Sequence[str], bins: int, guess: Sequence[int] | None = None) -> list[list[float]]:
    """At most ``bins`` - 1 cuts a column: between all values where they are few, else at quantiles of all rows."""
    guess = guess or rows.agg(*[F.approx_count_distinct(c) for c in names]).first()
    few = [c for c, n in zip(names, guess) if n <= 2 * bins]
    values = {c: sorted(r[0] for r in rows.select(c).distinct().collect()) for c in few}
    many = [c for c in names if len(values.get(c, range(bins + 1))) > bins]
    ranks = [i / bins for i in range(1, bins)]
    found = dict(zip(many, rows.approxQuantile(many, ranks, RANK_ERROR))) if many else {}
    return [sorted(set(found[c])) if c in found else [(a + b) / 2 for a, b in zip(values[c], values[c][1:])] for c in names]


def merged(rows: DataFrame, names: Sequence[str], label: str, fold: str, bins: int, groups: int) -> tuple[DataFrame, list[list[float]]] | None:
    """(cells with codes in place of the values and their count ``_n``, cuts); None where rows are few or hardly alike.

    A value belongs to the code of the cuts below it, so that code <= j means value <= cuts[j].  ``groups``: pairs of label and fold.
    """
    n, *guess = rows.agg(F.count(F.lit(1)), *[F.approx_count_distinct(c) for c in names]).first()
    if n <= MERGE_ROWS or bins > 256:
        return None
    cuts = cuts_of(rows, names, bins, guess)
    # the intervals of a bucketizer are closed on their left
    inner = [[float(np.nextafter(x, np.inf)) for x in at] or [np.finfo(float).max] for at in cuts]
    codes = [f"_code{i}" for i in range(len(names))]
    coded = Bucketizer(inputCols=list(names), outputCols=codes, splitsArray=[[-np.inf, *at, np.inf] for at in inner]).transform(rows)
    coded = coded.select(*[F.col(c).cast("short").alias(name) for c, name in zip(codes, names)], label, fold)
    most = groups * prod(len(at) + 1 for at in cuts)
    if most * MERGE_SHARE > n and coded.agg(F.approx_count_distinct(F.xxhash64(*coded.columns))).first()[0] * MERGE_SHARE > n:
        return None
    cells = coded.groupBy(*coded.columns).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return cells.withColumns({c: F.col(c).cast("double") for c in names}), cuts


def blocks_of(cells: DataFrame) -> DataFrame:
    """Cells (_features of codes, _label, _fold, _n) packed side by side, a row a block; a block's cells and their order follow from the cells alone."""
    p = len(cells.select("_features").first()[0])
    n = cells.count()
    parts = max(1, ceil(n / BLOCK_CELLS))
    x = vector_to_array("_features")
    rows = cells.select(*[x[i].cast("int").alias(f"x{i}") for i in range(p)], F.col("_label").cast("int").alias("label"), F.col("_fold").alias("fold"), "_n")
    by = ["fold", "label", *[f"x{i}" for i in range(p)]]
    placed = rows.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        codes = pdf[by[2:]].to_numpy().astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "codes": [codes.tobytes()], "label": [pdf["label"].to_numpy(np.int32).tobytes()],
                             "fold": [pdf["fold"].to_numpy(np.int32).tobytes()], "n": [pdf["_n"].to_numpy(np.float64).tobytes()]})

    tasks = min(parts, cells.sparkSession.sparkContext.defaultParallelism)
    return placed.repartition(tasks, "block").groupBy("block").applyInPandas(pack, "block int, codes binary, label binary, fold binary, n binary")


def impurities(votes: np.ndarray, kind: str) -> np.ndarray:
    """Gini index or entropy in bits along the last axis."""
    share = votes / np.maximum(votes.sum(axis=-1, keepdims=True), 1e-300)
    if kind == "gini":
        return 1 - (share ** 2).sum(axis=-1)
    return -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=-1)


def best_split(hist: np.ndarray, kind: str, least: float) -> tuple[float, int, int] | None:
    """(gain, place of the feature, cut) from counts by feature, code and class; None where no cut gains."""
    left = hist.cumsum(axis=1)[:, :-1]
    whole = hist.sum(axis=1, keepdims=True)
    right = whole - left
    wl, wr = left.sum(axis=2), right.sum(axis=2)
    total = np.maximum(wl + wr, 1e-300)
    gain = impurities(whole, kind) - wl / total * impurities(left, kind) - wr / total * impurities(right, kind)
    gain = np.where((wl > 0) & (wr > 0), gain, -1.0)
    if not gain.size or (best := float(gain.max())) <= 0 or best < least:
        return None
    j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return best, int(j), int(cut)


def _walk(codes: np.ndarray, tree: dict) -> np.ndarray:
    node, row = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while (split := tree["left"][node] >= 0).any():
        low = codes[row, np.maximum(tree["feature"][node], 0)] <= tree["cut"][node]
        node = np.where(split, np.where(low, tree["left"][node], tree["left"][node] + 1), node)
    return node


def grow(blocks: DataFrame, p: int, bins: int, classes: int, models: Sequence[tuple[str, int]], n_trees: int, depth: int, least: float,
         seed: int) -> dict[tuple[str, int], list[dict[str, np.ndarray]]]:
    """Forests of all ``models`` (impurity, fold left out, -1 for none), trees in the form of ``trees._nodes``, with cuts between codes."""
    k = p if n_trees == 1 else ceil(sqrt(p))
    keys = [(m, t) for m in range(len(models)) for t in range(n_trees)]
    trees = {key: {"left": [-1], "feature": [-1], "cut": [-1], "gain": [-1.0], "votes": [None]} for key in keys}
    active = {key: [0] for key in keys}
    for level in range(depth + 1):
        waiting = [key for key in keys if active[key]]
        while waiting:
            group, held = [], 0
            while waiting and (not group or held + len(active[waiting[0]]) * k * bins * classes * 8 <= HISTOGRAM_BYTES):
                key = waiting.pop(0)
                group.append(key)
                held += len(active[key]) * k * bins * classes * 8
            subsets = {(m, t): np.array([np.sort(np.random.default_rng([seed, models[m][1] + 1, t, node]).permutation(p)[:k]) for node in active[m, t]])
                       for m, t in group}
            found = _level(blocks, {key: {c: np.array(trees[key][c]) for c in ("left", "feature", "cut")} for key in group},
                           {key: np.array(active[key]) for key in group}, subsets, p, bins, classes, models, n_trees, least, seed)
            for key in group:
                tree, nodes, active[key] = trees[key], active[key], []
                for slot, node in enumerate(nodes):
                    votes, split = found.get((*key, slot), (np.zeros(classes), None))
                    tree["votes"][node] = votes
                    if split is None or level == depth:
                        continue
                    gain, j, cut, left = split
                    child = len(tree["left"])
                    tree["left"][node], tree["feature"][node], tree["cut"][node], tree["gain"][node] = child, int(subsets[key][slot][j]), cut, gain
                    for votes_of in (left, votes - left):
                        tree["votes"].append(votes_of)
                        for c, v in (("left", -1), ("feature", -1), ("cut", -1), ("gain", -1.0)):
                            tree[c].append(v)
                    # a child of one class, or at the last level, is a leaf, and its votes are known
                    active[key] += [] if level + 1 == depth else [i for i in (child, child + 1) if np.count_nonzero(tree["votes"][i]) > 1]
    out: dict = {model: [] for model in models}
    for (m, _), tree in trees.items():
        left, votes = np.array(tree["left"]), np.stack(tree["votes"])
        weight = votes.sum(axis=1)
        out[models[m]].append({"votes": votes / np.maximum(weight[:, None], 1e-300), "counts": votes, "impurity": impurities(votes, models[m][0]),
                               "risk": impurities(votes, models[m][0]) * weight / max(weight[0], 1e-300), "gain": np.array(tree["gain"]),
                               "leftChild": left, "rightChild": np.where(left >= 0, left + 1, -1), "feature": np.array(tree["feature"]),
                               "at": np.array(tree["cut"]) + 0.5})
    return out


def _level(blocks: DataFrame, trees: dict, active: dict, subsets: dict, p: int, bins: int, classes: int, models: Sequence[tuple[str, int]],
           n_trees: int, least: float, seed: int) -> dict:
    """(model, tree, slot) -> (votes, split or None) of the active nodes: one job over the cells."""
    keys = list(trees)
    k = subsets[keys[0]].shape[1]

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                label, fold, n = (np.frombuffer(v, t) for v, t in ((b.label, np.int32), (b.fold, np.int32), (b.n, np.float64)))
                codes = np.frombuffer(b.codes, np.uint8).reshape(-1, p)
                weights = np.random.default_rng([seed, b.block]).poisson(n[:, None], (len(n), n_trees)).astype(np.float64)
                kept = {f: np.flatnonzero(fold != f) for f in {models[m][1] for m, _ in keys}}
                for m, t in keys:
                    rows = kept[models[m][1]]
                    nodes = active[m, t]
                    slot_of = np.full(len(trees[m, t]["left"]), -1)
                    slot_of[nodes] = np.arange(len(nodes))
                    slot = slot_of[_walk(codes[rows], trees[m, t])]
                    rows, slot = rows[slot >= 0], slot[slot >= 0]
                    features = subsets[m, t][slot]
                    at = ((slot[:, None] * k + np.arange(k)) * bins + codes[rows[:, None], features]) * classes + label[rows, None]
                    hist = np.bincount(at.ravel(), np.repeat(weights[rows, t], k), len(nodes) * k * bins * classes)
                    sums[m, t] = sums[m, t] + hist if (m, t) in sums else hist
        for (m, t), hist in sums.items():
            yield pd.DataFrame({"m": [m], "t": [t], "h": [hist.tobytes()]})

    def splits(pdf: pd.DataFrame) -> pd.DataFrame:
        m, t = int(pdf["m"].iloc[0]), int(pdf["t"].iloc[0])
        # whole numbers: their sum does not depend on the order
        hist = sum(np.frombuffer(h, np.float64) for h in pdf["h"]).reshape(-1, k, bins, classes)
        out = []
        for slot, h in enumerate(hist):
            best = best_split(h, models[m][0], least)
            gain, j, cut = best or (-1.0, -1, -1)
            left = h[j, :cut + 1].sum(axis=0) if best else np.zeros(classes)
            out.append((m, t, slot, h[0].sum(axis=0).tolist(), gain, j, cut, left.tolist()))
        return pd.DataFrame(out, columns=["m", "t", "slot", "votes", "gain", "j", "cut", "below"])

    parts = blocks.mapInPandas(histograms, "m int, t int, h binary")
    found = parts.groupBy("m", "t").applyInPandas(splits, "m int, t int, slot int, votes array<double>, gain double, j int, cut int, below array<double>")
    return {(r["m"], r["t"], r["slot"]): (np.array(r["votes"]), (r["gain"], r["j"], r["cut"], np.array(r["below"])) if r["j"] >= 0 else None)
            for r in found.collect()}


def one_of_each(cells: DataFrame) -> DataFrame:
    """A cell of every class, from which an estimator makes a model to be filled with grown trees."""
    return cells.groupBy("_label").agg(F.min(vector_to_array("_features")).alias("x")).select(array_to_vector("x").alias("_features"), "_label")
