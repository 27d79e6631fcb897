"""Exact quantiles of columns of any length, all columns and probabilities in the same passes.

``percentile`` keeps every distinct value of a group in one task, so it is only
used on a row count that fits a task.  Longer columns are narrowed together: one
pass fills a mergeable sketch per column, whose values around the wanted
probabilities are cuts; one pass counts the values at and between the cuts; what
lies between two cuts around a wanted rank, a small share of the rows, is
written once and either searched or cut again.  The number of jobs depends on
the length of the columns alone, by its logarithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.operators.ordering import max_rows_per_task
from lynceus.session import durable

SKETCH_ACCURACY = 10_000
#: Equal shares that a stretch is cut into when it is still longer than a task.
SHARES = 1_000

Blocks = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


@dataclass
class _Stretch:
    """Values of one column between two cuts: how many lie below, how many within, and the ranks looked for."""

    column: str
    below: int
    n: int
    ranks: list[int]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    limit: int | None = None) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column (nulls ignored, NaN above all numbers); a column without values has none."""
    limit = limit or max_rows_per_task(df.sparkSession)
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    small = [c for c in cols if counts[c] <= limit]
    out: dict[str, list[float]] = {}
    if small:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])).alias(c)
                       for c in small]).first()
        out.update({c: list(row[c]) if row[c] is not None else [] for c in small})
    large = [c for c in cols if c not in out]
    if large:
        at = {c: [p * (counts[c] - 1) for p in probs] for c in large}
        ranks = {c: sorted({r for x in at[c] for r in (int(x), min(int(x) + 1, counts[c] - 1))}) for c in large}
        found = _order_statistics(df, large, probs, {c: counts[c] for c in large}, ranks, limit)
        for c in large:
            out[c] = [_between(found, c, x) for x in at[c]]
    return out


def _between(found: dict[tuple[str, int], float], col: str, at: float) -> float:
    below = int(at)
    low = found[col, below]
    return low if at == below else low + (found[col, below + 1] - low) * (at - below)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, column in enumerate(batch.columns):
        yield i, column.drop_null().to_numpy(zero_copy_only=False)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    b, v = batch.column("b").to_numpy(), batch.column("v").to_numpy()
    for k in np.unique(b):
        yield int(k), v[b == k]


def _cell(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """2i + 1 at the i-th cut, 2i in the gap before it."""
    return np.searchsorted(cuts, values, side="left") + np.searchsorted(cuts, values, side="right")


def _counted(rows: DataFrame, blocks: Blocks, cuts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The number of values in every cell of every stretch that has cuts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {b: np.zeros(2 * len(c) + 1, np.int64) for b, c in cuts.items()}
        for batch in batches:
            for b, values in blocks(batch):
                if b in cuts:
                    held[b] += np.bincount(_cell(values, cuts[b]), minlength=len(held[b]))
        for b, n in held.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), b, np.int32)), pa.array(cell.astype(np.int32)), pa.array(n[cell])],
                                             names=["b", "cell", "n"])

    out = {b: np.zeros(2 * len(c) + 1, np.int64) for b, c in cuts.items()}
    for b, cell, n in rows.mapInArrow(count, "b int, cell int, n long").groupBy("b", "cell").agg(F.sum("n")).collect():
        out[b][cell] = n
    return out


def _inside(rows: DataFrame, blocks: Blocks, cuts: dict[int, np.ndarray], wanted: dict[int, dict[int, int]]) -> DataFrame:
    """Rows (b, v): the values in the ``wanted`` cells of each stretch, under the new number of the cell; stretches without cuts go."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, values in blocks(batch):
                if wanted.get(b):
                    cell = _cell(values, cuts[b])
                    number = np.full(2 * len(cuts[b]) + 1, -1, np.int32)
                    number[list(wanted[b])] = list(wanted[b].values())
                    named = number[cell]
                    yield pa.RecordBatch.from_arrays([pa.array(named[named >= 0]), pa.array(values[named >= 0])], names=["b", "v"])

    return rows.mapInArrow(keep, "b int, v double")


def _order_statistics(df: DataFrame, cols: list[str], probs: Sequence[float], counts: dict[str, int],
                      ranks: dict[str, list[int]], limit: int) -> dict[tuple[str, int], float]:
    """The value of every (column, rank): ``rank`` values come before it in ascending order."""
    slack = 2.0 / SKETCH_ACCURACY
    shares = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)})
    rows, blocks = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]), _columns
    sketch = rows.agg(*[F.percentile_approx(f"v{i}", shares, SKETCH_ACCURACY) for i in range(len(cols))]).first()
    cuts = {i: np.unique(np.asarray(s, float)) for i, s in enumerate(sketch)}
    open_ = {i: _Stretch(c, 0, counts[c], ranks[c]) for i, c in enumerate(cols)}
    out: dict[tuple[str, int], float] = {}
    short: list[tuple[DataFrame, dict[int, _Stretch]]] = []
    while open_:
        cells = _counted(rows, blocks, cuts)
        wanted: dict[int, dict[int, int]] = {}
        following: dict[int, _Stretch] = {}
        for b, stretch in open_.items():
            ends = np.cumsum(cells[b])
            for rank in stretch.ranks:
                cell = int(np.searchsorted(ends, rank - stretch.below, side="right"))
                if cell % 2:
                    out[stretch.column, rank] = float(cuts[b][cell // 2])
                    continue
                name = wanted.setdefault(b, {}).setdefault(cell, len(following))
                n = int(cells[b][cell])
                following.setdefault(name, _Stretch(stretch.column, stretch.below + int(ends[cell]) - n, n, [])).ranks.append(rank)
        if not following:
            break
        rows, blocks = durable(_inside(rows, blocks, cuts, wanted)), _stretches
        short.append((rows, {b: s for b, s in following.items() if s.n <= limit}))
        open_ = {b: s for b, s in following.items() if s.n > limit}
        if open_:
            rows = rows.filter(F.col("b").isin(list(open_)))
            grid = [i / SHARES for i in range(SHARES + 1)]
            cuts = {b: np.unique(np.asarray(s, float)) for b, s in
                    rows.groupBy("b").agg(F.percentile_approx("v", grid, SKETCH_ACCURACY)).collect()}
    for values, stretches in short:
        if stretches:
            out.update(_searched(values, stretches))
    return out


def _searched(rows: DataFrame, stretches: dict[int, _Stretch]) -> dict[tuple[str, int], float]:
    """The wanted ranks of stretches that fit a task, all in one job."""
    looked_for = rows.sparkSession.createDataFrame([(b, r - s.below, r) for b, s in stretches.items() for r in s.ranks],
                                                   "b int, place long, rank long")
    up_to = F.sum("c").over(Window.partitionBy("b").orderBy("v"))
    runs = (rows.filter(F.col("b").isin(list(stretches))).groupBy("b", "v").agg(F.count(F.lit(1)).alias("c"))
            .withColumn("end", up_to))
    # two rows for each probability and column at most
    hits = runs.join(F.broadcast(looked_for), "b").filter("place >= end - c AND place < end")
    return {(stretches[r["b"]].column, r["rank"]): r["v"] for r in hits.select("b", "rank", "v").collect()}
