"""Discrete Bayesian network: structure search, conditional tables, prediction.

Everything the search needs from the data is, per set of variables, the sum of
N ln N over its configurations: the log likelihood of a family is the
difference of two such sums.  Columns become small codes once; each step of the
search is one job over the coded columns that its new families need, in which
tasks fill contingency arrays and only cells that occur are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import log, prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.operators.eda import QuantileBinner
from lynceus.session import durable, sized

DEFAULT_BINS = 100
Edge = tuple[str, str]

#: A discrete variable of a network has at most this many values; more are refused.
MOST_LEVELS = 1 << 16
#: Cells of a contingency array that a task holds densely, for one set and for all sets of a job.
DENSE_CELLS, JOB_CELLS = 1 << 17, 1 << 24
#: Rows that a task counts at a time, and occupied cells of a sparse set that it holds.
COUNT_ROWS, SPARSE_CELLS = 1 << 16, 1 << 20
#: Cell numbers stay within 64-bit integers.
MOST_CELLS = 1 << 62


def _plain(df: DataFrame, col: str):
    """A column as numbers, texts, booleans or dates; equal values stay equal."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col(col).cast("double") + F.lit(0.0)).alias(col)  # no negative zero
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).alias(col)
    if isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.DecimalType)):
        return F.col(col)
    return F.col(col).cast("string").alias(col)


def _count_cells(codes: dict[str, np.ndarray], members: list[str], radix: dict[str, int]) -> np.ndarray:
    """The cell number of every row in the contingency array of ``members``."""
    cell = np.zeros(len(next(iter(codes.values()))), np.int64)
    for c in members:
        cell = cell * radix[c] + codes[c]
    return cell


class FamilyScores:
    """Cached BIC scores of families over one discrete table.

    Null is a value of its own in the counts and none among the levels of a variable.
    ``jobs`` counts the passes over the coded table.
    """

    def __init__(self, df: DataFrame, cols: Sequence[str]):
        self.cols = list(cols)
        plain = df.select(*[_plain(df, c) for c in self.cols])
        about = plain.agg(F.count(F.lit(1)), *[F.approx_count_distinct(c, 0.02) for c in self.cols]).first()
        self.n, self.jobs = about[0], 0
        many = [c for c, n in zip(self.cols, about[1:]) if n > MOST_LEVELS]
        if many:
            raise ValueError(f"columns {many} have more than {MOST_LEVELS} values; bin them before the network is learned")
        found = plain.agg(*[F.collect_set(c) for c in self.cols]).first()
        values = {c: sorted(v) for c, v in zip(self.cols, found)}
        self.levels = {c: len(v) for c, v in values.items()}
        self._radix = {c: n + 1 for c, n in self.levels.items()}
        self._at = {c: f"c{i}" for i, c in enumerate(self.cols)}
        at = self._at

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = None
            for batch in batches:
                sets = sets or {c: pa.array(values[c], batch.schema.field(i).type) for i, c in enumerate(at)}
                coded = [pc.add(pc.fill_null(pc.index_in(batch.column(i), sets[c]), -1), 1) for i, c in enumerate(at)]
                yield pa.RecordBatch.from_arrays([a.cast(pa.int32()) for a in coded], names=list(at.values()))

        self.coded = durable(plain.mapInArrow(code, ", ".join(f"{name} int" for name in at.values())))
        self.sums: dict[frozenset, float] = {frozenset(): self.n * log(max(self.n, 1))}

    def cells(self, s: Iterable[str]) -> int:
        return prod(self._radix[c] for c in s)

    def load(self, sets: Iterable[frozenset]) -> None:
        """Fetch the N ln N sums of variable sets that are not cached yet; one job unless their arrays exceed a task."""
        new = sorted({s for s in sets if s not in self.sums}, key=lambda s: (self.cells(s), sorted(s)))
        part: list[frozenset] = []
        held = 0
        for s in new:
            takes = self.cells(s) if self.cells(s) <= DENSE_CELLS else SPARSE_CELLS
            if part and held + takes > JOB_CELLS:
                self._count(part)
                part, held = [], 0
            part, held = [*part, s], held + takes
        if part:
            self._count(part)

    def _count(self, sets: list[frozenset]) -> None:
        self.jobs += 1
        at, radix = self._at, {self._at[c]: r for c, r in self._radix.items()}
        members = [sorted(at[c] for c in s) for s in sets]
        size = [self.cells(s) for s in sets]
        if max(size) > MOST_CELLS:
            raise ValueError(f"a family of {sorted(sets[-1])} has more cells than numbers")
        names = sorted({c for m in members for c in m})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dense = {i: np.zeros(n, np.int64) for i, n in enumerate(size) if n <= DENSE_CELLS}
            sparse = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i, n in enumerate(size) if n > DENSE_CELLS}

            def rows(i: int, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), i, np.int32)), pa.array(cell), pa.array(n)],
                                                  names=["s", "cell", "n"])

            def add(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(held)
                codes = {c: table.column(c).to_numpy().astype(np.int64) for c in names}
                for i, m in enumerate(members):
                    cell = _count_cells(codes, m, radix)
                    if i in dense:
                        dense[i] += np.bincount(cell, minlength=size[i])
                        continue
                    seen, n = np.unique(np.concatenate((sparse[i][0], cell)), return_inverse=True)
                    weight = np.concatenate((sparse[i][1], np.ones(len(cell), np.int64)))
                    total = np.zeros(len(seen), np.int64)
                    np.add.at(total, n, weight)
                    if len(seen) > SPARSE_CELLS:
                        yield rows(i, seen, total)
                        seen, total = seen[:0], total[:0]
                    sparse[i] = seen, total

            held, waiting = [], 0
            for batch in batches:
                held, waiting = [*held, batch], waiting + batch.num_rows
                if waiting >= COUNT_ROWS:
                    yield from add(held)
                    held, waiting = [], 0
            if waiting:
                yield from add(held)
            for i, n in dense.items():
                cell = np.flatnonzero(n)
                yield rows(i, cell, n[cell])
            for i, (cell, n) in sparse.items():
                yield rows(i, cell, n)

        # a task hands on its occupied cells once, so few long tasks shuffle less than many short ones
        tasks = 2 * self.coded.sparkSession.sparkContext.defaultParallelism
        cells = self.coded.select(*names).coalesce(tasks).mapInArrow(count, "s int, cell long, n long")
        counts = cells.groupBy("s", "cell").agg(F.sum("n").alias("n"))
        found = dict(counts.groupBy("s").agg(F.sum(F.col("n") * F.log("n"))).collect())
        self.sums.update({s: found.get(i, 0.0) for i, s in enumerate(sets)})

    def penalty(self, child: str, parents: Iterable[str]) -> float:
        return 0.5 * log(max(self.n, 1)) * prod(self.levels[p] for p in parents) * (self.levels[child] - 1)

    def known(self, child: str, parents: frozenset) -> bool:
        return parents in self.sums and parents | {child} in self.sums

    def family(self, child: str, parents: Iterable[str]) -> float:
        """BIC of one family: log likelihood - ln(N) / 2 * free parameters."""
        parents = frozenset(parents)
        self.load([parents, parents | {child}])
        return self.sums[parents | {child}] - self.sums[parents] - self.penalty(child, parents)

    def at_most(self, child: str, parents: frozenset) -> float:
        """The BIC of a family if its counts are known, else a bound: no likelihood exceeds 1."""
        return self.family(child, parents) if self.known(child, parents) else -self.penalty(child, parents)

    def bic(self, edges: Iterable[Edge]) -> float:
        parents = parents_of(self.cols, edges)
        self.load([s for c, p in parents.items() for s in (p, p | {c})])
        return sum(self.family(c, p) for c, p in parents.items())


def parents_of(cols: Sequence[str], edges: Iterable[Edge]) -> dict[str, frozenset]:
    edges = list(edges)
    return {c: frozenset(a for a, b in edges if b == c) for c in cols}


def _reaches(parents: dict[str, frozenset], a: str, b: str, without: Edge | None = None) -> bool:
    """Whether a path of edges leads from ``a`` to ``b``, ``without`` one edge."""
    seen, open_ = set(), [b]
    while open_:
        c = open_.pop()
        if c == a:
            return True
        if c not in seen:
            seen.add(c)
            open_ += [p for p in parents[c] if (p, c) != without]
    return False


def _moves(cols: Sequence[str], parents: dict[str, frozenset], most: int | None) -> Iterator[list[tuple[str, frozenset]]]:
    """The families that each allowed deletion, reversal or addition of an edge changes."""
    for a in sorted(cols):
        for b in sorted(cols):
            if a == b:
                continue
            if a in parents[b]:
                yield [(b, parents[b] - {a})]
                if (most is None or len(parents[a]) < most) and not _reaches(parents, a, b, (a, b)):
                    yield [(b, parents[b] - {a}), (a, parents[a] | {b})]
            elif b not in parents[a] and (most is None or len(parents[b]) < most) and not _reaches(parents, b, a):
                yield [(b, parents[b] | {a})]


def learn_structure(df: DataFrame, cols: Sequence[str], max_parents: int | None = None,
                    scores: FamilyScores | None = None) -> list[Edge]:
    """Hill climbing by add, delete and reverse moves on the BIC; ties go to the first move by name.

    A move is scored by the one or two families that it changes, and counted only
    if it could gain were its new families certain: with many levels the penalty alone
    rules most of them out.  An empty table has no edges.
    """
    scores = scores or FamilyScores(df, cols)
    parents: dict[str, frozenset] = {c: frozenset() for c in cols}
    scores.load([frozenset([c]) for c in cols])
    # scores that differ by rounding only are ties
    close = 1e-9 + 1e-13 * scores.n * log(max(scores.n, 1))
    while True:
        here = {c: scores.family(c, p) for c, p in parents.items()}
        scores.load([s for c, p in parents.items() for a in p for s in (p - {a}, p - {a} | {c})])

        def gain(move, score):
            return sum(score(c, p) - here[c] for c, p in move)

        moves = [m for m in _moves(cols, parents, max_parents) if gain(m, scores.at_most) > close]
        scores.load([s for m in moves for c, p in m for s in (p, p | {c})])
        best, most = None, close
        for m in moves:
            g = gain(m, scores.family)
            if g > most:
                best, most = m, g + close
        if best is None:
            return sorted((p, c) for c, of in parents.items() for p in of)
        parents |= dict(best)


def fit_cpt(df: DataFrame, child: str, parents: Sequence[str]) -> DataFrame:
    """Maximum-likelihood table: parents..., child, n, p."""
    parents = sorted(parents)
    counts = df.groupBy(*parents, child).agg(F.count(F.lit(1)).alias("n"))
    if parents:
        totals = counts.groupBy(*parents).agg(F.sum("n").alias("_t"))
        return counts.join(totals, parents).withColumn("p", F.col("n") / F.col("_t")).drop("_t")
    return counts.withColumn("p", F.col("n") / F.lit(df.count()))


def fit_cpts(df: DataFrame, cols: Sequence[str], edges: Iterable[Edge]) -> dict[str, DataFrame]:
    return {c: fit_cpt(df, c, sorted(p)) for c, p in parents_of(cols, edges).items()}


def bn_predict(df: DataFrame, cpts: dict[str, DataFrame], edges: Iterable[Edge], target: str,
               ) -> DataFrame:
    """Most probable target given all other variables.

    Only the Markov blanket matters, so the target is scored once per distinct
    blanket configuration and joined back.  A configuration never seen with a
    class rules that class out; when every class is ruled out, the prior
    decides.
    """
    edges = list(edges)
    cols = list(cpts)
    parents = parents_of(cols, edges)
    children = [c for c in cols if target in parents[c]]
    blanket = sorted((set(parents[target]) | set(children)
                      | {p for c in children for p in parents[c]}) - {target})
    prior = (cpts[target].groupBy(target).agg(F.sum("n").alias("_n")))
    if not blanket:
        best = prior.orderBy(F.col("_n").desc(), target).first()[0]
        return df.withColumn("y_pred", F.lit(best))
    # one row per configuration and class; the classes are few
    classes = [F.struct(F.lit(r[target]).alias(target), F.lit(r["_n"]).alias("_n"))
               for r in prior.orderBy(target).collect()]
    rows = (df.select(*blanket).distinct().withColumn("_c", F.explode(F.array(*classes)))
            .select(*blanket, "_c.*"))
    total = F.lit(0.0)
    for i, c in enumerate([target, *children]):
        keys = sorted(parents[c] | {c})
        rows = rows.join(cpts[c].select(*keys, F.log("p").alias(f"_l{i}")), keys, "left")
        total = total + F.coalesce(f"_l{i}", F.lit(float("-inf")))
    # highest log joint, then highest prior, then smallest label
    rows = rows.withColumn("_s", total)
    rank = F.struct(F.col("_s"), F.when(F.col("_s") == float("-inf"), F.col("_n")).otherwise(0))
    top = rows.groupBy(*blanket).agg(F.max(rank).alias("_best"))
    chosen = (rows.join(top, blanket).filter(rank == F.col("_best"))
              .groupBy(*blanket).agg(F.min(target).alias("y_pred")))
    return df.join(sized(chosen), blanket, "left")


@dataclass
class BayesNet:
    """Quantile-binned network: frozen bin edges, structure and tables."""

    binner: QuantileBinner
    target: str
    edges: list[Edge]
    cpts: dict[str, DataFrame]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], target: str = "target", bins: int = DEFAULT_BINS,
            max_parents: int | None = None) -> BayesNet:
        binner = QuantileBinner.fit(df, cols, bins)
        names = [*cols, target]
        table = binner.transform(df.select(*names)).na.drop()
        table = durable(table)
        edges = learn_structure(table, names, max_parents)
        cpts = {c: durable(t) for c, t in fit_cpts(table, names, edges).items()}
        return cls(binner, target, edges, cpts)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = list(self.binner.edges)
        named = {f"_b_{c}": self.binner.bin_of(c) for c in cols}
        renamed = {c: f"_b_{c}" for c in cols}
        rows = df.withColumns(named)
        if self.target in df.columns:
            rows = rows.withColumnRenamed(self.target, "_true")
        cpts = {renamed.get(k, k): v.withColumnsRenamed(renamed) for k, v in self.cpts.items()}
        edges = [(renamed.get(a, a), renamed.get(b, b)) for a, b in self.edges]
        out = bn_predict(rows, cpts, edges, self.target).drop(*named)
        return out.withColumnRenamed("_true", self.target)
