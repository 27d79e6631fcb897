"""The k best association rules without a least support, by best-first expansion.

Item sets wait in a frontier by support.  The best ones are taken in batches;
one job counts all their extensions, and their rules join the best k found so far.
The support of the k-th rule is the bound: it only rises, and what falls
below it is neither counted nor kept.  The search ends when no waiting set
reaches the bound.

A set grows by items that are more frequent than all its own, so that items are
needed only down to the support where the search stands, and every set is reached
once.  The rules of a set need the supports of its subsets.  Those have at least its support and so
are counted before the search ends, most of them before the set is taken.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.session import durable

#: Sets expanded by one job (a power of two, reached by doubling); items fetched at a time; cells of a task's table of baskets by items.
BATCH, ITEMS_AT_ONCE, CELLS = 64, 1_000, 16_000_000


@dataclass
class Search:
    """State and record of one search; items are numbered by falling support, ties by text."""

    k: int
    min_conf: float
    names: list[str] = field(default_factory=list)
    known: dict[tuple[int, ...], int] = field(default_factory=dict)
    waiting: list[tuple[int, int, tuple[int, ...]]] = field(default_factory=list)
    rules: list[tuple[int, float, tuple, tuple]] = field(default_factory=list)
    bound: int = 1
    jobs: int = 0
    expanded: list[int] = field(default_factory=list)

    def add(self, items: tuple[int, ...], support: int) -> None:
        """``items`` ascending: the most frequent first."""
        self.known[items] = support
        heapq.heappush(self.waiting, (-support, len(items), items))

    def take(self, n: int) -> list[tuple[int, ...]]:
        """Up to n of the best waiting sets, none with less than half the support of the first: the bound may soon exclude it."""
        out, least = [], max(self.bound, -self.waiting[0][0] / 2) if self.waiting else 0
        while self.waiting and len(out) < n and -self.waiting[0][0] >= least:
            support, _, items = heapq.heappop(self.waiting)
            self.expanded.append(-support)
            out.append(items)
        return out

    def learn(self, items: tuple[int, ...]) -> bool:
        """Add the rules of a set; false when one of its subsets waits to be counted, since sets of a batch are taken together.

        A larger consequent has a smaller, more frequent antecedent and so no more confidence.
        """
        support, rules = self.known[items], []
        if support < self.bound:
            return True
        level = [(i,) for i in items] if len(items) > 1 else []
        while level:
            good = []
            for then in level:
                given = tuple(i for i in items if i not in then)
                if given not in self.known:
                    return False
                confidence = support / self.known[given]
                if confidence >= self.min_conf:
                    rules.append((support, confidence, given, then))
                    good.append(then)
            size = len(level[0]) + 1
            kept = set(good)
            grown = {tuple(sorted({*a, *b})) for a, b in combinations(good, 2) if a[:-1] == b[:-1]} if size < len(items) else set()
            level = [c for c in grown if all(c[:i] + c[i + 1:] in kept for i in range(size))]
        self.rules += rules
        return True

    def tighten(self) -> None:
        if len(self.rules) >= self.k:
            self.bound = max(self.bound, heapq.nlargest(self.k, (r[0] for r in self.rules))[-1])
            self.rules = [r for r in self.rules if r[0] >= self.bound]

    def best(self) -> list[tuple[list[str], list[str], int, float, str]]:
        def side(items):
            return sorted(self.names[i] for i in items)
        rows = [(side(x), side(y), n, c, f"{' '.join(side(x))} ==> {' '.join(side(y))}") for n, c, x, y in self.rules]
        return sorted(rows, key=lambda r: (-r[2], -r[3], r[4]))[:self.k]


def count_extensions(baskets: DataFrame, names: list[str], sets: list[tuple[int, ...]], bound: int) -> list[tuple[int, int, int]]:
    """(place in ``sets``, item, count) of the extensions in at least ``bound`` baskets.

    Tasks hold a table of some baskets by the items in question and send sums.
    """
    last = max(s[-1] for s in sets) + 1  # rarer items play no part
    number = {name: i for i, name in enumerate(names[:last])}
    held = baskets.sparkSession.sparkContext.broadcast((number, sets))
    most = max(1, CELLS // last)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sets = held.value
        sums = [np.zeros(s[0], np.int64) for s in sets]
        for batch in batches:
            baskets = [[number[x] for x in b if x in number] for b in batch.column(0).to_pylist()]
            for a in range(0, len(baskets), most):
                part = baskets[a:a + most]
                table = np.zeros((len(part), last), bool)
                table[np.repeat(np.arange(len(part)), [len(b) for b in part]), [i for b in part for i in b]] = True
                for total, s in zip(sums, sets):
                    if s[0]:
                        total += table[table[:, list(s)].all(1), :s[0]].sum(0)
        for at, total in enumerate(sums):
            found = np.flatnonzero(total)
            if len(found):
                yield pa.RecordBatch.from_pydict({"at": pa.array([at] * len(found), pa.int32()), "item": pa.array(found.astype(np.int32)),
                                                  "n": pa.array(total[found])})

    rows = (baskets.mapInArrow(count, "at int, item int, n long").groupBy("at", "item").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= bound).collect())
    held.unpersist()
    return [(r["at"], r["item"], r["n"]) for r in rows]


def search_rules(baskets: DataFrame, items: str, k: int = 10, min_conf: float = 0.8, batch: int = BATCH) -> Search:
    """Run the search; the result holds the rules and what was done.  Baskets without items, and null items, count for nothing."""
    every = durable(baskets.select(F.array_distinct(F.array_compact(F.col(items).cast("array<string>"))).alias("items")).filter(F.size("items") > 0))
    supports = durable(every.select(F.explode("items").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    state, size, more, unlearned = Search(k, min_conf), 1, True, []
    while True:
        # items that may be as frequent as the best waiting set come in first
        while more and (not state.waiting or not state.names or state.known[(len(state.names) - 1,)] >= -state.waiting[0][0]):
            after = F.lit(True)
            if state.names:
                name, n = state.names[-1], state.known[(len(state.names) - 1,)]
                after = (F.col("n") < n) | ((F.col("n") == n) & (F.col("name") > name))
            found = supports.filter(after & (F.col("n") >= state.bound)).orderBy(F.desc("n"), "name").limit(ITEMS_AT_ONCE).collect()
            more = len(found) == ITEMS_AT_ONCE
            for r in found:
                state.names.append(r["name"])
                state.add((len(state.names) - 1,), r["n"])
        sets = state.take(size)
        if not sets:
            return state
        if any(s[0] for s in sets):
            state.jobs += 1
            for at, item, n in count_extensions(every, state.names, sets, state.bound):
                state.add((item, *sets[at]), n)
        unlearned = [s for s in [*unlearned, *sets] if not state.learn(s)]
        state.tighten()
        size = min(2 * size, batch)


RULE = "antecedent array<string>, consequent array<string>, support long, confidence double, rule string"


def best_rules(baskets: DataFrame, items: str, k: int = 10, min_conf: float = 0.8) -> DataFrame:
    """The k rules of highest support (then confidence, then text) with enough confidence; fewer where there are fewer."""
    return baskets.sparkSession.createDataFrame(search_rules(baskets, items, k, min_conf).best(), RULE)
