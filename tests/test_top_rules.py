"""Best-first search of the best rules, against all subsets of all baskets."""

import random
from collections import Counter
from itertools import combinations

import pytest

from lynceus.operators import itemsets, top_rules


def every_rule(baskets, k, min_conf):
    support = Counter(s for b in baskets for n in range(1, len(set(b)) + 1) for s in combinations(sorted(set(b)), n))
    rules = []
    for items, n in support.items():
        for size in range(1, len(items)):
            for x in combinations(items, size):
                if n / support[x] >= min_conf:
                    y = tuple(i for i in items if i not in x)
                    rules.append((-n, -n / support[x], f"{' '.join(x)} ==> {' '.join(y)}"))
    return sorted(rules)[:k]


def frame(spark, baskets):
    return spark.createDataFrame([(b,) for b in baskets], "items array<string>")


@pytest.mark.parametrize("seed,letters,share,k,conf", [(0, "abcdef", 0.6, 25, 0.5), (1, "abcdefgh", 0.3, 40, 0.8), (2, "abcde", 0.9, 500, 0.0)])
def test_against_all_subsets(spark, monkeypatch, seed, letters, share, k, conf):
    monkeypatch.setattr(top_rules, "ITEMS_AT_ONCE", 2)
    monkeypatch.setattr(top_rules, "CELLS", 40)
    r = random.Random(seed)
    baskets = [[x for x in letters if r.random() < share] for _ in range(50)]
    found = top_rules.best_rules(frame(spark, baskets).repartition(3), "items", k, conf).collect()
    assert [(-r["support"], -r["confidence"], r["rule"]) for r in found] == every_rule(baskets, k, conf)


def test_nothing_below_the_bound_is_expanded(spark):
    """Many rare items beside two frequent ones: the search never comes to the rare ones."""
    baskets = [["a", "b", f"x{i}", f"y{i}"] for i in range(200)] + [["a"]] * 20
    state = top_rules.search_rules(frame(spark, baskets), "items", 2, 0.8)
    assert [r[4] for r in state.best()] == ["b ==> a", "a ==> b"] and state.bound == 200
    assert min(state.expanded) >= 200 and state.jobs <= 3


def test_no_confident_rule_ends(spark):
    baskets = [list(c) for n in range(1, 8) for c in combinations("abcdefg", n)]
    state = top_rules.search_rules(frame(spark, baskets), "items", 5, 0.99)
    assert state.best() == [] and len(state.expanded) == 2 ** 7 - 1 and state.jobs < 16


def test_ties_nulls_and_empty_tables(spark):
    baskets = [["a", "b", None, "b"], ["b", "a"], None, [], ["c"], [None]]
    found = top_rules.best_rules(frame(spark, baskets), "items", 5, 0.5).collect()
    assert [(r["rule"], r["support"], r["confidence"]) for r in found] == [("a ==> b", 2, 1.0), ("b ==> a", 2, 1.0)]
    for none in ([], [None], [[]]):
        assert top_rules.best_rules(frame(spark, none), "items").count() == 0
        assert itemsets.frequent_itemsets(frame(spark, none), "items", 0.1).count() == 0
