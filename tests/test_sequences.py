"""Gap-constrained patterns against trying all of them, and the number of candidates counted."""

import random
from collections import Counter, defaultdict
from math import ceil

import pytest

from lynceus.operators import sequences


def plain(rows, share, max_len, gap):
    seqs = defaultdict(list)
    for s, p, i in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        seqs[s].append(i)
    support = Counter()
    for items in seqs.values():
        ends, found = {((x,), at) for at, x in enumerate(items)}, set()
        for _ in range(max_len):
            found |= {p for p, _ in ends}
            ends = {((*p, items[to]), to) for p, at in ends for to in range(at + 1, min(at + gap, len(items) - 1) + 1)}
        support.update(found)
    wanted = max(1, ceil(share * len(seqs) - 1e-9))
    return {p: n for p, n in support.items() if n >= wanted}


def mined(spark, rows, share, max_len, gap, **more):
    df = spark.createDataFrame(rows, "s int, p long, i string").repartition(4)
    out = sequences.sequential_patterns(df, "s", "p", "i", share, max_len=max_len, max_gap=gap, **more).collect()
    assert len({tuple(r["pattern"]) for r in out}) == len(out)
    return {tuple(r["pattern"]): r["support"] for r in out}


def random_rows(seed, n, letters, longest, first=1):
    r = random.Random(seed)
    return [(s, p + first, r.choice(letters)) for s in range(n) for p in range(r.randrange(1, longest))]


@pytest.mark.parametrize("seed,letters,longest,share,max_len,gap,first", [(0, "abc", 12, 0.3, 4, 2, 1), (1, "abcdef", 20, 0.2, 3, 4, 0), (2, "ab", 30, 0.5, 6, 1, 1)])
def test_against_all_patterns(spark, seed, letters, longest, share, max_len, gap, first):
    rows = random_rows(seed, 40, letters, longest, first)
    assert mined(spark, rows, share, max_len, gap) == plain(rows, share, max_len, gap)


def test_long_sequences_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(sequences.segments, "__defaults__", (5,))
    rows = random_rows(3, 6, "abcdefgh", 90)
    assert mined(spark, rows, 0.5, 4, 2) == plain(rows, 0.5, 4, 2)


def test_few_candidates_are_counted(spark):
    """Extending every pattern by every item would try 26 for each; the three tests leave the planted ones."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    r, rows = random.Random(5), []
    for s in range(200):
        items = list(r.sample(letters[5:], 20)) + list("abcde")
        rows += [(s, p + 1, x) for p, x in enumerate(items)]
    tried = []
    found = mined(spark, rows, 0.6, 6, 1, tried=tried)
    assert found == plain(rows, 0.6, 6, 1) and ("a", "b", "c", "d", "e") in found
    assert tried == [26 ** 2, 3, 2, 1, 0]


def test_required_items_gaps_and_empty_tables(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "x"), (2, 3, "b"), (3, 1, None), (None, 1, "a")]
    assert mined(spark, rows, 0.6, 3, 2) == {("a",): 2, ("b",): 2, ("a", "b"): 2}
    assert mined(spark, rows, 0.6, 3, 1) == {("a",): 2, ("b",): 2}
    assert mined(spark, rows, 0.3, 3, 2, required=["x"], min_len=2) == {("a", "x"): 1, ("x", "b"): 1, ("a", "x", "b"): 1}
    assert mined(spark, [], 0.5, 3, 2) == {}
    with pytest.raises(ValueError):
        mined(spark, rows, 0.5, 3, 0)


def test_equal_sequences_are_matched_once(spark, monkeypatch):
    rows = [(s, p + 1, x) for s in range(300) for p, x in enumerate(("abc", "abd", "ca")[s % 3])]
    held, inner = [], sequences.segments

    def kept(*args):
        held.append(inner(*args))
        return held[-1]
    monkeypatch.setattr(sequences, "segments", kept)
    assert mined(spark, rows, 0.3, 3, 2) == plain(rows, 0.3, 3, 2)
    assert sorted(r["n"] for r in held[0].collect()) == [100, 100, 100]
