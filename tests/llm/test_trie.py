"""The prefix trie against plain dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lynceus.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes, from whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said = (role or "", text or "")
            digest = hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, said))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for name in members:
        if name:
            kids[name[:-1]].append(name)
    saved, leaves = {}, {}
    for name in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", name[-1][1])) if name else 0
        saved[name] = (len(members[name]) - 1) * words + sum(saved[k] for k in kids[name])
        leaves[name] = sum(leaves[k] for k in kids[name]) or 1
    ends = {name: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(name)) for name, m in members.items()}
    return sorted((min(m), len(name), min(members[name[:-1]]) if name else None, len(m), len(kids[name]), leaves[name], saved[name],
                   hashlib.sha256(ends[name].encode()).hexdigest()) for name, m in members.items())


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df).collect()), key=lambda r: r[:2])


def same(spark, rows, parts=5, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    expected = plain(rows)
    assert found(df) == sorted(expected, key=lambda r: r[:2])


def forest(seed, n, vocabulary, longest, ids=lambda r, i: i):
    r, rows = random.Random(seed), []
    for i in range(n):
        c = ids(r, i)
        for t in range(r.randrange(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(vocabulary)))
    return rows


@pytest.mark.parametrize("vocabulary", [["a b", "c"], ["a", "b c d", "e f", None, ""] * 2 + [f"w{i} x" for i in range(40)]])
def test_random_forests(spark, vocabulary):
    same(spark, forest(1, 90, vocabulary, 9))
    same(spark, forest(2, 60, vocabulary, 6, lambda r, i: r.randrange(-60, 60)))


def test_a_crowded_sketch_gives_the_same_nodes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_WIDTH", 8)
    monkeypatch.setattr(prefix_trie, "MOST_WIDTH", 8)
    same(spark, forest(3, 80, ["a", "b c", "d"] + [f"w{i}" for i in range(30)], 7))


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_over_many_ranges(spark, many_ranges):
    """Long conversations with the same turns, cut into several ranges, beside short ones."""
    long = [(c, t, "user", f"turn {t % 7} of many") for c in (3, 21, 1000) for t in range(700)]
    rows = long + [(c, t, "user", f"turn {t % 7} of many") for c in range(200, 230) for t in range(3)]
    same(spark, rows, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    placed = prefix_trie.rebuilt(prefix_trie.digested(df.repartition(4), "conv_id", "turn", "role", "text"))
    assert placed.select("range_no").distinct().count() > 2 and prefix_trie.edge_conversations(placed).count() > 0


def test_the_sketch_never_calls_a_shared_name_alone(spark):
    import numpy as np

    r = np.random.default_rng(0)
    names = r.integers(-2**63, 2**63, (3000, 2))
    names[::7] = names[0]
    sketch = prefix_trie.sketch_of(spark.createDataFrame(names.tolist(), "x1 long, x2 long"))
    alone = sketch.alone(names[:, 0].copy(), names[:, 1].copy())
    assert not alone[::7].any() and alone.mean() > 0.7


def test_colliding_names_are_salted_anew(spark, monkeypatch):
    """Digests that can't tell turns apart are noticed, and others taken."""
    real, tried = prefix_trie.in_depth, []

    def poor(placed, edges, salt):
        tried.append(salt)
        rows = real(placed, edges, salt)
        if salt:
            return rows
        from pyspark.sql import functions as F
        # the same name whatever came before: depth and nothing else of all but the last turn
        return rows.withColumn("l1", F.col("depth").cast("long")).withColumn("l2", F.col("depth").cast("long"))

    monkeypatch.setattr(prefix_trie, "in_depth", poor)
    same(spark, forest(5, 40, ["a", "b", "c d"], 5))
    assert tried == [0, 2]


def test_awkward_rows(spark):
    rows = [(0, None, None, None, "x"), (0, 5, "user", "first  words\t here", "x"), (0, 5, "user", "first  words\t here", "y"), (0, 5, "user", "tie", None),
            (None, 1, "user", "lost", None), (1, 0, "us", "er1:x", None), (2, 0, "user", "1:x", None), (7, 0, "", "", None), (41, 0, None, None, None),
            (45, 1, "a", "long " * 50_000, None), (47, 1, "a", "long " * 50_000, None), (60, 0, "a", "é\x1c\xa0 b", None), (61, 0, "a", "b", None)]
    schema = SCHEMA + ", depth string"
    same(spark, rows, 3, schema)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
    same(spark, [(5, None, None, None)])
    with pytest.raises(ValueError):
        prefix_trie.trie(spark.createDataFrame([("a", 1, "a", "b")], "conv_id string, turn long, role string, text string"))


def test_turnless_conversations_belong_to_the_root(spark):
    short = [c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 4 and c % 20]
    same(spark, [(c, 0, "user", "only") for c in short])


def test_small_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(df) == sorted(plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]), key=lambda r: r[:2])
