import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.llm import components as links_of
from lynceus.llm import fingerprints, near_dup
from lynceus.llm.components import components
from tests.llm.conftest import sentence

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    """Component id and set size of every row, by comparing all pairs."""
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min(least.get(k, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    brute.groups = len({find(i) for i in range(len(rows))})
    return [(r["doc_id"], len(s), None if least[find(i)][0] else least[find(i)][1]) for i, (r, s) in enumerate(zip(rows, sets))]


def check(docs):
    found = near_dup.group_near_duplicates(docs).collect()
    want = brute(docs.collect())
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in found) == Counter(want)
    return found, want


def test_documents(documents):
    check(documents)


def test_awkward_rows(awkward, nothing):
    found, _ = check(awkward)
    assert sum(r["first"] for r in found) == brute.groups
    left = near_dup.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns and left.count() == sum(r["first"] for r in found)
    assert near_dup.group_near_duplicates(nothing).count() == 0


def test_families_of_near_copies(spark, monkeypatch):
    """Copies around an original, and chains where only neighbours are similar; with blocks of few rows."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    r, rows = random.Random(5), []
    for family in range(4):
        words = sentence(family, 120).split()
        for _ in range(25):
            w = list(words)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows.append(" ".join(w))
    words = sentence(99, 100).split()
    for step in range(15):
        words[step * 6:step * 6 + 1] = [f"changed{step}"]
        rows.append(" ".join(words))
    r.shuffle(rows)
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))


def test_all_pairs_within_the_distance_share_one_first_key():
    r = np.random.default_rng(1)
    for n in [near_dup.DISTANCE] * 200 + list(range(near_dup.DISTANCE)):
        differ = np.zeros((1, near_dup.SYMBOLS), bool)
        differ[0, r.choice(near_dup.SYMBOLS, n, replace=False)] = True
        assert sum(near_dup._at_first_key(differ, k)[0] for k in range(near_dup.SYMBOLS)) == 1


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (4, 20)] + [(100, x) for x in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    found = {(r["node"], r["root"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {(x, 1) for x in (1, 2, 3, 4, 20)} | {(x, 8) for x in (8, 9, 10)} | {(x, 100) for x in range(100, 160)} | {(x, 200) for x in range(200, 261)}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bound", [2, 256])
def test_components_with_hot_nodes(spark, monkeypatch, bound):
    """Nodes of more links than the bound get their least neighbour by broadcast; components are the same."""
    monkeypatch.setattr(links_of, "HOT_LINKS", bound)
    r = random.Random(5)
    pairs = [(7, i) for i in range(100, 420)] + [(i, i + 1) for i in range(500, 520)] + [(419, 2), (3, 3), (None, 4), (9, None)]
    pairs += [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + pairs[:5]
    root = {n: n for p in pairs if None not in p and p[0] != p[1] for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in found} == set(root.items()) and len(found) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(documents, awkward, nothing):
    for docs in (documents, awkward):
        rows = docs.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
        rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]), reverse=True)
        want = []
        for i, r in enumerate(rows):
            text, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
            changed = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
            a, b, c = fingerprints.sketches([text, changed, after])
            want.append((r["doc_id"], len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.as_text(a),
                         fingerprints.as_text(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
        found = fingerprints.fingerprint(docs).collect()
        assert Counter(map(tuple, found)) == Counter(want)
    assert fingerprints.fingerprint(nothing).count() == 0
    assert fingerprints.fingerprint(documents.filter("doc_id = 3")).first()["near_next"] == 1.0


def test_blocks_do_not_change_fingerprints(documents, monkeypatch):
    before = fingerprints.fingerprint(documents).collect()
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 7)
    assert Counter(map(tuple, before)) == Counter(map(tuple, fingerprints.fingerprint(documents.repartition(3)).collect()))


def test_equal_passages_share_phrases_at_any_offset():
    passage = sentence(1, 400)
    a, b = fingerprints.sketches([sentence(2, 50) + passage, "x" + passage + sentence(3, 60)])
    assert fingerprints.likeness(a, b) > 0.5
    assert fingerprints.likeness(*fingerprints.sketches([passage, sentence(4, 400)])) < 0.1
    # a run is one symbol: one name at each of three levels, and one pair of characters
    assert fingerprints.sketches(["aaaa" * 5000])[0].size == 4
    one, many = fingerprints.sketches([passage])[0], fingerprints.sketches(["q", passage, "", sentence(5, 9)])[1]
    assert (one == many).all()


def test_short_texts_share_names_with_their_halves():
    """Whenever half of a text of two words or more is kept, however short, some name is kept; strangers share few."""
    r, strange = random.Random(9), []
    for words in (*range(2, 13), 20, 40):
        for _ in range(60):
            text, after = (" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(words)) for _ in "ab")
            a, b, c = fingerprints.sketches([text, fingerprints.edited(text, after), after])
            assert fingerprints.likeness(a, b) > 0, text
            strange.append(fingerprints.likeness(a, c))
    assert np.mean(strange) < 0.05
    alone = [fingerprints.sketches([t])[0] for t in ("x", "a b", "", "xy" * 300)]
    assert all(np.array_equal(p, q) for p, q in zip(alone, fingerprints.sketches(["x", "a b", "", "xy" * 300])))
