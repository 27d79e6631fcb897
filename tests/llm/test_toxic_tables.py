import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from lynceus.llm import toxicity
from tests.llm.test_models import marked  # noqa: F401


def plain(rows):
    """The mean difference per word of a text, by dictionaries: each class discounted, the rest by the contexts a piece follows."""
    counts, n, kinds, follows = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()], defaultdict(set)
    for r in rows:
        _, before, piece, _ = toxicity.word_pieces([r["text"]])
        counts[r["toxic"]].update(zip(before.tolist(), piece.tolist()))
    for c in (0, 1):
        for (v, w), k in counts[c].items():
            n[c][v] += k
            kinds[c][v] += 1
            follows[w].add(v)
    all_pairs = sum(map(len, follows.values()))

    def supported(d, t, o):
        return math.copysign(max(abs(d) - toxicity.LEANING - toxicity.DOUBT * math.sqrt(1 / (t + 0.5) + 1 / (o + 0.5)), 0), d)

    def of(v, w):
        def left(c):
            return toxicity.DISCOUNT * kinds[c][v] + toxicity.SHARED
        if not any((v, w) in c for c in counts):
            return supported(math.log(left(1) / (n[1][v] + toxicity.SHARED) * (n[0][v] + toxicity.SHARED) / left(0)), kinds[1][v], kinds[0][v])
        logs = [math.log((max(counts[c][v, w] - toxicity.DISCOUNT, 0) + left(c) * len(follows[w]) / all_pairs) / (n[c][v] + toxicity.SHARED)) for c in (0, 1)]
        return supported(logs[1] - logs[0], counts[1][v, w], counts[0][v, w])

    def difference(text):
        _, before, piece, first = toxicity.word_pieces([text])
        return sum(of(v, w) for v, w in zip(before.tolist(), piece.tolist())) / max(first.sum(), 1)
    return difference


def test_lower_order_counts_the_contexts_of_a_piece(marked):  # noqa: F811
    rows = marked.collect()
    want, model = plain(rows), toxicity.fit_counts(marked)
    texts = [r["text"] for r in rows[:80]] + ["gruwexta bolkafri", "zzzz gruwqqqq", ""]
    assert model.differences(texts) == pytest.approx([want(t) for t in texts], abs=1e-5)


@pytest.mark.parametrize("held", [1 << 26, 0])
def test_pairs_that_share_a_slot_keep_their_values(marked, monkeypatch, held):  # noqa: F811
    """With very few slots, the other rows are sent along or joined; scores are those of the whole table."""
    texts = [r["text"] for r in marked.limit(80).collect()]
    docs, labels = marked.select("doc_id", "text"), marked.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    want, scores = model.differences(texts), {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    monkeypatch.setattr(toxicity, "PAIR_BITS", 2)
    monkeypatch.setattr(toxicity, "CONTEXT_BITS", 1)
    monkeypatch.setattr(toxicity, "BROADCAST_BYTES", held)
    few = toxicity.fit(docs, labels)
    assert (few.table is None) == (held > 0) and len(few.value) == 4
    assert few.differences(texts) == pytest.approx(want, abs=1e-5)
    again = {r["id"]: r["score"] for r in toxicity.score(docs, few).collect()}
    assert again.keys() == scores.keys() and np.allclose([again[i] for i in scores], list(scores.values()), atol=1e-4)


def test_names_have_64_bits():
    texts = [f"{chr(0x4e00 + i % 20000)}{chr(0x4e00 + i // 20000)}" for i in range(400_000)]
    _, _, piece, _ = toxicity.word_pieces([" ".join(texts)])
    assert len(np.unique(piece)) == len(texts)
