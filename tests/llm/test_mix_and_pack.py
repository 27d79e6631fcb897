import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lynceus.llm import mixing, packing, token_counts
from lynceus.llm.tokens import pieces

BYTES, RANKS, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def want_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(documents, awkward, nothing):
    for docs in (documents, awkward):
        rows, source = mixing.mix(docs).collect(), defaultdict(int)
        for r in docs.collect():
            source[r["source"]] += words(r["text"])
        want = want_targets(source)
        assert Counter((r["id"], r["size"]) for r in rows) == Counter((r["doc_id"], words(r["text"])) for r in docs.collect())
        taken, longest = defaultdict(int), defaultdict(int)
        for r in rows:
            assert r["source_size"] == source[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"]
            taken[r["source"]] += r["taken"]
            longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert all(abs(taken[s] - want[s]) <= longest[s] for s in source)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


def test_mix_does_not_depend_on_storage_or_blocks(documents):
    first = {tuple(r)[1:] for r in mixing.mix(documents).drop("row_at").collect()}
    assert first == {tuple(r)[1:] for r in mixing.mix(documents.repartition(4)).drop("row_at").collect()}
    for r in mixing.mix(documents, block=8).groupBy("source", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r["target"]) < 2500


def test_mixed_documents(awkward):
    often = Counter()
    for r in mixing.mix(awkward, seed=1).collect():
        often[r["id"]] += r["repeats"]
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns and Counter(r["doc_id"] for r in out.collect()) == +often


def test_flight_keeps_totals_and_probabilities():
    import random
    sizes = [random.Random(1).randrange(1, 500) for _ in range(60)]
    start, mean = [0.3 + 0.4 * (i % 2) for i in range(60)], np.zeros(60)
    for seed in range(400):
        prob = list(start)
        inside = mixing.flight(prob, sizes, random.Random(seed))
        assert len(inside) <= 2 and sum(prob) == pytest.approx(sum(start))
        assert sum(p * s for p, s in zip(prob, sizes)) == pytest.approx(sum(p * s for p, s in zip(start, sizes)))
        mean += np.array(prob) / 400
    assert np.abs(mean - start).max() < 0.15


def check_packing(docs, **options):
    whole = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in docs.collect():
        ids = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        stop, start, piece = (len(ids) - 1) % 1024 + 1, 0, 0
        while start < len(ids):
            want[r["doc_id"], piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start, stop, piece = stop, stop + 1024, piece + 1
    cut = packing.cut_documents(docs, BYTES, 1024, 2, ranks_path=RANKS)
    rows = packing.pack(cut, 1024, **options).collect()
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values(), default=0) <= 1024
    return len(filled), -(-sum(filled.values()) // 1024)


def test_packing(documents, awkward, nothing):
    used, least = check_packing(documents)
    assert used <= 1.04 * least
    check_packing(awkward)
    assert check_packing(nothing)[0] == 0


def test_packing_over_levels(documents):
    used, least = check_packing(documents, open_bins=8, per_packer=40)
    assert used <= 1.2 * least


def test_pieces_and_ids():
    whole, ids = Tokenizer.from_file(BYTES), packing.id_bytes(BYTES, RANKS)
    for text in ("", " ", "a", " a  b\n\n c ", "a\xa0  b", "\x1c  x", "I'm  <|endoftext|> it's<|endoftext|>", "é ß  中文 \t x", "x \n y\r\n  z  "):
        assert "".join(pieces(text)) == text
        assert b"".join(map(ids, pieces(text))) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_token_counts(documents, awkward, nothing):
    whole = Tokenizer.from_file(WORDS)
    for docs in (documents, awkward):
        want = Counter()
        for r in docs.collect():
            n = len(whole.encode(r["text"] or "", add_special_tokens=False).ids)
            want[r["doc_id"], len((r["text"] or "").encode()), n, n > 2048] += 1
        assert Counter(tuple(r)[1:] for r in token_counts.count_tokens(docs, WORDS).collect()) == want
    table = token_counts.frequent_table(documents, WORDS, entries=50)
    assert len(table.value[1]) <= 50
    assert token_counts.count_tokens(nothing, WORDS).count() == 0


def test_frequent_pieces_are_the_frequent_ones(documents):
    true = Counter(x for r in documents.collect() for x in r["text"].split(" "))
    top = [r["piece"] for r in token_counts.frequent_pieces(documents, "text", 64).orderBy("n", ascending=False).limit(10).collect()]
    assert set(top) == {x for x, _ in true.most_common(10)}


def naive_best_fit(lengths, capacity, open_bins):
    """Search all open sequences for the tightest (of equally tight ones the last touched); the fullest closes when there are too many."""
    bins, out = [], []  # [free, touched, name]
    made = 0
    for at, need in enumerate(lengths):
        fits = [b for b in bins if b[0] >= need]
        if fits:
            chosen = min(fits, key=lambda b: (b[0], -b[1]))
            bins.remove(chosen)
        else:
            if len(bins) == open_bins:
                bins.remove(min(bins, key=lambda b: (b[0], -b[1])))
            chosen, made = [capacity, 0, made], made + 1
        out.append((chosen[2], capacity - chosen[0]))
        if chosen[0] > need:
            bins.append([chosen[0] - need, at, chosen[2]])
    return out


@pytest.mark.parametrize("capacity,open_bins,n", [(10, 3, 200), (64, 1, 100), (1024, 50, 700), (7, 100, 60)])
def test_best_fit_against_a_naive_search(capacity, open_bins, n):
    r = np.random.default_rng(capacity + n)
    lengths = np.minimum(capacity, r.geometric(3 / capacity, n)).tolist()
    assert list(zip(*packing.best_fit(lengths, capacity, open_bins, 4, True))) == naive_best_fit(lengths, capacity, open_bins)
    where, offset = packing.best_fit(lengths, capacity, open_bins, 4, False)
    assert all(w in (-1, x) and o == y for w, o, (x, y) in zip(where, offset, naive_best_fit(lengths, capacity, open_bins)))
