import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.llm import language_id, toxicity
from lynceus.llm.queries_models import fold


def test_language_of_held_out_documents(documents):
    model = language_id.fit(documents.filter(fold(3) != 1))
    rows = language_id.identify(documents.filter(fold(3) == 1), model).collect()
    true = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert len(rows) > 40 and sum(r["lang_pred"] == true[r["id"]] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores_are_those_of_plain_counting(documents):
    """The same model by dictionaries over the buckets of each text."""
    docs = documents.filter("doc_id < 40")
    model = language_id.fit(docs)
    counts, n = defaultdict(Counter), Counter()
    for r in docs.collect():
        cells, starts, ends = language_id.buckets([r["text"]])
        counts[r["lang"]].update(cells[:, starts[0]:ends[0]].ravel().tolist())
        n[r["lang"]] += 1
    text = docs.first()["text"]
    cells, starts, ends = language_id.buckets([text])
    for k, lang in enumerate(model.languages):
        total = [sum(v for c, v in counts[lang].items() if c >> language_id.BITS == o) + 0.5 * 2**language_id.BITS for o in range(3)]
        want = math.log(n[lang] / sum(n.values())) + sum(
            math.log((counts[lang][c] + 0.5) / total[c >> language_id.BITS]) for c in cells[:, starts[0]:ends[0]].ravel().tolist())
        assert model.scores([text])[0, k] == pytest.approx(want, rel=1e-4)


def test_texts_do_not_touch_each_other():
    texts = ["abc", "", "x" * 50, "été", "the end"]
    alone = [language_id.buckets([t]) for t in texts]
    cells, starts, ends = language_id.buckets(texts)
    for i, (c, s, e) in enumerate(alone):
        assert (cells[:, starts[i]:ends[i]] == c[:, s[0]:e[0]]).all()


def test_awkward_languages(awkward, nothing):
    model = language_id.fit(awkward)
    rows = language_id.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    text = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    without = sum(not any(c.isalpha() for c in t or "") for _, t in text)
    assert sum(r["lang_pred"] == "und" for r in rows) == without and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    kept = language_id.accepted_documents(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r["lang_pred"] != "und" and r["score"] >= 0.5 for r in rows)
    unknown = language_id.fit(nothing)
    assert {r["lang_pred"] for r in language_id.identify(awkward, unknown).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_too_many_languages(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        language_id.fit(rows)


@pytest.fixture(scope="module")
def marked(spark):
    """Documents of invented words; every fourth one holds an insult or two, with varied endings."""
    r, rows = random.Random(3), []
    syllables = "ta ri mo se la ku ne vo di pa".split()
    for i in range(600):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(20, 120))]
        if i % 4 == 0:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["gruwex", "bolkaf"]) + r.choice(syllables))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxic_documents_are_told_apart(marked):
    docs, labels = marked.select("doc_id", "text"), marked.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(fold(5) != 0))
    rows = {r["id"]: r for r in toxicity.score(docs.filter(fold(5) == 0), model).collect()}
    true = {r["doc_id"]: r["toxic"] for r in labels.filter(fold(5) == 0).collect()}
    assert sum(rows[i]["predicted"] == t for i, t in true.items()) >= 0.95 * len(true)
    worst = min(rows[i]["score"] for i, t in true.items() if t)
    assert np.mean([rows[i]["score"] < worst for i, t in true.items() if not t]) > 0.9


def test_pair_counts(marked):
    """Counts by Spark against counting one text at a time."""
    docs, want = marked.limit(60), Counter()
    for r in docs.collect():
        _, before, piece, _ = toxicity.word_pieces([r["text"]])
        want.update((v, w, r["toxic"]) for v, w in zip(before.tolist(), piece.tolist()))
    found = Counter()
    for r in toxicity.count_pairs(docs).collect():
        found[r["before"], r["piece"], 1] += r["toxic"]
        found[r["before"], r["piece"], 0] += r["ordinary"]
    assert +found == want


def test_insults_stand_out(marked):
    """Words of toxic documents only score high; common or unseen words, and texts without words, count for neither class."""
    model = toxicity.fit_counts(marked)
    slot, check = toxicity.pair_slots(np.array([1]), np.array([2]))
    assert model.check[slot[0]] != check[0] or np.isfinite(model.value[slot[0]])
    assert np.isfinite(model.context).all() and np.isfinite(model.value).all()
    _, before, piece, first = toxicity.word_pieces(["gruwexta morise"])
    assert first.tolist() == [True, False, True, False] and before[0] == before[2] == 0
    strong, plain = model.differences(["gruwexta bolkafri", "tarimo sela kune"])
    assert strong > 1 > 10 * abs(plain) and model.differences(["", "!?", None or ""]).tolist() == [0, 0, 0]


def test_awkward_toxicity(awkward, nothing, spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 1), (9, None), (7, 0), (8, 0), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["id"] in (4, 5, 6)}) == 1
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(nothing, labels).differences(["a b"]).tolist() == [0]
