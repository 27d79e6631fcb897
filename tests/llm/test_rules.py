"""Quality rules against plain counts and exact binomial sums."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from lynceus.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, counted one by one."""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


TEXTS = ["", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "\n".join(["same line"] * 3 + ["other", "", " "]),
         "É\x1cö\xa0ß ## **|<>&$%", "\U0001f600 " * 20, "1\x0b2\x0c3\r4"]


def test_counts():
    r = random.Random(4)
    more = [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(60)]
    more += ["\n".join(" ".join(r.choice(["ab", "c|d"]) for _ in range(r.randrange(3))) for _ in range(9)) for _ in range(20)]
    for text in TEXTS + more:
        assert q.counts_of(text)[:5] == plain(text), text
    upper, letters = q.counts_of("ABc Éé× ÿ 1")[7:]
    assert (upper, letters) == (3, 6)


def test_chance_and_bound():
    for n, k, p in [(5, 2, 0.3), (40, 0, 0.01), (200, 7, 0.05)]:
        exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert q.chance(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert q.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01, abs=1e-6)
    assert q.chance(6, 50, q.upper_bound(6, 50, 0.01)) == pytest.approx(0.01, rel=1e-3)
    assert q.upper_bound(3, 3, 0.05) == 1


def test_choose_stops_at_the_first_failure():
    good, bad = np.array([995, 0, 4, 1]), np.array([0, 50, 50, 50])
    # losses by cutoff from loose to tight: 1, 5, 5
    assert q.choose(good, bad, 0.01, 0.05) == (1, 1)
    assert q.choose(good, bad, 0.02, 0.05) == (3, 3)
    assert q.choose(good, np.array([0, 0, 0, 50]), 0.02, 0.05) == (3, 1)  # tighter ones catch no more: the loosest
    assert q.choose(good, np.array([9, 0, 0, 0]), 0.02, 0.05) == (3, 0)
    assert q.choose(np.zeros(4, np.int64), bad, 0.02, 0.05) == (0, 0)


def test_certificates_hold():
    """Over many draws the chosen cutoff rarely has more than the allowed true share of losses."""
    r, wrong = np.random.default_rng(0), 0
    level = np.array([0.97, 0.015, 0.01, 0.005])  # true losses: 0.5 %, 1.5 %, 3 %
    for _ in range(1000):
        good = r.multinomial(500, level)
        wrong += q.choose(good, np.array([0, 100, 100, 100]), 0.02, 0.05)[1] == 3
    assert wrong / 1000 <= 0.05 + 3 * math.sqrt(0.05 * 0.95 / 1000)


def planted(spark, n=1500):
    r = random.Random(1)
    rows, marks = [], []
    for i in range(n):
        text = " ".join(f"word{r.randrange(10 ** 6)}" for _ in range(30))
        bad = i % 5 == 0
        if bad:
            text = text.replace(" ", "### " if i % 2 else "!! ")
        if not bad and i % 331 == 1:
            text += " ####" * 9
        rows.append((i, text, ("en", "fr", "aa", None)[0 if i % 10 < 7 else i % 3 + 1]))
        if i % 12:
            marks.append((i, 0 if bad else 1))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int"), rows, dict(marks))


def test_judge_against_plain_python(spark):
    docs, labels, rows, marks = planted(spark)
    risk, error = 0.2, 0.1
    found = {r["id"]: r for r in q.judge(docs.repartition(5), labels, risk=risk, error=error).collect()}
    share, doubt = risk / len(q.RULES), error / (4 * len(q.RULES))

    def value(text, rule):
        got = dict(zip(q.COUNTS, q.counts_of(text)))
        num, den, _ = q.RULES[rule]
        return 1000 * got[num], got[den]

    usable = [(text, lang, marks[i]) for i, text, lang in rows if i in marks]
    own = {lang for lang in ("en", "fr", "aa") if sum(g for _, x, g in usable if x == lang) >= math.log(doubt) / math.log(1 - share)}
    assert own and own != {"en", "fr", "aa"} or len(own) == 3
    cut = {}
    for stratum, rule in itertools.product([*own, None], q.RULES):
        side = [(value(t, rule), g) for t, x, g in usable if (x if x in own else None) == stratum]
        n, best = sum(g for _, g in side), 0
        for c in q.RULES[rule][2]:
            lost = sum(g for (a, b), g in side if a > c * b)
            if not n or sum(math.comb(n, i) * share ** i * (1 - share) ** (n - i) for i in range(lost + 1)) > doubt:
                break
            gain = sum(1 - 2 * g for (a, b), g in side if a > c * b)
            if gain > best:
                best, cut[stratum, rule] = gain, c
    assert {rule for _, rule in cut} >= {"symbols", "marks"}
    for i, text, lang in rows:
        fails = {rule for rule in q.RULES for a, b in [value(text, rule)] if a > cut.get((lang if lang in own else None, rule), math.inf) * b}
        assert set(found[i]["rejected_by"]) == fails and found[i]["kept"] == (not fails)
    assert sum(not found[i]["kept"] for i, _, _ in rows if i % 5 == 0) == n_bad(rows)


def n_bad(rows):
    return sum(i % 5 == 0 for i, _, _ in rows)


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (99, 1), (None, 1)], "doc_id long, quality int")
    rows = q.judge(awkward, labels, stratum_col="source").collect()
    assert len(rows) == awkward.count()
    assert all(r["base_failed"] and r["rejected_by"] == ["base"] and not r["kept"] for r in rows if r["n_words"] < 20)
    assert all(r["kept"] for r in rows if not r["base_failed"])  # too few labels for any certificate
    assert [tuple(r[c] for c in q.COUNTS[:2]) for r in rows if r["id"] == 5] == [(0, 0)]
    assert q.judge(nothing, labels).count() == 0
    assert q.judge(awkward, labels.limit(0)).count() == awkward.count()


def test_oracle_with_certificates(spark):
    """The SQL on tables where cutoffs are certified."""
    import duckdb

    from lynceus.llm.catalog import ORACLES
    from lynceus.llm import queries_rules  # noqa: F401

    docs, labels, _, _ = planted(spark, 4000)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labels.toArrow())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = sorted(con.sql(ORACLES["op12_risk_controlled_rules"]).select(*names).fetchall())
    found = sorted(tuple(r) for r in q.judge(docs, labels).withColumnRenamed("id", "doc_id").select(*names).collect())
    assert found == expected and 0 < sum(not r[-1] for r in found) < len(found)
