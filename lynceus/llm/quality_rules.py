"""Quality rules whose cutoffs are certified on labelled documents.

Each rule is a share that low quality raises (symbols among characters, capitals
among letters, and so on) and a fixed row of cutoffs from loose to tight.  In
each stratum (a language, say) the labelled documents of good quality are the
holdout: a cutoff is certified when an exact binomial test rejects that it turns
away more than its part of the allowed share of good documents.  The tests of a rule go from
loose to tight and stop at the first failure, so they need no correction among themselves;
over strata and rules the error is divided (Bonferroni).  So with probability 1 - ``error``,
in every stratum all rules together reject at most ``risk`` of the good documents that pass the
base rules.  Among certified cutoffs the one with the most labelled low quality
in excess of labelled good quality is used, of equally good ones the loosest.

Strata with too few good documents for any certificate are pooled.  Counting is one
pass over the texts; what reaches the driver is one count for each stratum,
label, rule and cutoff.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name
from lynceus.session import durable, sized

#: Rule: (numerator, denominator, cutoffs in thousandths from loose to tight); fixed values.
RULES = {
    "symbols": ("n_symbols", "word_chars", (300, 200, 150, 100, 75, 50, 40, 30, 20, 10)),
    "marks": ("n_marks", "word_chars", (300, 200, 150, 100, 75, 50, 40, 30)),
    "capitals": ("n_upper", "n_letters", (800, 700, 600, 500, 450, 400, 350, 300, 250)),
    "repeated_lines": ("n_dup_lines", "n_lines", (800, 700, 600, 500, 400, 300, 200)),
    "repeated_words": ("n_repeat_words", "n_words", (250, 200, 150, 100, 75, 50)),
    "long_words": ("word_chars", "n_words", (20000, 16000, 14000, 12000, 11000)),
}
RISK, ERROR = 0.05, 0.05
#: Strata with cutoffs of their own, at most: those with the most good documents; all others are pooled.
STRATA = 64
#: The base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters")

_LATIN = np.arange(256)
SPACE = np.isin(_LATIN, [32, *range(9, 14)])
SYMBOL = np.isin(_LATIN, [ord(c) for c in "#*$%&|<>"])
MARK = np.isin(_LATIN, [ord(c) for c in "!?"])
UPPER = ((_LATIN >= 65) & (_LATIN <= 90)) | ((_LATIN >= 192) & (_LATIN <= 222) & (_LATIN != 215))
LOWER = ((_LATIN >= 97) & (_LATIN <= 122)) | ((_LATIN >= 223) & (_LATIN != 247))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that come twice or more; the first ones count too.

    Windows are named exactly: words by number, then pairs of names, two, four, ... words long.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    names = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    step = 1
    while step < window:
        pairs = names[:-step] * (len(words) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    found = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:len(found)] += found
    edges[window:window + len(found)] -= found
    return int((np.cumsum(edges) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; capitals and letters are those of Latin-1."""
    if not text:
        return (0,) * len(COUNTS)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    seen = np.bincount(codes[codes < 256], minlength=256)
    words = text.encode("utf-8", "replace").split()
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    upper = int(seen[UPPER].sum())
    return (len(words), len(text) - int(seen[SPACE].sum()), int(seen[SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), int(seen[MARK].sum()), upper, upper + int(seen[LOWER].sum()))


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Rows (row_at, id, stratum, COUNTS..., base_failed), one for each document; a null text has no words."""
    at = free_name(docs, "row_at")
    rows = addressed(docs, at).select(F.col(at).alias("row_at"), F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
                                      F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts_of(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(batch.columns[:3] + [pa.array(c) for c in found.T], names=["row_at", "id", "stratum", *COUNTS])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(measure, f"row_at struct<file:long,row:long>, id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def above(rule: str, cutoff: Column | int) -> Column:
    """Whether a document's share is above the cutoff, in whole numbers."""
    numerator, denominator, _ = RULES[rule]
    return 1000 * F.col(numerator) > cutoff * F.col(denominator)


def chance(k: int, n: int, p: float) -> float:
    """The probability of at most k successes in n trials."""
    i = np.arange(k + 1)
    factorials = np.array([math.lgamma(v) for v in range(1, k + 2)])
    left = np.array([math.lgamma(n - v + 1) for v in range(k + 1)])
    return float(np.exp(math.lgamma(n + 1) - factorials - left + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a share seen k times in n."""
    low, high = k / n if n else 0.0, 1.0
    while n > k and high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if chance(k, n, mid) > error else (low, mid)
    return high


def choose(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> tuple[int, int]:
    """Of documents by the number of cutoffs they are above: (cutoffs certified, place of the chosen one from 1, 0 for none)."""
    # a document above the loosest cutoff is above all
    lost, caught = good[:0:-1].cumsum(), bad[:0:-1].cumsum()
    n, certified = int(good.sum()), 0
    for k in lost.tolist():
        # more losses than the risk allows on average can't be certified: no need to add up their chances
        if n == 0 or k > risk * n or chance(k, n, risk) > error:
            break
        certified += 1
    gain = (caught - lost)[:certified]
    return certified, int(gain.argmax()) + 1 if certified and gain.max() > 0 else 0


def fit(counted: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", risk: float = RISK,
        error: float = ERROR) -> dict[str | None, dict[str, dict]]:
    """For each stratum and, under None, for all others: the cutoff of each rule, with its evidence.

    An id with several labels counts as good only if all say so (1); null labels say nothing.  The rules divide
    ``risk`` among them, strata and rules divide ``error``.
    """
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg(F.min(label_col).alias("good"))
    levels = [sum((above(rule, c).cast("int") for c in cuts), F.lit(0)).alias(rule) for rule, (_, _, cuts) in RULES.items()]
    marks = sized(marks)
    seen = durable(counted.filter(~F.col("base_failed")).join(marks, counted["id"] == marks["label_id"])
                   .select("stratum", (F.col("good") == 1).alias("good"), *levels))
    sizes = seen.filter("stratum is not null").groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n"))
    top = sizes.orderBy(F.desc("n"), "stratum").limit(STRATA + 1).collect()
    parts = min(len(top), STRATA) + 1
    share, doubt = risk / len(RULES), error / (parts * len(RULES))
    least = math.log(doubt) / math.log1p(-share)
    own = [r.stratum for r in top[:STRATA] if r.n >= least]
    named = F.when(F.col("stratum").isin(own), F.col("stratum")) if own else F.lit(None).cast("string")
    pairs = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("level")) for rule in RULES)))
    found = (seen.groupBy(named.alias("stratum"), "good", *RULES).agg(F.count(F.lit(1)).alias("n")).select("stratum", "good", "n", pairs.alias("c"))
             .groupBy("stratum", "good", "c.rule", "c.level").agg(F.sum("n").alias("n")).collect())
    model: dict = {}
    for stratum in [*own, None]:
        model[stratum] = {}
        for rule, (_, _, cuts) in RULES.items():
            sides = {True: np.zeros(len(cuts) + 1, np.int64), False: np.zeros(len(cuts) + 1, np.int64)}
            for r in found:
                if r.stratum == stratum and r.rule == rule:
                    sides[r.good][r.level] += r.n
            certified, at = choose(sides[True], sides[False], share, doubt)
            n, lost, caught = int(sides[True].sum()), *(int(sides[good][len(cuts) + 1 - at:].sum()) for good in (True, False))
            model[stratum][rule] = {"cutoff": cuts[at - 1] if at else None, "certified": certified, "n_good": n, "n_lost": lost,
                                    "n_caught": caught, "bound": upper_bound(lost, n, doubt) if at else None}
    return model


def apply(counted: DataFrame, model: dict[str | None, dict[str, dict]]) -> DataFrame:
    """``counted`` with (rejected_by, kept): the rules a document fails, base rules first, and whether it fails none."""
    own = [s for s in model if s is not None]

    def cutoff(rule: str) -> Column:
        other = F.lit(model[None][rule]["cutoff"]).cast("long")
        known = {s: model[s][rule]["cutoff"] for s in own}
        chosen = other
        for s, c in known.items():
            chosen = F.when(F.col("stratum") == s, F.lit(c).cast("long")).otherwise(chosen)
        return chosen

    failed = [F.when(F.col("base_failed"), F.lit("base")),
              *(F.when(F.coalesce(above(rule, cutoff(rule)), F.lit(False)), F.lit(rule)) for rule in RULES)]
    return counted.withColumn("rejected_by", F.array_compact(F.array(*failed))).withColumn("kept", F.size("rejected_by") == 0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          label_id: str = "doc_id", label_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row (row_at, id, stratum, counts, base_failed, rejected_by, kept) for each document.

    A null or empty text has no words and fails the base rules.  A null stratum belongs to the pooled
    ones.  Repeated rows are judged each for itself; labels of ids that no document has are not used.  Without labels
    no cutoff is certified and only the base rules reject.  An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    counted = durable(count(docs, id_col, text_col, stratum_col))
    return apply(counted, fit(counted, labels, label_id, label_col, risk, error))
