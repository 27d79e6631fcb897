"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are hashed in numpy, many texts at a time; the n-grams of a text are a
sparse row of counts, given by the buckets of its positions, and its scores are
the product of that row with the matrix of log-probabilities, which is broadcast.
The matrix has languages x orders x buckets cells, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.tokens import slices

ORDERS = 3
BITS = 16
#: Labelled documents per language that training reads, about; they are chosen by a hash of id and text.
TRAIN_DOCS = 4_000
MOST_LANGUAGES = 64
UNKNOWN = "und"
PAD = ORDERS

_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, starts, ends): for each order a row of the bucket at every position of the joined, padded texts.

    An n-gram starts at its position; padding of spaces keeps texts apart, and
    the positions of text i are starts[i] to ends[i].
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + "".join(t + " " * PAD for t in low)).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.concatenate(([0], np.cumsum(lengths + PAD)))[:-1]
    mixed, cells = np.zeros(len(codes), np.uint32), np.empty((ORDERS, len(codes)), np.int32)
    for n in range(ORDERS):
        # the n-gram from here on: its first n characters mixed, with the next one
        mixed[:len(codes) - n] += codes[n:] * _MULTIPLIERS[n]
        h = mixed ^ (mixed >> np.uint32(15))
        h = h * np.uint32(0x2C1B3C6D)
        cells[n] = (h >> np.uint32(32 - BITS)).astype(np.int32) + (n << BITS)
    # a text begins one character early, at a space, so that its first letters count as a word's first
    return cells, starts, starts + lengths + 1


@dataclass
class LanguageModel:
    """languages, and their log-probabilities: cells[language, order * 2 ** BITS + bucket] and prior[language]."""

    languages: list[str]
    cells: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods with priors, one row per text."""
        where, starts, ends = buckets(texts)
        edges = np.column_stack((starts, ends)).ravel()
        out = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            each = self.cells[k][where[0]]
            for n in range(1, ORDERS):
                each += self.cells[k][where[n]]
            out[:, k] = np.add.reduceat(each, edges, dtype=np.float64)[::2]
        return out + self.prior


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_docs: int = TRAIN_DOCS, smoothing: float = 0.5) -> LanguageModel:
    """Fit on the rows of ``docs`` with a language and a letter; about ``train_docs`` of each language are read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the matrix to broadcast has no bound then")
    languages = [r["lang"] for r in sizes]
    index = {lang: k for k, lang in enumerate(languages)}
    width = ORDERS << BITS
    if not languages:
        return LanguageModel([], np.zeros((0, width), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["n"]))])
    ticket = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.filter(ticket < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), width), np.int64)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                where, starts, ends = buckets(texts[a:b])
                for i in range(a, b):
                    if _LETTER.search(texts[i]):
                        cells = where[:, starts[i - a]:ends[i - a]].ravel()
                        total[index[langs[i]]] += np.bincount(cells, minlength=width) if len(cells) > 5_000 else 0
                        if len(cells) <= 5_000:
                            np.add.at(total[index[langs[i]]], cells, 1)
        k, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[k, cell])],
                                         names=["k", "cell", "n"])

    found = chosen.mapInArrow(count, "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(languages), width), smoothing)
    np.add.at(counts, (found["k"].to_numpy(), found["cell"].to_numpy()), found["n"].to_numpy())
    by_order = counts.reshape(len(languages), ORDERS, 1 << BITS)
    cells = np.log(by_order / by_order.sum(axis=2, keepdims=True)).reshape(len(languages), width).astype(np.float32)
    n = np.array([r["n"] for r in sizes], float)
    return LanguageModel(languages, cells, np.log(n / n.sum()))


def predicted(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    given = [t or "" for t in texts]
    for a, b in slices(given):
        known = [i for i in range(a, b) if model.languages and _LETTER.search(given[i])]
        if known:
            logs = model.scores([given[i] for i in known])
            best = logs.argmax(axis=1)
            posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, p in zip(known, best, posterior):
                lang[i], score[i] = model.languages[k], float(p)
    return lang, score


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang_pred, score) for each row of ``docs``.

    ``score`` is the posterior probability of the predicted language.  A text that
    is null or has no letter, and any text when the model knows no language, is
    ``und`` with score 0.  Ties go to the language first in order.  Whole texts
    are scored; repeated rows get equal results.  An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predicted(sent.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["id", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def accepted_documents(docs: DataFrame, model: LanguageModel, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scored below ``least_score``; all columns as they are.

    The rows pass through the tasks that score them, without a shuffle.
    """
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predicted(sent.value, batch.column(place).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and p >= least_score for x, p in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
