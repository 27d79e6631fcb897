"""Toxicity by class-conditional Kneser-Ney models of how words are built.

Words are cut into pieces of up to four characters; a piece follows the piece
before it in its word, or the start of the word.  Each class has its own counts of
pairs, absolutely discounted; the mass that this frees goes, as in Kneser and
Ney, by the number of different contexts that a piece follows, counted over both
classes, and contexts with few counts lean on it further.  Every pair has a value
of its own, however rare; differences that the counts leave in
doubt are drawn towards none, so that ordinary words of any language add nothing.  A text's score is the mean, per word, of the
difference of its log-likelihoods, mapped to a probability on labelled
documents that the counts have not seen.

All labelled documents are counted, in Spark; pieces and pairs are named by 64 bits.  What counts
is one table of additive values, a row for each context (any continuation) and pair (what it adds to its
context) other than zero.  Tasks receive the most frequent row of each of a fixed number of slots, and the other rows
too if they are small; if not, scoring joins the distinct ones of each document to the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name
from lynceus.llm.tokens import slices
from lynceus.session import BROADCAST_BYTES, durable, held_bytes, sized

PIECE = 4
#: Slots of what every task receives, for contexts and for pairs.
CONTEXT_BITS, PAIR_BITS = 16, 20
DISCOUNT = 0.75
#: The weight of the lower order beside what discounting frees, in counts.
SHARED = 10.0
#: A difference is drawn towards none by so many standard errors, and by so much that a class may differ in languages and topics.
DOUBT, LEANING = 2.5, 1.0
#: Labelled documents in this share set the scale of scores; the others are counted.
SCALE_SHARE = 0.2
SLICE = 1_000_000
#: Distinct pairs that a task holds before it hands them on.
HELD = 2_000_000

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ALNUM = np.array([chr(i).isalnum() for i in range(0xD800)] + [False] * 0x800 + [chr(i).isalnum() for i in range(0xE000, 0x10000)] + [True])


def word_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, piece before, piece, is first of a word) of all pieces, named by 64 bits; 0 stands for the start of a word."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + "".join(t + " " * PIECE for t in low)).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate(([1], 1 + np.cumsum([len(t) + PIECE for t in low])))[:-1]
    inside = _ALNUM[np.minimum(codes, 0x10000)]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    place = np.arange(len(codes), dtype=np.int32)
    at = np.flatnonzero(inside & ((place - np.maximum.accumulate(np.where(begin, place, 0))) % PIECE == 0))
    first, still = begin[at], np.ones(len(at), bool)
    h = np.where(first, np.uint64(1), np.uint64(2))
    for j in range(PIECE):
        still = still & inside[at + j]
        h = h * _SPREAD + np.where(still, codes[at + j], 0).astype(np.uint64)
        h ^= h >> np.uint64(31)
    piece = (h * _SPREAD).view(np.int64)
    piece[piece == 0] = 1
    before = np.where(first, 0, np.concatenate(([0], piece[:-1])) if len(piece) else piece)
    return np.searchsorted(starts, at, side="right") - 1, before, piece, first


def pair_keys(before: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The names of pairs; piece 0 stands for any continuation."""
    h = before.astype(np.int64).view(np.uint64) * _SPREAD
    h = ((h ^ (h >> np.uint64(32))) + piece.astype(np.int64).view(np.uint64)) * _SPREAD
    h = (h ^ (h >> np.uint64(29))) * _SPREAD
    return np.maximum(h ^ (h >> np.uint64(32)), np.uint64(1))


def pair_slots(before: np.ndarray, piece: np.ndarray, bits: int = PAIR_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slot and name of a pair; name 0 marks an empty slot."""
    keys = pair_keys(before, piece)
    return (keys >> np.uint64(64 - bits)).astype(np.int64), keys


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns (key, before, piece, toxic, ordinary) with each key once, counts added."""
    key, before, piece, toxic, ordinary = (np.concatenate(c) for c in zip(*held))
    key, first, where = np.unique(key, return_index=True, return_inverse=True)
    return [key, before[first], piece[first], *(np.bincount(where, n, len(key)).astype(np.int64) for n in (toxic, ordinary))]


def count_pairs(labelled: DataFrame) -> DataFrame:
    """(before, piece, toxic, ordinary): pair counts of the rows (text, toxic)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _merged(held)[1:]], names=["before", "piece", "toxic", "ordinary"])

        for batch in batches:
            texts, label = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(texts, SLICE):
                text, before, piece, _ = word_pieces(texts[a:b])
                toxic = (label[a:b][text] == 1).astype(np.int64)
                held.append(_merged([[pair_keys(before, piece), before, piece, toxic, 1 - toxic]]))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield out()
                        held = []
        if held:
            yield out()

    return (labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
            .mapInArrow(count, "before long, piece long, toxic long, ordinary long")
            .groupBy("before", "piece").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))


def _empty(kind: type) -> np.ndarray:
    return np.zeros(0, kind)


@dataclass
class ToxicModel:
    """Additive differences of log-likelihoods, of contexts and of pairs, where ``check`` holds their name; and the scale.

    Rows whose slot holds another one are in ``more_keys`` (sorted) and ``more``, or, where these are many, in ``table`` (key, value).
    """

    context: np.ndarray
    context_check: np.ndarray
    value: np.ndarray
    check: np.ndarray
    more_keys: np.ndarray = field(default_factory=lambda: _empty(np.uint64))
    more: np.ndarray = field(default_factory=lambda: _empty(np.float64))
    slope: float = 1.0
    offset: float = 0.0
    table: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text the sum of what tasks hold and the number of words; (text, key) of what only ``table`` could tell."""
        text, before, piece, first = word_pieces(texts)
        total, left = np.zeros(len(texts)), []
        for value, check, after in ((self.context, self.context_check, np.zeros_like(piece)), (self.value, self.check, piece)):
            slot, keys = pair_slots(before, after, len(value).bit_length() - 1)
            there = check[slot]
            total += np.bincount(text, np.where(there == keys, value[slot], 0), len(texts))
            other = np.flatnonzero((there != keys) & (there != 0))
            left.append((text[other], keys[other]))
        text_left, keys = (np.concatenate(c) for c in zip(*left))
        if len(self.more_keys):
            place = np.minimum(np.searchsorted(self.more_keys, keys), len(self.more_keys) - 1)
            total += np.bincount(text_left, np.where(self.more_keys[place] == keys, self.more[place], 0), len(texts))
        return total, np.bincount(text, first, len(texts)).astype(float), text_left, keys

    def differences(self, texts: list[str]) -> np.ndarray:
        """Per text the mean difference per word, 0 without words."""
        out = np.zeros(len(texts))
        for a, b in slices(texts, SLICE):
            total, words, text, keys = self._looked_up(texts[a:b])
            if self.table is not None and len(keys):
                wanted = self.table.sparkSession.createDataFrame([(k,) for k in np.unique(keys).view(np.int64).tolist()], "key long")
                found = dict(map(tuple, self.table.join(wanted, "key").select("key", "value").collect()))
                total += np.bincount(text, [found.get(k, 0.0) for k in keys.view(np.int64).tolist()], b - a)
            out[a:b] = total / np.maximum(words, 1)
        return out


def _log_share(n: Column, total: str, kinds: str) -> Column:
    """Log-probability of an event with ``n`` counts in a class whose context has ``total`` counts of ``kinds`` pairs.

    What discounting frees, and ``SHARED`` counts more, go by ``share``, the part of all different pairs, of both classes, that end in the piece.
    """
    return F.log((F.greatest(n - DISCOUNT, F.lit(0.0)) + (DISCOUNT * F.col(kinds) + SHARED) * F.col("share")) / (F.col(total) + SHARED))


def _supported(difference: Column, toxic: str, ordinary: str) -> Column:
    """Differences of log-likelihoods, less what the counts leave in doubt or the make-up of the classes explains."""
    error = F.sqrt(1 / (F.col(toxic) + 0.5) + 1 / (F.col(ordinary) + 0.5))
    return F.signum(difference) * F.greatest(F.abs(difference) - LEANING - DOUBT * error, F.lit(0.0))


def _values(pairs: DataFrame) -> DataFrame:
    """(before, piece, value, n): what differs from zero, of contexts (piece 0) and of pairs beyond their context."""
    contexts = sized(pairs.groupBy("before").agg(
        F.sum("toxic").alias("n_toxic"), F.sum("ordinary").alias("n_ordinary"),
        F.sum((F.col("toxic") > 0).cast("long")).alias("k_toxic"), F.sum((F.col("ordinary") > 0).cast("long")).alias("k_ordinary"))
        .withColumn("unseen", _supported(
            F.log((DISCOUNT * F.col("k_toxic") + SHARED) / (F.col("n_toxic") + SHARED) / (DISCOUNT * F.col("k_ordinary") + SHARED)
                  * (F.col("n_ordinary") + SHARED)), "k_toxic", "k_ordinary")))
    # how many different contexts a piece follows, in both classes together
    follows = sized(pairs.groupBy("piece").agg((F.count(F.lit(1)) / F.lit(max(pairs.count(), 1))).alias("share")))
    logs = [_log_share(F.col(c), f"n_{c}", f"k_{c}") for c in ("toxic", "ordinary")]
    each = (pairs.join(contexts, "before").join(follows, "piece")
            .select("before", "piece", (_supported(logs[0] - logs[1], "toxic", "ordinary") - F.col("unseen")).alias("value"),
                    (F.col("toxic") + F.col("ordinary")).alias("n")))
    any_piece = contexts.select("before", F.lit(0).cast("long").alias("piece"), F.col("unseen").alias("value"),
                                (F.col("n_toxic") + F.col("n_ordinary")).alias("n"))
    return each.unionByName(any_piece).filter("value <> 0")


def fit_counts(labelled: DataFrame) -> ToxicModel:
    """The model without its scale, from the rows (text, toxic)."""
    context_bits, pair_bits = CONTEXT_BITS, PAIR_BITS

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, piece = batch.column("before").to_numpy(), batch.column("piece").to_numpy()
            keys = pair_keys(before, piece)
            bits = np.where(piece == 0, context_bits, pair_bits).astype(np.uint64)
            slot = (keys >> (np.uint64(64) - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.where(piece == 0, -1 - slot, slot)),
                                              batch.column("value"), batch.column("n")], names=["key", "slot", "value", "n"])

    values = durable(_values(durable(count_pairs(labelled))).mapInArrow(name, "key long, slot long, value double, n long"))
    best = durable(values.groupBy("slot").agg(F.max(F.struct("n", "key", "value")).alias("best"))
                   .select("slot", F.col("best.key").alias("held"), F.col("best.value").alias("value")))
    tables = []
    held = best.toArrow()
    slots, keys, found = (held[c].to_numpy() for c in ("slot", "held", "value"))
    for bits, mine, places in ((context_bits, slots < 0, -1 - slots), (pair_bits, slots >= 0, slots)):
        value, check = np.zeros(1 << bits), np.zeros(1 << bits, np.uint64)
        value[places[mine]], check[places[mine]] = found[mine], keys[mine].view(np.uint64)
        tables += [value, check]
    model = ToxicModel(*tables)
    if values.count() > len(keys):
        more = durable(values.join(best.select("slot", "held"), "slot").filter("key <> held").select("key", "value"))
        if held_bytes(more) <= BROADCAST_BYTES:
            rows = more.toArrow()
            names = rows["key"].to_numpy().view(np.uint64)
            order = np.argsort(names)
            model.more_keys, model.more = names[order], rows["value"].to_numpy()[order]
        else:
            model.table = more
    return model


def _rated(rows: DataFrame, model: ToxicModel, at: str) -> DataFrame:
    """``rows`` (text and others) with ``difference`` in place of text; ``at`` names a column that tells the rows apart."""
    sent, large = rows.sparkSession.sparkContext.broadcast(model), model.table is not None
    others = [f for f in rows.schema.fields if f.name != "text"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts, SLICE):
                total, words, _, _ = sent.value._looked_up(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in others), pa.array(total), pa.array(np.maximum(words, 1))],
                                                 names=[*(f.name for f in others), "total", "words"])

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = [t or "" for t in batch.column("text").to_pylist()], batch.column(at)
            for a, b in slices(texts, SLICE):
                _, _, text, keys = sent.value._looked_up(texts[a:b])
                pairs, times = np.unique(np.column_stack((text.astype(np.uint64), keys)), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([rest.take(pa.array(pairs[:, 0].astype(np.int64) + a)), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)),
                                                  pa.array(times)], names=[at, "key", "times"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    out = rows.mapInArrow(rate, f"{kinds}, total double, words double")
    if large:
        of = next(f for f in others if f.name == at)
        more = (rows.mapInArrow(missed, f"`{at}` {of.dataType.simpleString()}, key long, times long").join(model.table, "key")
                .groupBy(at).agg(F.sum(F.col("times") * F.col("value")).alias("more")))
        out = out.join(more, at, "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return out.select(*(f.name for f in others), (F.col("total") / F.col("words")).alias("difference"))


def _scaled(model: ToxicModel, held: DataFrame, bins: int = 4_000, reach: float = 4.0) -> ToxicModel:
    """Fit slope and offset on (text, toxic) rows, by a histogram of their differences."""
    held = held.select("text", F.col("toxic").cast("int").alias("toxic"))
    if model.table is not None:
        held = durable(held.withColumn("row_at", F.monotonically_increasing_id()))
    cell = F.least(F.greatest((F.col("difference") + reach + 1e-9) / (2 * reach) * bins, F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = (_rated(held, model, "row_at").select(cell.alias("cell"), "toxic")
            .groupBy("cell").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).toArrow())
    x = (rows["cell"].to_numpy() + 0.5) / bins * 2 * reach - reach
    t, n = rows["t"].to_numpy().astype(float), rows["n"].to_numpy().astype(float)
    mean, spread = (np.average(x, weights=n), 1.0) if len(x) else (0.0, 1.0)
    if len(x) > 1:
        spread = max(np.sqrt(np.average((x - mean) ** 2, weights=n)), 1e-6)
    design, w = np.column_stack(((x - mean) / spread, np.ones(len(x)))), np.zeros(2)
    ridge = np.diag([1e-2, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (t - n * p) - ridge @ w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, grad)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(w[0] / spread), float(w[1] - w[0] * mean / spread)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Fit on the rows of ``docs`` that ``labels`` marks 0 or 1; null labels are left out, repeated ones count again."""
    marks = sized(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
                  .filter("id IS NOT NULL AND toxic IS NOT NULL"))
    labelled = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id")
                .withColumn("for_scale", F.pmod(F.xxhash64("id"), F.lit(1000)) < int(1000 * SCALE_SHARE)))
    model = fit_counts(labelled.filter(~F.col("for_scale")))
    return _scaled(model, labelled.filter("for_scale"))


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score, predicted) for each row of ``docs``.

    ``score`` estimates the probability of a toxic label; ``predicted`` is 1 from
    0.5 on.  A text that is null, or has no letter or digit, gets the score of
    a text without evidence.  Whole texts are scored; repeated rows get equal
    results.  An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    if model.table is None:
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    else:
        at = free_name(docs, "row_at")
        rows = addressed(docs, at).select(F.col(at).alias("row_at"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    x = F.greatest(F.least(model.slope * F.col("difference") + model.offset, F.lit(500.0)), F.lit(-500.0))
    return (_rated(rows, model, "row_at").select("id", (1 / (1 + F.exp(-x))).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
