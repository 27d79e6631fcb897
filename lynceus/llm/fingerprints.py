"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, level by level.  Runs of one symbol become one
symbol.  Deterministic coin tossing then gives every symbol a small label that
depends on its few left neighbours only, neighbours getting different labels;
a phrase begins at each label that exceeds both neighbours, and is named by a
hash of its symbols.  Phrases are the next level's symbols.  Boundaries depend on
near symbols only, so equal passages get equal phrases inside, wherever they
stand.  The fingerprint is a bottom-k sketch of the phrase names from the third level up.
A text with too few of those takes the names of the first two levels too, and one of a
word or a few, with still too few, those of its pairs of neighbouring characters.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name, number_rows
from lynceus.llm.tokens import slices

#: Names in a fingerprint, the first level that every text takes names from, and levels in all.
SKETCH, BELOW, LEVELS = 64, 3, 12
#: A text with fewer names than this from all levels takes those of its character pairs.
FEW = 16
SLICE = 1_000_000
#: Rows of a block at least, and blocks at most: a bound on what the driver holds of the order.
BLOCK_ROWS, MOST_BLOCKS = 2_048, 20_000

_FINISH, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOW_BIT = np.array([0, *[(i & -i).bit_length() - 1 for i in range(1, 256)]], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FINISH
    return x ^ (x >> np.uint64(29))


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: labels below 6 for symbols that differ from their left neighbours."""
    d = x.copy()
    d[1:] ^= x[:-1]
    d[first] = x[first] | np.uint64(1)
    bit = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1))
    label = (bit << np.uint8(1)) | ((x >> bit) & np.uint64(1)).astype(np.uint8)
    for _ in range(3):
        e = label.copy()
        e[1:] ^= label[:-1]
        e[first] = label[first] | np.uint8(1)
        bit = _LOW_BIT[e]
        label = (bit << np.uint8(1)) | ((label >> bit) & np.uint8(1))
    return label


def _parsed(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: phrase names, and the places of each text's first phrase."""
    n = len(x)
    starts = np.zeros(n, bool)
    starts[first] = True
    new = starts.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    if len(at) < n:
        length = np.diff(at, append=n)
        x, starts = x[at], starts[at]
        runs = length > 1
        x[runs] = _mix(x[runs] + length[runs].astype(np.uint64) * _SPREAD)
        first, n = np.flatnonzero(starts), len(x)
    label = _labels(x, first)
    top = starts
    top[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~starts[2:]
    at = np.flatnonzero(top)
    size = np.diff(at, append=n)
    place = np.arange(n) - np.repeat(at, size)
    names = _mix(np.add.reduceat(x * _PLACES[place & 63], at) + size.astype(np.uint64))
    return names, np.searchsorted(at, first)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text as a sorted array of at most SKETCH 32-bit names; empty for an empty text."""
    full = [i for i, t in enumerate(texts) if t]
    out = [np.zeros(0, np.uint32)] * len(texts)
    for a, b in slices([texts[i] for i in full], SLICE):
        given = full[a:b]
        x = np.frombuffer("".join(texts[i] for i in given).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        x = _mix(x + np.uint64(1))
        first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in given])))[:-1]
        text, found, low = np.arange(len(given)), [], []

        def named(x: np.ndarray, count: np.ndarray, level: int) -> np.ndarray:
            """Each symbol's text in the upper half, a name of the symbol at this level in the lower."""
            return (np.repeat(text, count).astype(np.uint64) << np.uint64(32)) | (_mix(x + np.uint64(level)) >> np.uint64(32))

        count, ends = np.diff(first, append=len(x)), np.append(first[1:], len(x)) - 1
        right = np.append(x[1:], x[:1])
        right[ends] = 0
        # the last character of a text has no right neighbour; it counts only where it is the only one
        whole = np.ones(len(x), bool)
        whole[ends] = count == 1
        pairs = named(_mix(x * _PLACES[0] + right * _PLACES[1]), count, 0)[whole]
        for level in range(1, LEVELS + 1):
            x, first = _parsed(x, first)
            count = np.diff(first, append=len(x))
            (found if level >= BELOW else low).append(named(x, count, level))
            if level >= BELOW:
                # a text that is one phrase has no more to say
                stay = count > 1
                if not stay.any():
                    break
                if not stay.all():
                    x = x[np.repeat(stay, count)]
                    text, first = text[stay], np.concatenate(([0], np.cumsum(count[stay])))[:-1]
        names = np.unique(np.concatenate(found))
        for more, enough in ((np.concatenate(low), SKETCH), (pairs, FEW)):
            wanted = np.bincount((names >> np.uint64(32)).astype(np.int64), minlength=len(given)) < enough
            names = np.unique(np.concatenate([names, more[wanted[(more >> np.uint64(32)).astype(np.int64)]]]))
        edges = np.searchsorted(names, np.arange(len(given) + 1, dtype=np.uint64) << np.uint64(32))
        for k, i in enumerate(given):
            out[i] = names[edges[k]:min(edges[k + 1], edges[k] + SKETCH)].astype(np.uint32)
    return out


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common names among the least names of both; 1 for two empty fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    names, n = np.unique(np.concatenate((a, b)), return_counts=True)
    return float((n[:SKETCH] == 2).mean())


def edited(text: str, after: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _order(text_col: str, at: str, id_col: str) -> list[Column]:
    return [F.col(id_col).isNotNull().alias("has_id"), F.col(id_col).alias("id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(at).alias("row_at")]


def _blocks(keys: DataFrame) -> tuple[list[tuple], dict[tuple, int]]:
    """First keys of blocks of consecutive rows, and for each last key the block that comes after it (the first after the last)."""
    numbered = number_rows(keys, [F.col("has_id"), F.col("id"), F.col("tie"), F.col("row_at")], "row_no")
    n = numbered.count()
    size = max(BLOCK_ROWS, ceil(n / MOST_BLOCKS))
    edges = numbered.filter((F.col("row_no") % size == 0) | (F.col("row_no") % size == size - 1) | (F.col("row_no") == n - 1)).collect()
    firsts, ends = [], {}
    for r in sorted(edges, key=lambda r: r["row_no"]):
        key = (r["has_id"], r["id"], r["tie"], tuple(r["row_at"]))
        if r["row_no"] % size == 0:
            firsts.append(key)
        if r["row_no"] % size == size - 1 or r["row_no"] == n - 1:
            ends[key] = 0 if r["row_no"] == n - 1 else r["row_no"] // size + 1
    return firsts, ends


def _comparable(key: tuple) -> tuple:
    return key if key[0] else (False, *key[2:])


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, ahead, has_id, id, tie, row_at, text), sorted: in a block every row follows its next document.

    The next document is the one with the next smaller id; the largest follows
    the smallest.  Null ids are the smallest; equal ids are told apart by their texts,
    then by where they are stored.  The one row a block lacks, the next document of its first
    row, comes first, marked ``ahead``.  Texts are shuffled once.
    """
    at = free_name(docs, "row_at")
    rows = addressed(docs, at)
    firsts, ends = _blocks(rows.select(*_order(text_col, at, id_col)))
    bounds = [_comparable(k) for k in firsts]
    sent = docs.sparkSession.sparkContext.broadcast((bounds, ends))
    keyed = rows.select(*_order(text_col, at, id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, ends = sent.value
        for batch in batches:
            file, row = batch.column("row_at").field(0).to_pylist(), batch.column("row_at").field(1).to_pylist()
            keys = list(zip(batch.column("has_id").to_pylist(), batch.column("id").to_pylist(), batch.column("tie").to_pylist(), zip(file, row)))
            block, take, ahead = [], [], []
            for i, key in enumerate(keys):
                block.append(bisect_right(bounds, _comparable(key)) - 1)
                take.append(i)
                ahead.append(False)
                if key in ends:
                    block.append(ends[key])
                    take.append(i)
                    ahead.append(True)
            dealt = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(ahead), *dealt.columns],
                                             names=["block", "ahead", *batch.schema.names])

    kind = keyed.schema["id"].dataType.simpleString()
    return (keyed.mapInArrow(deal, f"block long, ahead boolean, has_id boolean, id {kind}, tie long, "
                                   "row_at struct<file:long,row:long>, text string")
            .repartition("block").sortWithinPartitions("block", F.desc("ahead"), "has_id", "id", "tie", "row_at"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    A fingerprint is the hexadecimal form of its names; likeness is that of the
    sketches.  A null text counts as empty, with an empty fingerprint, which is
    like another empty one only.  A table of one row has that row as its own next document.
    For the next document of repeated rows see ``neighbours``.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows = neighbours(docs, id_col, text_col).select("ahead", "id", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, before_sketch = "", np.zeros(0, np.uint32)
        for batch in batches:
            ahead, texts = batch.column("ahead").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts, SLICE):
                own = sketches(texts[a:b])
                after = [before, *texts[a:b - 1]]
                changed = [t if skip else edited(t, x) for t, x, skip in zip(texts[a:b], after, ahead[a:b])]
                other = sketches(changed)
                rows = []
                for i in range(b - a):
                    if not ahead[a + i]:
                        rows.append((i, len(texts[a + i]), hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest(),
                                     as_text(own[i]), as_text(other[i]), likeness(own[i], other[i]),
                                     likeness(own[i], own[i - 1] if i else before_sketch)))
                before, before_sketch = texts[b - 1], own[-1]
                place, *columns = zip(*rows) if rows else ((),) * 7
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a).take(pa.array(place, pa.int64())), *map(pa.array, columns, kinds)],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(describe, f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, "
                                     "fingerprint string, edited_fingerprint string, near_edited double, near_next double")
