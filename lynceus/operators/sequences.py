"""Sequential patterns under a maximum gap, from vertical position bitmaps and a co-occurrence map.

Sequences are cut into segments of consecutive positions, each with a halo as
long as the longest pattern can reach, so that every match lies in the segment where it
begins.  A task turns a segment into one bitmap of positions for each item; the ends
of a pattern are such a bitmap too, and a pattern grows by shifting it over the gap and
intersecting it with the next item's.  A level is one job over the segments, and only
candidates that pass three tests are counted: their last two items are frequent within
the gap, each item is frequently followed by the last one at all (the co-occurrence
map), and the pattern without its first item is frequent.  Sequences of one segment and the
same events are one row with their number, and are matched once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.session import durable, sized

#: Positions of a segment without its halo.
SEGMENT = 10_000

Pattern = tuple[int, ...]


def segments(rows: DataFrame, reach: int, size: int = SEGMENT) -> DataFrame:
    """(_s, many, own, p, i, n) from rows (_s, _p, _i): positions from the segment's start and items, by position.

    Positions from ``own`` on belong to the halo.  ``many``: the sequence has several segments.  Sequences of one
    segment with the same events are one row: ``n`` of them, without a name.
    """
    size = max(size, reach, 1)
    at = F.floor((F.col("_p") - F.lit(1)) / size).cast("long")
    # a row near the start of a segment is seen from the one before, too
    homes = F.when((F.col("_p") - 1 - at * size < reach), F.array(at - 1, at)).otherwise(F.array(at))
    placed = rows.withColumn("seg", F.explode(homes))
    kept = (placed.groupBy("_s", "seg").agg(F.array_sort(F.collect_list(F.struct((F.col("_p") - 1 - F.col("seg") * size).cast("int").alias("p"), "_i"))).alias("e"))
            .filter(F.exists("e", lambda x: x["p"] < size)))
    spread = sized(rows.select("_s", at.alias("seg")).distinct().groupBy("_s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_s", F.lit(True).alias("many")))
    named = kept.join(spread, "_s", "left").select(F.when(F.col("many"), F.col("_s")).alias("_s"), F.when(F.col("many"), F.col("seg")).alias("seg"),
                                                   F.coalesce("many", F.lit(False)).alias("many"), F.col("e.p").alias("p"), F.col("e._i").alias("i"))
    alike = named.groupBy("_s", "seg", "many", "p", "i").agg(F.count(F.lit(1)).alias("n"))
    return durable(alike.select("_s", "many", F.lit(size).alias("own"), "p", "i", "n"))


def bitmaps(p: np.ndarray, i: np.ndarray) -> dict[int, int]:
    """Item -> its positions as bits of a whole number."""
    out = {}
    order = np.argsort(i, kind="stable")
    p, i = p[order], i[order]
    cuts = np.flatnonzero(np.diff(i)) + 1
    for places, item in zip(np.split(p, cuts), i[np.concatenate([[0], cuts])] if len(i) else ()):
        flags = np.zeros(int(places.max()) + 1, np.uint8)
        flags[places] = 1
        out[int(item)] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    return out


def after(ends: int, gap: int) -> int:
    """Positions at most ``gap`` after an end, by doubling the shifts."""
    out, done = ends << 1, 1
    while done < gap:
        step = min(done, gap - done)
        out, done = out | out << step, done + step
    return out


def matched(bits: dict[int, int], own: int, tree: dict[Pattern, list[int]], level: int, gap: int) -> Iterator[Pattern]:
    """The candidates of ``level`` items that match and begin before ``own``; ``tree``: the items that each prefix may go on with."""
    stack = [((i,), ends) for i in tree[()] if i in bits for ends in [bits[i] & ((1 << own) - 1)] if ends]
    while stack:
        pattern, ends = stack.pop()
        reach = after(ends, gap)
        for item in tree.get(pattern, ()):
            found = reach & bits.get(item, 0)
            if found:
                if len(pattern) + 1 == level:
                    yield (*pattern, item)
                else:
                    stack.append(((*pattern, item), found))


def _count(cut: DataFrame, measure) -> dict[Pattern, int]:
    """In how many sequences each pattern occurs; ``measure``(bitmaps, own) lists those of a segment.

    Tasks add up sequences of one segment; only of longer ones the pairs of sequence and pattern travel.
    """
    kind = cut.schema["_s"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        seqs: list = []
        pairs: list = []
        for batch in batches:
            names, many, own, n = (batch.column(c) for c in ("_s", "many", "own", "n"))
            for at in range(len(batch)):
                p, i = (batch.column(c)[at].values.to_numpy() for c in ("p", "i"))
                found = measure(bitmaps(p, i), own[at].as_py())
                if many[at].as_py():
                    found = sorted(set(found))
                    seqs += [names[at].as_py()] * len(found)
                    pairs += found
                else:
                    for pattern in found:
                        sums[pattern] += n[at].as_py()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(seqs, batch.schema.field("_s").type), pa.array(pairs, pa.list_(pa.int32())),
                                                  pa.array([1] * len(pairs), pa.int64())], names=["_s", "pattern", "n"])
                seqs, pairs = [], []
        if sums:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(sums), batch.schema.field("_s").type), pa.array(list(sums), pa.list_(pa.int32())),
                                              pa.array(list(sums.values()), pa.int64())], names=["_s", "pattern", "n"])

    found = cut.mapInArrow(partial, f"_s {kind}, pattern array<int>, n long")
    # rows without a name are sums of sequences of one segment; the others name a sequence of several
    whole = found.groupBy("pattern", "_s").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    rows = whole.groupBy("pattern").agg(F.sum(F.when(F.col("_s").isNull(), F.col("n")).otherwise(F.col("m"))).alias("n")).collect()
    return {tuple(r["pattern"]): r["n"] for r in rows}


def sequential_patterns(events: DataFrame, seq: str, pos: str, item: str, min_support: float = 0.5, min_len: int = 1, max_len: int = 10,
                        required: Sequence[str] = (), max_gap: int = 3, tried: list[int] | None = None) -> DataFrame:
    """(pattern, support): item sequences found in at least min_support of the sequences.

    Consecutive items of a pattern are at most ``max_gap`` positions apart (1 =
    adjacent).  ``pos`` numbers the events of a sequence without holes, from 1.
    Rows without a sequence or an item match nothing.  ``tried`` receives the
    number of candidates counted for each length from 2.
    """
    if max_len < 1 or max_gap < 1:
        raise ValueError("max_len and max_gap must be at least 1")
    rows = events.select(F.col(seq).alias("_s"), F.col(pos).cast("long").alias("_p"), F.col(item).cast("string").alias("_i"))
    rows = durable(rows.filter(F.col("_s").isNotNull()))
    n = rows.select("_s").distinct().count()
    wanted = max(1, ceil(min_support * n - 1e-9))
    # at most (events / wanted) items are frequent
    single = (rows.filter(F.col("_i").isNotNull()).select("_s", "_i").distinct().groupBy("_i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= wanted)
              .orderBy("_i").collect())
    names = [r["_i"] for r in single]
    found: dict[Pattern, int] = {(i,): r["n"] for i, r in enumerate(single)}
    level = dict(found)
    if names and max_len > 1:
        codes = sized(events.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "_i string, code int"))
        coded = rows.join(codes, "_i").select("_s", "_p", F.col("code").alias("_i"))
        first = coded.agg(F.min("_p")).first()[0]
        cut = segments(coded.withColumn("_p", F.col("_p") - first + 1), (max_len - 1) * max_gap)
        follows = None
        for size in range(2, max_len + 1):
            tree = candidates(level, follows)
            n_tried = sum(map(len, tree.values()))
            if tried is not None:
                tried.append(n_tried)
            if not n_tried:
                break
            # the ways to the prefixes that have candidates
            ways: dict[Pattern, set[int]] = defaultdict(set)
            for pattern in tree:
                for cut_at in range(size - 1):
                    ways[pattern[:cut_at]].add(pattern[cut_at])
            tree |= {way: sorted(items) for way, items in ways.items()}

            def measure(bits, own, tree=tree, size=size):
                return matched(bits, own, tree, size, max_gap)

            level = {p: c for p, c in _count(cut, measure).items() if c >= wanted}
            if size == 2 and max_len > 2:
                follows = co_occurrence(cut, wanted)
            if not level:
                break
            found |= level
    keep = [(p, c) for p, c in found.items() if len(p) >= min_len and {str(x) for x in required} <= {names[i] for i in p}]
    return events.sparkSession.createDataFrame([([names[i] for i in p], c) for p, c in keep], "pattern array<string>, support long")


def co_occurrence(cut: DataFrame, wanted: int) -> dict[int, set[int]] | None:
    """Item -> the items that come anywhere after it in enough sequences; None where a sequence has several segments."""
    if not cut.filter("many").isEmpty():
        return None  # the order within one segment says too little; the other two tests stay

    def measure(bits: dict[int, int], own: int) -> Iterator[Pattern]:
        first = {i: b & -b for i, b in bits.items()}
        return ((a, b) for a in bits for b, held in bits.items() if held > first[a] * 2 - 1)

    out: dict[int, set[int]] = defaultdict(set)
    for (a, b), n in _count(cut, measure).items():
        if n >= wanted:
            out[a].add(b)
    return out


def candidates(level: dict[Pattern, int], follows: dict[int, set[int]] | None) -> dict[Pattern, list[int]]:
    """Prefix -> last items of the candidates one item longer than the patterns of ``level``."""
    size = len(next(iter(level)))
    if size == 1:
        return {p: [q[0] for q in level] for p in level}
    ends: dict[Pattern, list[int]] = defaultdict(list)
    for p in level:
        ends[p[:-1]].append(p[-1])
    out = {}
    for p in level:
        # the candidate without its first item must be frequent
        last = [i for i in ends.get(p[1:], ()) if follows is None or all(i in follows[x] for x in p)]
        if last:
            out[p] = last
    return out
