"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a share of the whole; a document of it is taken floor(r) times
plus once more with probability r - floor(r), where r is target / size of the
source.  The extra takes are drawn by the cube method: the flight moves the
probabilities of a few documents at a time along a direction that leaves the
token and the document total as they are, until one of them is 0 or 1.  Blocks of
a source fly apart from each other; what each block leaves undecided, at most as
many documents as there are totals, flies again with the other blocks' rest,
level by level, and only the last few documents of a source are landed.
"""

from __future__ import annotations

import random
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name, number_rows
from lynceus.session import durable, sized

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that fly together.
BLOCK = 4096
EPS = 1e-9


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Append place, weight and target to a table of one row (source, source_size) per source.

    Sources in order of their bytes, null last, weigh ``weights`` in turn and
    share the whole size.  No target exceeds ``most`` times its source's size; the
    excess goes to the others by weight.  In closed form: with a level L, a target
    is min(most * size, L * weight), and L is found where sources are sorted by
    most * size / weight.  The windows run over one row per source.
    """
    turn = (F.col("place") - 1) % len(weights) + 1
    limits = (totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
              .withColumn("limit", F.col("source_size") * F.lit(float(most))))
    ranked = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far, rest = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    levels = limits.select(
        "*", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(so_far), F.lit(0.0))).alias("left"),
        F.sum("weight").over(rest).alias("weights_left"))
    # the first source, in this order, that stays below its limit fixes the level
    free = F.when(F.col("left") / F.col("weights_left") * F.col("weight") < F.col("limit"), F.col("left") / F.col("weights_left"))
    level = F.first(free, ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit"))
    return levels.withColumn("level", level).select("source", "place", "source_size", "weight", share.alias("target"))


def _direction(sizes: list[float]) -> list[float]:
    """A move of three probabilities that changes neither their sum nor the sum weighted by sizes."""
    a, b, c = sizes
    u = [b - c, c - a, a - b]
    return u if any(abs(x) > EPS for x in u) else [1.0, -1.0, 0.0]


def flight(prob: list[float], sizes: list[int], rng: random.Random) -> list[int]:
    """Move ``prob`` until at most two of them lie inside (0, 1); returns the places of those."""
    inside: list[int] = []
    for i, p in enumerate(prob):
        if not EPS < p < 1 - EPS:
            prob[i] = float(round(p))
            continue
        inside.append(i)
        if len(inside) < 3:
            continue
        u = _direction([sizes[j] for j in inside])
        up = min((1 - prob[j]) / x if x > 0 else prob[j] / -x for j, x in zip(inside, u) if x)
        down = min(prob[j] / x if x > 0 else (1 - prob[j]) / -x for j, x in zip(inside, u) if x)
        # the mean of the move is zero, which keeps every document's own probability
        step = up if rng.random() < down / (up + down) else -down
        for j, x in zip(inside, u):
            prob[j] += step * x
            if prob[j] < EPS or prob[j] > 1 - EPS:
                prob[j] = float(round(prob[j]))
        inside = [j for j in inside if 0.0 < prob[j] < 1.0]
    return inside


def land(prob: list[float], sizes: list[int], inside: list[int]) -> None:
    """Decide the last documents so that the token total, then the document total, is missed least."""
    if inside:
        want, count = sum(prob[j] * sizes[j] for j in inside), sum(prob[j] for j in inside)
        best = min(product((0.0, 1.0), repeat=len(inside)),
                   key=lambda s: (abs(sum(x * sizes[j] for x, j in zip(s, inside)) - want), abs(sum(s) - count), s))
        for x, j in zip(best, inside):
            prob[j] = x


def fly(units: DataFrame, block: int, seed: int, level: int, last: bool) -> DataFrame:
    """One level: units (group, row_no, prob, size, ...) fly in blocks of consecutive row numbers of their group."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)

    def move(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_no")
        first = table["row_no"][0].as_py()
        prob, sizes = table["prob"].to_pylist(), table["size"].to_pylist()
        inside = flight(prob, sizes, random.Random(f"{seed} {level} {first}"))
        if last:
            land(prob, sizes, inside)
        return (table.drop_columns(["block"])
                .set_column(table.column_names.index("prob"), "prob", pa.array(prob, pa.float64())))

    here = F.lit(0) if last else F.call_function("div", F.col("row_no"), F.lit(block))
    return durable(units.withColumn("block", here).groupBy("group", "block").applyInArrow(move, schema))


def balanced_sample(units: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """Decide units (group, prob, size, tie, row_at, ...): ``prob`` becomes 0 or 1.

    In each group the sums of prob and of prob * size stay as they are, up to the
    landing of its last two units.  ``tie`` and ``row_at`` order the units of a group.
    """
    level, done = 0, None
    todo = number_rows(units, [F.col("group"), F.col("tie"), F.col("row_at")], "row_no")
    while True:
        largest = todo.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        last = largest <= block
        moved = fly(todo, block, seed, level, last)
        decided = moved.filter("prob = 0 OR prob = 1")
        done = decided if done is None else done.unionByName(decided)
        if last:
            return done.drop("row_no")
        open_units = moved.filter("prob > 0 AND prob < 1").drop("row_no")
        todo, level = number_rows(open_units, [F.col("group"), F.col("tie"), F.col("row_at")], "row_no"), level + 1


def _mixed(docs: DataFrame, at: str, seed: int, block: int, weights: tuple[float, ...], most: float,
           id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = durable(docs.select(
        F.col(at).alias("row_at"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        count_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("tie")))
    shares = sized(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
                   .withColumnRenamed("place", "group").withColumnRenamed("source", "of"))
    takes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("takes") + F.lit(EPS))
    units = (rows.join(shares, rows["source"].eqNullSafe(shares["of"])).drop("of", "weight")
             .withColumn("takes", takes).withColumn("whole", whole)
             .withColumn("prob", F.greatest(F.col("takes") - F.col("whole"), F.lit(0.0))))
    return (balanced_sample(units, seed, block)
            .withColumn("repeats", (F.col("whole") + F.col("prob")).cast("int"))
            .select("row_at", "id", "source", "size", "source_size", "target",
                    (F.col("size") * F.col("repeats")).alias("taken"), "repeats"))


def mix(docs: DataFrame, seed: int = 1, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row (row_at, id, source, size, source_size, target, taken, repeats) for each row of ``docs``.

    ``repeats`` is how often the mix takes the document, ``taken`` the words that
    makes.  Size is the number of words, 0 for a null or empty text.  A null
    source is a source of its own, in last place.  Documents that are empty, or of
    an empty source, add no words, whatever is drawn for them.  Rows that repeat are drawn each for itself.
    The draw depends on ids and texts, not on where rows are stored.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    at = free_name(docs, "row_at")
    return _mixed(addressed(docs, at), at, seed, block, weights, most, id_col, text_col, source_col)


def mixed_documents(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns as they are."""
    at = free_name(docs, "row_at")
    rows = addressed(docs, at)
    often = _mixed(rows, at, seed, BLOCK, WEIGHTS, 3.0, id_col, text_col, source_col).filter("repeats > 0")
    n, copies = free_name(docs, "mix_repeats"), free_name(docs, "mix_copy")
    often = sized(often.select(F.col("row_at").alias(at), F.col("repeats").alias(n)))
    return (rows.join(often, at).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns))
