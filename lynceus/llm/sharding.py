"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

The permutation acts on pairs (left, right) with left below a and right below
b, where a is the root of n, rounded up, and a * b just covers n.  Rounds add a
keyed function of one half to the other, so the map is invertible whatever the
function is.  Numbers that land outside 0..n-1 walk on along their cycle until
they are inside.  Shard and slot of a row follow from its number alone, and the
inverse gives the number for a shard and slot.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.rows import addressed, free_name, number_rows

ROUNDS = 6
PRIME = 2_147_483_647
#: Fewer than sqrt(n) numbers lie outside 0..n-1, so a walk takes longer than this with odds of n ** -32 at most.
WALK = 64


def halves(n: int) -> tuple[int, int]:
    a = isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int]]:
    return [((seed * 1_000_003 + 7_919 * (2 * i + 1)) % PRIME, (seed * 69_069 + 104_729 * (2 * i + 2)) % PRIME)
            for i in range(ROUNDS)]


def mixed(x: str, keys: tuple[int, int]) -> str:
    """SQL of a keyed function of one half, in arithmetic that fits 64 bits: squares modulo a prime, twice."""
    y = f"(({x} + {keys[0]}) % {PRIME})"
    z = f"(({y} * {y} + {keys[1]}) % {PRIME})"
    return f"({z} * {z} + {y})"


def _rounds(x: str, n: int, seed: int, back: bool) -> str:
    """SQL of all rounds on the number ``x`` below a * b; ``back`` undoes them.

    The rounds are a fold over their numbers, with one branch per round.
    """
    a, b = halves(n)
    order = list(enumerate(round_keys(seed)))
    sign = "-" if back else "+"
    branches = " ".join(
        f"WHEN {i} THEN named_struct('l', pmod(h.l {sign} {mixed('h.r', k)}, {a}L), 'r', h.r)" if i % 2 == 0
        else f"WHEN {i} THEN named_struct('l', h.l, 'r', pmod(h.r {sign} {mixed('h.l', k)}, {b}L))"
        for i, k in order)
    turns = ", ".join(str(i) for i, _ in (order[::-1] if back else order))
    return (f"aggregate(array({turns}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), "
            f"(h, i) -> CASE i {branches} END, h -> h.l * {b}L + h.r)")


def permuted(number: str, n: int, seed: int, back: bool = False) -> Column:
    """Where the permutation of 0..n-1 sends the long column ``number``; ``back`` gives the inverse."""
    once = _rounds(f"CAST({number} AS BIGINT)", n, seed, back)
    walk = _rounds("x", n, seed, back)
    end = (f"x -> CASE WHEN x < {n}L THEN x ELSE CAST(raise_error('the walk did not end, choose another seed') AS BIGINT) END")
    return F.expr(f"aggregate(sequence(1, {WALK}), {once}, (x, i) -> CASE WHEN x < {n}L THEN x ELSE {walk} END, {end})")


def row_of(shard: str, slot: str, n: int, shards: int, seed: int) -> Column:
    """The global row number that lies in ``slot`` of ``shard``."""
    return permuted(f"({slot} * {shards} + {shard})", n, seed, back=True)


def shuffled_shards(docs: DataFrame, shards: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (row_at, id, size, text_crc32, row_no, shard, slot) for each row of ``docs``.

    Rows are numbered along id (nulls last), then the checksum of the text, then
    the row's address, which tells repeated rows apart.  Shards hold equally many
    rows, but for one; slots run from 0 without gaps.  A null text has size 1 and
    checksum 0, like an empty one.  An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    at = free_name(docs, "row_at")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = addressed(docs, at).select(F.col(at).alias("row_at"), F.col(id_col).alias("id"),
                                      (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = number_rows(rows, [F.col("id").asc_nulls_last(), F.col("text_crc32"), F.col("row_at")], "row_no")
    n = rows.count()
    place = rows.withColumn("place", permuted("row_no", n, seed))
    return (place.withColumn("shard", (F.col("place") % shards).cast("int"))
            .withColumn("slot", F.call_function("div", F.col("place"), F.lit(shards)).cast("long")).drop("place"))
