"""The prefix trie of conversations, with count-min screening of prefix names.

A turn becomes a digest where it is read; texts move no further.  The name of a
prefix is the exclusive or of the digests of its (depth, turn) pairs, 128 bits, so that a running
aggregate names all prefixes, also across the parts of a very long conversation.

A count-min sketch over all names says of most that they occur once: when one of
its counters is one, the prefix belongs to a single conversation, and so do all
longer ones.  Nodes of such tails are complete where their rows lie.  Only names
that may be shared are grouped, exactly: in every group, all members must agree
on the name of the parent and on the last turn, else the digests are salted anew.
By induction over the depth, equal names then mean equal prefixes.

No step gathers a group in a task.  Conversations are cut into pieces
(range_no, conv) of one task's rows, sums run inside pieces, and pieces hand
on their totals; groups are counted in (name, salt) parts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.session import durable, sized

#: Rows of the sketch; counters of a row for each name, between bounds (one bit of a counter is broadcast: 32 MB at most).
ROWS, PER_NAME, LEAST_WIDTH, MOST_WIDTH = 2, 8, 1 << 12, 1 << 27
#: Salts tried before giving up on names that differ where prefixes do; one does but for texts made to defeat it.
TRIES = 8
#: A group is counted in so many parts before it is counted as a whole.
SALTS = 64
#: A conversation starts with up to HEADS turns of the one whose id is the multiple of FAMILY at or before its own (towards zero).
FAMILY, HEADS = 20, 3
WORD = r"[^\x20\x09-\x0D]+"
#: What a node is named by, and its parent.
NAME, PARENT = ["x1", "x2"], ["p1", "p2"]


def digested(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, turn, digest, words); null role or text becomes empty, rows without a conversation are left out."""
    spoken = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    return (turns.filter(F.col(conv).isNotNull())
            .select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
                    F.unhex(F.sha2(F.concat(F.length(spoken[0]).cast("string"), F.lit(":"), *spoken), 256)).alias("digest"),
                    F.size(F.regexp_extract_all(spoken[1], F.lit(WORD), F.lit(0))).alias("words")))


def kept_heads(conv: Column) -> Column:
    """How many turns of its base conversation a conversation starts with."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """All rows in order: (conv, kind, turn, digest, words, range_no, range_pos); kind 0 are the turns taken from the base, kind 1 own ones.

    Rows are range-partitioned on the whole order, so that a conversation of very many turns spreads over several ranges.
    """
    conv = F.col("conv")
    order = ["conv", "kind", "turn", "digest"]
    first = Window.partitionBy("conv").orderBy("turn", "digest")
    bases = (turns.filter(conv % family == 0).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= heads)
             .withColumn("base", conv).withColumn("by", F.explode(F.sequence(F.lit(1 - family), F.lit(family - 1))))
             .withColumn("conv", F.try_add(conv, F.col("by").cast("long")))
             .filter((conv - conv % family == F.col("base")) & (F.col("at") <= kept_heads(conv))))
    columns = ["conv", "kind", "turn", "digest", "words"]
    both = bases.withColumn("kind", F.lit(0)).select(columns).unionByName(turns.withColumn("kind", F.lit(1)).select(columns))
    return durable(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range_pos", F.monotonically_increasing_id())
                   .withColumn("range_no", F.shiftright("range_pos", 33).cast("int"))
                   .withColumn("range_pos", F.col("range_pos").bitwiseAND(F.lit((1 << 33) - 1))))


def across_ranges(pieces: DataFrame, sums: dict[str, Column], later: bool = False) -> DataFrame:
    """For pieces (range_no, conv) with totals: what the earlier (or later) pieces of the conversation total; a row for each piece.

    Only conversations on the edge of ranges have several pieces: two rows for each range at most.
    """
    by = Window.partitionBy("conv").orderBy(F.desc("range_no") if later else F.asc("range_no")).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("range_no", "conv", *(F.coalesce(total.over(by), F.lit(0)).alias(name) for name, total in sums.items()))


def edge_conversations(placed: DataFrame) -> DataFrame:
    """The conversations (conv) that lie in several ranges: each is the first or last of all its ranges."""
    ends = placed.groupBy("range_no").agg(F.array_distinct(F.array(F.min("conv"), F.max("conv"))).alias("c"))
    return ends.select(F.explode("c").alias("conv")).groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv")


def in_depth(placed: DataFrame, edges: DataFrame, salt: int) -> DataFrame:
    """Rows (conv, range_no, depth, len, first, words, d1, d2, l1, l2): depth is null for turns that the base replaces.

    ``first`` marks one row of every conversation; (d1, d2) is the digest of (depth, turn), (l1, l2) the
    exclusive or of those in this range up to here.
    """
    here = Window.partitionBy("range_no", "conv")
    counts = {"heads": F.sum(1 - F.col("kind")), "own": F.sum("kind")}
    pieces = sized(placed.join(edges, "conv").groupBy("range_no", "conv").agg(*(c.cast("long").alias(n) for n, c in counts.items())))
    before = across_ranges(pieces, {"heads_before": F.sum("heads"), "own_before": F.sum("own")})
    whole = pieces.groupBy("conv").agg(F.sum("heads").alias("heads_whole"), F.sum("own").alias("own_whole"))
    moved = sized(before.join(whole, "conv"))

    rows = placed.select("*", *(c.over(here).alias(f"{n}_here") for n, c in counts.items()), F.min("range_pos").over(here).alias("start"))
    rows = rows.join(moved, ["range_no", "conv"], "left")
    heads, own = F.coalesce("heads_whole", "heads_here"), F.coalesce("own_whole", "own_here")
    h = kept_heads(F.col("conv"))
    # kind 0 rows come first in a piece
    own_at = F.coalesce("own_before", F.lit(0)) + F.col("range_pos") - F.col("start") - F.col("heads_here") + 1
    head_at = F.coalesce("heads_before", F.lit(0)) + F.col("range_pos") - F.col("start") + 1
    depth = F.when(F.col("kind") == 0, head_at).when(own_at > h, heads + own_at - h)
    rows = (rows.filter(own > 0).withColumn("depth", depth).withColumn("len", heads + F.greatest(own - h, F.lit(0)))
            .withColumn("first", (F.col("kind") == 1) & (own_at == 1)))
    digests = [F.when(F.col("depth").isNotNull(), F.xxhash64(F.lit(salt + i), "depth", "digest")).otherwise(F.lit(0)) for i in (0, 1)]
    rows = rows.select("conv", "range_no", "range_pos", "depth", "len", "first", "words", *(d.alias(f"d{i + 1}") for i, d in enumerate(digests)))
    upto = here.orderBy("range_pos")
    return durable(rows.select("conv", "range_no", "depth", "len", "first", "words", "d1", "d2",
                               *(F.bit_xor(f"d{i}").over(upto).alias(f"l{i}") for i in (1, 2)))
                   .filter(F.col("first") | F.col("depth").isNotNull()))


def named(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with depth: names (x1, x2) of the prefixes and (p1, p2) of those without the last turn; (0, 0) is the root's."""
    pieces = sized(rows.join(edges, "conv").groupBy("range_no", "conv").agg(F.bit_xor("d1").alias("t1"), F.bit_xor("d2").alias("t2")))
    before = sized(across_ranges(pieces, {"b1": F.bit_xor("t1"), "b2": F.bit_xor("t2")}))
    out = rows.filter("depth is not null").join(before, ["range_no", "conv"], "left")
    for i in (1, 2):
        out = out.withColumn(f"x{i}", F.col(f"l{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0)))).withColumn(f"p{i}", F.col(f"x{i}").bitwiseXOR(F.col(f"d{i}")))
    return out.select("conv", "range_no", "depth", "len", "words", *NAME, *PARENT)


@dataclass(frozen=True)
class Sketch:
    """A count-min sketch of all names, cut down to one bit a counter: whether it is above one."""
    width: int
    bits: Broadcast

    def alone(self, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        """Which names are estimated to occur once: they do."""
        packed, out = self.bits.value, np.zeros(len(x1), bool)
        for cell in cells(x1, x2, self.width):
            out |= (packed[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0
        return out


def cells(x1: np.ndarray, x2: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each name in each row of the sketch; ``width`` is a power of two."""
    return [((x1.view(np.uint64) if row == 0 else x2.view(np.uint64)) & np.uint64(width - 1)).astype(np.int64) + row * width for row in range(ROWS)]


def sketch_of(names: DataFrame) -> Sketch:
    """Count all names.  Counters live in the tasks that add them up; every block of them sends its bits to the driver."""
    n = names.count()
    width = min(max(LEAST_WIDTH, 1 << (PER_NAME * n // ROWS).bit_length()), MOST_WIDTH)
    block = min(ROWS * width, 1 << 20)

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x1, x2 = (batch.column(i).to_numpy() for i in (0, 1))
            cell, n = np.unique(np.concatenate(cells(x1, x2, width)), return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": cell, "n": n})

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(block, np.uint8)
        for batch in batches:
            flags[batch.column("cell").to_numpy() % block] = 1
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int64()),
                                          "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    above = names.mapInArrow(touch, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    found = (above.select("cell", F.floor(F.col("cell") / block).cast("long").alias("block")).groupBy("block")
             .applyInArrow(pack, "block long, bits binary").collect())
    packed = np.zeros(ROWS * width // 8, np.uint8)
    for r in found:
        packed[r.block * block // 8:(r.block + 1) * block // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return Sketch(width, names.sparkSession.sparkContext.broadcast(packed))


def screened(names: DataFrame, sketch: Sketch) -> DataFrame:
    """``names`` with (alone, parent_alone); the root is never alone."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names.schema.fields)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x1, x2, p1, p2 = (batch.column(c).to_numpy() for c in NAME + PARENT)
            above = sketch.alone(p1, p2) & (batch.column("depth").to_numpy() > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch.alone(x1, x2)), pa.array(above)],
                                             names=[*batch.schema.names, "alone", "parent_alone"])

    return names.mapInArrow(look, f"{kinds}, alone boolean, parent_alone boolean")


def salt_of(conv: Column) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(SALTS)).cast("int")


def groups_of(shared: DataFrame) -> DataFrame:
    """Exact groups of the names: one row (name, salt) for each part of a group, with what the whole group has.

    Parts are counted where rows lie, then in the shuffle; a whole group joins at most SALTS rows.
    """
    parts = (shared.withColumn("salt", salt_of(F.col("conv"))).groupBy(*NAME, "salt")
             .agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("c"), F.max("parent_alone").alias("parent_alone"), F.sum((F.col("depth") == F.col("len")).cast("long")).alias("e"),
                  *(f(c).alias(f"{c}_{f.__name__}") for c in ("p1", "p2", "depth") for f in (F.min, F.max))))
    whole = Window.partitionBy(*NAME)
    alike = [F.min(f"{c}_min").over(whole) == F.max(f"{c}_max").over(whole) for c in ("p1", "p2", "depth")]
    return durable(parts.select(*NAME, "salt", F.sum("n").over(whole).alias("n_convs"), F.min("c").over(whole).alias("conv_id"),
                                F.sum("e").over(whole).alias("n_ends"), F.col("p1_min").alias("p1"), F.col("p2_min").alias("p2"),
                                F.col("depth_min").alias("depth"), "parent_alone",
                                (alike[0] & alike[1] & alike[2]).alias("exact")))


def hashed_ends(ends: DataFrame) -> DataFrame:
    """Rows (x1, x2, ends): for each name the hash of its conversations' ids, ascending, joined by commas.

    The ids are sorted in ranges and joined to long lines there; one task reads the lines of a name in order, a
    line at a time, since the hash is sequential.
    """
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x1, x2, conv = (batch.column(c).to_numpy() for c in ("x1", "x2", "conv"))
            cut = np.flatnonzero(np.concatenate([[True], (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])])) if len(conv) else np.array([], int)
            ends = np.concatenate([cut[1:], [len(conv)]])
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cut, ends)]
            yield pa.RecordBatch.from_pydict({"x1": x1[cut], "x2": x2[cut], "from_conv": conv[cut], "ids": pa.array(text, pa.string())})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for x1, x2, ids in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "ids"))):
                if (x1, x2) == name:
                    state.update(b",")
                else:
                    if name:
                        out.append((*name, state.hexdigest()))
                    name, state = (x1, x2), hashlib.sha256()
                state.update(ids.encode())
            yield _ends(out)
        if name:
            yield _ends([(*name, state.hexdigest())])

    sorted_ids = ends.repartitionByRange(*NAME, "conv").sortWithinPartitions(*NAME, "conv").select(*NAME, "conv")
    joined = sorted_ids.mapInArrow(lines, "x1 long, x2 long, from_conv long, ids string")
    return joined.repartition(*NAME).sortWithinPartitions(*NAME, "from_conv").select(*NAME, "ids").mapInArrow(hashes, "x1 long, x2 long, ends string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string())], names=["x1", "x2", "ends"])


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Null role or text counts as empty.  Turns without a conversation id are left out.  A null turn comes first; equal
    turn numbers, repeated rows too, are ordered by the digest of role and text, so reruns agree.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    kind = turns.schema[conv_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{conv_col} must hold integers, not {kind.simpleString()}")
    # written, since ordering the rows samples them first
    placed = rebuilt(durable(digested(turns, conv_col, turn_col, role_col, text_col)))
    edges = sized(edge_conversations(placed))
    for salt in range(0, 2 * TRIES, 2):
        rows = in_depth(placed, edges, salt)
        names = named(rows, edges)
        seen = screened(names, sketch_of(names.select(*NAME)))
        shared = seen.filter(~F.col("alone"))
        groups = groups_of(shared)
        if groups.filter(~F.col("exact")).isEmpty():
            return _nodes(rows, seen, groups, edges)
    raise ValueError("different prefixes keep getting equal names")


def _nodes(rows: DataFrame, seen: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    n_convs, least = rows.filter("first").agg(F.count(F.lit(1)), F.min("conv")).first()
    empty = hashlib.sha256(b"").hexdigest()
    alone, ends_here = F.col("alone"), F.col("depth") == F.col("len")

    # what every conversation adds along its path: a leaf where it is the least member of one, the tokens saved at nodes it stands for
    found = groups.select(*NAME, "salt", "n_convs", "conv_id", "n_ends")
    stands_for = F.col("conv_id") == F.col("conv")
    added = durable(
        seen.filter(~alone | ends_here).withColumn("salt", F.when(~alone, salt_of(F.col("conv"))))
        .join(found, [*NAME, "salt"], "left")
        .select("conv", "range_no", "depth", *NAME, alone,
                F.when(alone, F.lit(1)).otherwise((ends_here & stands_for & (F.col("n_ends") == F.col("n_convs"))).cast("int")).cast("long").alias("leaf"),
                F.when(alone | ~stands_for, F.lit(0)).otherwise((F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved")))
    pieces = sized(added.join(edges, "conv").groupBy("range_no", "conv").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")))
    after = sized(across_ranges(pieces, {"leaf_after": F.sum("leaf"), "saved_after": F.sum("saved")}, later=True))
    onward = Window.partitionBy("range_no", "conv").orderBy(F.desc("depth"))
    sums = (added.select("range_no", "conv", *NAME, "alone", *(F.sum(c).over(onward).alias(c) for c in ("leaf", "saved"))).filter(~alone)
            .join(after, ["range_no", "conv"], "left")
            .select(*NAME, *((F.col(c) + F.coalesce(f"{c}_after", F.lit(0))).alias(c) for c in ("leaf", "saved"))))

    # shared nodes: one row of each group, and what others say about it
    one = groups.filter(F.col("salt") == salt_of(F.col("conv_id")))
    heads = seen.filter(alone & ~F.col("parent_alone"))
    root_ends = rows.filter(F.col("first") & (F.col("len") == 0)).select(*(F.lit(0).cast("long").alias(c) for c in NAME), "conv")
    ends = hashed_ends(seen.filter(~alone & ends_here).select(*NAME, "conv").unionByName(root_ends))
    as_name = [F.col(p).alias(x) for p, x in zip(PARENT, NAME)]
    said = [one.select(*NAME, *PARENT, "depth", "n_convs", "conv_id", "parent_alone"), sums,
            one.filter(~F.col("parent_alone")).select(*as_name, F.lit(1).alias("child")), heads.select(*as_name, F.lit(1).alias("child")), ends]
    all_said = said[0]
    for more in said[1:]:
        all_said = all_said.unionByName(more, allowMissingColumns=True)
    nodes = (all_said.groupBy(*NAME).agg(*(F.max(c).alias(c) for c in (*PARENT, "depth", "n_convs", "conv_id", "parent_alone", "ends")),
                                         *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("child", "leaf", "saved"))))
    total = added.agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).first()
    is_root = (F.col("x1") == 0) & (F.col("x2") == 0) & F.col("depth").isNull()

    # parents: those of shared nodes and of the first nodes of tails, looked up in the part of the group that holds their conversation
    tails = heads.select(*PARENT, "depth", F.lit(1).cast("long").alias("n_convs"), F.col("conv").alias("conv_id"), F.lit(False).alias("parent_alone"),
                         (~ends_here).cast("long").alias("child"), F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"),
                         F.when(ends_here, F.sha2(F.col("conv").cast("string"), 256)).alias("ends"))
    above = groups.select(*as_parent(), F.col("conv_id").alias("above"), F.col("salt"))
    columns = [*PARENT, "depth", "n_convs", "conv_id", "parent_alone", "child", "leaf", "saved", "ends"]
    # a longer prefix of a lone one may look shared in the sketch
    inner = (nodes.filter(~is_root).select(columns).unionByName(tails).withColumn("salt", salt_of(F.col("conv_id")))
             .join(above, [*PARENT, "salt"], "left")
             .withColumn("above", F.when(F.col("depth") == 1, F.lit(least)).when(F.col("parent_alone"), F.col("conv_id")).otherwise(F.col("above"))))
    later = seen.filter(alone & F.col("parent_alone")).select(
        "depth", F.lit(1).cast("long").alias("n_convs"), F.col("conv").alias("conv_id"), (~ends_here).cast("long").alias("child"),
        F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"),
        F.when(ends_here, F.sha2(F.col("conv").cast("string"), 256)).alias("ends"), F.col("conv").alias("above"))
    root = nodes.filter(is_root).select(F.lit(0).cast("long").alias("depth"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(least).cast("long").alias("conv_id"),
                       "child", F.lit(total.leaf or 1).cast("long").alias("leaf"), F.lit(total.saved or 0).cast("long").alias("saved"), "ends",
                       F.lit(None).cast("long").alias("above"))
    out = inner.select(root.columns).unionByName(later.select(root.columns)).unionByName(root)
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs",
                      F.col("child").alias("n_children"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends", F.lit(empty)).alias("ends_sha256"))


def as_parent() -> list[Column]:
    return [F.col(x).alias(p) for p, x in zip(PARENT, NAME)]
