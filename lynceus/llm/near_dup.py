"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A document is the set of its distinct 5-word shingles.  Its signature has
symbols of 16 bits, one per MinHash.  At the least similarity of 0.85 there are 48.  Signatures that differ in at most 21
symbols are all found: cut into 11 chunks, they agree in some chunk but for at
most one symbol (22 errors would be needed for two in each), so a document is filed
under every chunk with every one of its symbols left out: 48 keys.  A pair at
the least similarity has more than 21 different symbols with odds of about 4e-7.
At 0.8 there are 64 symbols in 16 chunks, so 64 keys, and more than the 31
different symbols have odds of 8e-8 (``scheme`` works this out).

Documents with equal sets are one node.  The members of a key are not paired with
each other: each is held against the key's most shared member, links are
confirmed on the full sets, and linked nodes become components.  Only keys
that then still hold several components are searched for further pairs, between
different components and within the signature distance; there a second, longer
signature (1024 symbols of 8 bits, odds under 1e-7 to lose a link) sets aside what is
merely alike, as large families of altered copies are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.components import components
from lynceus.llm.rows import addressed, free_name, number_rows
from lynceus.llm.tokens import slices
from lynceus.session import durable, sized

WORDS = 5
PERCENT = 85
#: Symbols of the longer signature, and by how many standard deviations more may differ than at the least similarity.
LONG, LONG_REACH = 1024, 5.5
#: Odds at most that a pair at the least similarity exceeds the signature distance.
LOSS = 5e-7
#: Members of a key that meet in one task at a time.
BLOCK = 1024

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLY, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, (64 + LONG, 2), dtype=np.uint64)
#: Functions of the symbols, 64 at most, and of the longer signature.
_SHORT_FUNCTIONS, _LONG_FUNCTIONS = np.concatenate((_RANDOM[:48], _RANDOM[48 + LONG:])), _RANDOM[48:48 + LONG]


@dataclass(frozen=True)
class Scheme:
    """The least similarity in percent, and the signature that finds pairs from there on."""

    percent: int
    symbols: int
    chunks: int

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1

    @property
    def long_distance(self) -> int:
        return int(LONG * (1 - self.percent / 100) + LONG_REACH * (LONG * (1 - self.percent / 100) * self.percent / 100) ** 0.5)

    @property
    def cuts(self) -> np.ndarray:
        return np.linspace(0, self.symbols, self.chunks + 1).astype(int)

    @property
    def slots(self) -> list[tuple[int, int, int]]:
        """(chunk begin, chunk end, symbol left out) of every key"""
        return [(a, b, j) for a, b in zip(self.cuts[:-1], self.cuts[1:]) for j in range(a, b)]

    @property
    def loss(self) -> float:
        """The odds that a pair at the least similarity exceeds the distance."""
        same = self.percent / 100
        return sum(comb(self.symbols, k) * (1 - same) ** k * same ** (self.symbols - k) for k in range(self.distance + 1, self.symbols + 1))


def scheme(percent: int) -> Scheme:
    """The shortest signature whose odds of loss are small, with chunks of four symbols or more (three in a key)."""
    for symbols in (48, 64):
        for chunks in range(1, symbols // 4 + 1):
            if (found := Scheme(percent, symbols, chunks)).loss <= LOSS:
                return found
    raise ValueError(f"a least similarity of {percent} % needs longer signatures")


_DEFAULT = scheme(PERCENT)
SYMBOLS, CHUNKS, DISTANCE = _DEFAULT.symbols, _DEFAULT.chunks, _DEFAULT.distance


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FINISH
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of other than ASCII white space, with A-Z lowered; fewer
    than five words are one shingle, no words none.
    """
    words = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    mixed = np.zeros(max(0, len(flat) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        mixed = _mix(mixed * _MULTIPLY + flat[k:k + len(mixed)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(mixed[at:at + n - WORDS + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[at:at + n].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _minima(sets: list[np.ndarray], functions: np.ndarray, bits: int, kind: type) -> np.ndarray:
    """One row for each set: the last ``bits`` bits of its MinHash by every function; zeros for an empty set."""
    out = np.zeros((len(sets), len(functions)), kind)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])))[:-1]
        for k, (c, m) in enumerate(functions):
            least = np.minimum.reduceat((flat ^ c) * (m | np.uint64(1)), starts)
            out[full, k] = (_mix(least) >> np.uint64(64 - bits)).astype(kind)
    return out


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    return _minima(sets, _SHORT_FUNCTIONS[:symbols], 16, np.uint16)


def long_signatures(sets: list[np.ndarray]) -> np.ndarray:
    return _minima(sets, _LONG_FUNCTIONS, 8, np.uint8)


def _described(docs: DataFrame, at: str, id_col: str, text_col: str, symbols: int) -> DataFrame:
    """(row_at, id, n_shingles, digest, signature) for every row; the digest names the set."""
    rows = docs.select(F.col(at).alias("row_at"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                signed = signatures(sets, symbols)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_at").slice(a, b - a), batch.column("id").slice(a, b - a),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in signed], pa.binary())],
                    names=["row_at", "id", "n_shingles", "digest", "signature"])

    return rows.mapInArrow(describe, f"row_at struct<file:long,row:long>, id {rows.schema['id'].dataType.simpleString()}, "
                                     "n_shingles long, digest binary, signature binary")


def _symbols(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, symbols)


def _keys(nodes: DataFrame, how: Scheme) -> DataFrame:
    """(key, node): every node under its keys, one per symbol.  The low six bits of a key are its number."""
    slots = how.slots

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signed = _symbols(batch.column("signature"), how.symbols).astype(np.uint64)
            keys = np.empty((len(slots), len(signed)), np.uint64)
            for k, (a, b, left_out) in enumerate(slots):
                h = np.full(len(signed), k + 1, np.uint64)
                for j in range(a, b):
                    if j != left_out:
                        h = _mix(h * _MULTIPLY + signed[:, j])
                keys[k] = (h << np.uint64(6)) | np.uint64(k)
            node = np.tile(batch.column("node").to_numpy(), len(slots))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(file, "key long, node long")


def _near(pairs: DataFrame, nodes: DataFrame, how: Scheme) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose signatures are within the distance."""
    side = [nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab"]
    sizes = F.lit(100) * F.least("n_a", "n_b") >= F.lit(how.percent) * F.greatest("n_a", "n_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = (_symbols(batch.column("s_a"), how.symbols) != _symbols(batch.column("s_b"), how.symbols)).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(differ <= how.distance))

    return (pairs.join(side[0], "a").join(side[1], "b").filter(sizes)
            .select("a", "b", "s_a", "s_b").mapInArrow(keep, "a long, b long"))


def _from_texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, at: str, text_col: str, name: str, make) -> DataFrame:
    """(node, ``name``): ``make`` of the shingle set of every wanted node, as bytes.  The texts of these nodes are read again."""
    wanted = sized(nodes.join(wanted, "node", "left_semi").select("node", F.col("row_at.file").alias("f"), F.col("row_at.row").alias("r")))
    texts = docs.select(F.col(at).alias("row_at"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, (texts["row_at.file"] == wanted["f"]) & (texts["row_at.row"] == wanted["r"])).select("node", "text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, all_texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(all_texts):
                made = make(shingle_sets(all_texts[a:b]))
                yield pa.RecordBatch.from_arrays([node.slice(a, b - a), pa.array([x.tobytes() for x in made], pa.binary())],
                                                 names=["node", name])

    return durable(texts.mapInArrow(collect, f"node long, {name} binary"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, at: str, text_col: str, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    pairs = durable(pairs)
    wanted = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    sets = _from_texts(wanted, nodes, docs, at, text_col, "members", lambda sets: sets)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, other = (sets.select(F.col("node").alias(n), F.col("members").alias(m)) for n, m in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _at_first_key(differ: np.ndarray, key: int, how: Scheme = _DEFAULT) -> np.ndarray:
    """For rows of differing symbols: whether ``key`` is the first key that the two signatures share."""
    a, b, left_out = how.slots[key]
    wrong = np.add.reduceat(differ, how.cuts[:-1], axis=1, dtype=np.int64)
    chunk = int(np.searchsorted(how.cuts, a, side="right")) - 1
    here = np.where(wrong[:, chunk] == 0, left_out == a, (wrong[:, chunk] == 1) & differ[:, left_out])
    return here & (wrong[:, :chunk] > 1).all(axis=1)


def _meet(rows: pa.Table, edges: list[int], how: Scheme) -> tuple[list[int], list[int]]:
    """The pairs within each run of rows between two ``edges``."""
    key, node, root, size, side = (rows.column(c).to_numpy() for c in ("key", "node", "root", "n_shingles", "side"))
    signed = _symbols(rows.column("signature"), how.symbols)
    long = np.frombuffer(b"".join(rows.column("long").to_pylist()), np.uint8).reshape(-1, LONG)
    a, b, long_distance = [], [], how.long_distance
    for begin, end in zip(edges[:-1], edges[1:]):
        for i in range(begin, end - 1):
            others = slice(i + 1, end)
            ok = (root[others] != root[i]) & ((side[others] != side[i]) | (side[i] == 0))
            ok &= 100 * np.minimum(size[others], size[i]) >= how.percent * np.maximum(size[others], size[i])
            places = np.flatnonzero(ok) + i + 1
            if len(places):
                differ = signed[places] != signed[i]
                near = (differ.sum(axis=1) <= how.distance) & _at_first_key(differ, int(key[i] & 63), how)
                places = places[near]
                places = places[(long[places] != long[i]).sum(axis=1) <= long_distance]
                a += np.minimum(node[places], node[i]).tolist()
                b += np.maximum(node[places], node[i]).tolist()
    return a, b


def _across(members: DataFrame, how: Scheme) -> DataFrame:
    """Pairs (a, b) under the keys of (key, node, root, n, n_shingles, signature, long): of different components, near by size and signatures.

    Keys with many members are cut into blocks, and every two blocks meet in a
    run of their own.  A pair comes from the first key only that it shares.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    met = (members.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
           .select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                   "node", "root", "n_shingles", "signature", "long",
                   F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch, over in _with_end(batches):
            held += [batch] if batch is not None else []
            rows = pa.Table.from_batches(held) if held else None
            if rows is None or not rows.num_rows:
                continue
            k, x, y = (rows.column(c).to_numpy() for c in ("key", "left", "right"))
            edges = (np.flatnonzero((k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist()
            edges = [0, *edges, *([len(k)] if over else [])]
            a, b = _meet(rows, edges, how)
            held = rows.slice(edges[-1]).to_batches()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right").mapInArrow(search, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, bool]]:
    for batch in batches:
        yield batch, False
    yield None, True


def _stars(filed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a key with the one that shares the most keys with others."""
    shared = filed.groupBy("node").agg(F.sum(F.col("n") - 1).alias("weight"))
    heads = (filed.select("key", "node").join(shared, "node").groupBy("key")
             .agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("best")))
    met = filed.join(heads.select("key", (-F.col("best.minus")).alias("head")), "key").filter("node <> head")
    return met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _links(nodes: DataFrame, docs: DataFrame, at: str, text_col: str, how: Scheme) -> DataFrame:
    """Links (a, b) that connect every two nodes that a chain of similar sets connects."""
    # a set of fewer shingles has no other set this similar
    keys = _keys(nodes.filter(F.col("n_shingles") * (100 - how.percent) >= how.percent), how)
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    filed = durable(keys.join(several, "key"))
    tried = durable(_near(_stars(filed), nodes, how))
    links = durable(_confirmed(tried, nodes, docs, at, text_col, how.percent))
    rooted = filed.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    divided = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    open_keys = durable(rooted.join(divided, "key", "left_semi"))
    long = _from_texts(open_keys.select("node").distinct(), nodes, docs, at, text_col, "long", long_signatures)
    members = open_keys.join(nodes.select("node", "n_shingles", "signature").join(long, "node"), "node")
    more = _across(members, how).distinct().join(tried, ["a", "b"], "left_anti")
    return links.unionByName(_confirmed(more, nodes, docs, at, text_col, how.percent))


def _grouped(docs: DataFrame, at: str, id_col: str, text_col: str, percent: int) -> DataFrame:
    how = scheme(percent)
    rows = durable(_described(docs, at, id_col, text_col, how.symbols))
    classes = (rows.filter("n_shingles > 0").groupBy("digest")
               .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_at")).alias("best"),
                    F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
               .select("best.*", "digest", "n_shingles", "signature"))
    # a smaller number is a smaller id
    nodes = number_rows(classes, [F.col("no_id"), F.col("id"), F.col("row_at")], "node")
    roots = durable(components(_links(nodes, docs, at, text_col, how)))
    firsts = nodes.select(F.col("node").alias("root"), F.col("id").alias("component_id"), F.col("row_at").alias("first_at"))
    named = (nodes.select("node", "digest").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")).join(firsts, "root").select("digest", "component_id", "first_at"))
    return (rows.select("row_at", "id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
            .join(named, "digest", "left")
            .select("row_at", "id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                    F.coalesce(F.col("first_at") == F.col("row_at"), F.lit(True)).alias("first")))


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row (row_at, id, n_shingles, component_id, first) for each row of ``docs``.

    Documents whose shingle sets have 100 * intersection >= ``percent`` * union are linked;
    ``component_id`` is the smallest id that links reach, a null id being larger than
    any other, and ``first`` marks exactly one row of each component, one with that id.  A text without words, or null,
    has no shingles and is a component of its own.  Rows that repeat are linked.  An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    at = free_name(docs, "row_at")
    return _grouped(addressed(docs, at), at, id_col, text_col, percent)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the first row of each component, all columns as they are."""
    at = free_name(docs, "row_at")
    rows = addressed(docs, at)
    go = _grouped(rows, at, id_col, text_col, percent).filter("NOT first").select(F.col("row_at").alias(at))
    return rows.join(sized(go), at, "left_anti").select(docs.columns)
