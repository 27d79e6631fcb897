"""Hidden Markov model with Gaussian-mixture emissions (diagonal covariances).

Sequences are cut into chunks of consecutive rows, many to a task, which steps
through all of them together.  They are packed once, before the rounds: a block of
chunks holds its distinct vectors and a code for each row, in the order of the steps,
so that a round computes densities once for equal vectors and slices arrays.  The exact forward and backward messages at the chunk
edges come from chaining the chunks' transfer matrices (states x states each), so
cutting a sequence changes neither the likelihood nor the decoded path.

EM is accelerated by squared extrapolation: two rounds give a direction and its
change, from which a longer step follows.  The step is kept when the next round
finds that it has at least the likelihood of the round before, else the plain one is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.markov_steps import TINY, Chunks, backward, best_paths, best_transfers, forward, transfers
from lynceus.operators.eda import Scaler
from lynceus.operators.ordering import as_list, group_sizes, max_rows_per_task, row_index
from lynceus.session import BROADCAST_BYTES, durable, held_bytes, keep_cached

VARIANCE_FLOOR = 1e-3
#: Rounds of the k-means that gives the first means; each is a job, and EM moves the means anyway.
START_ROUNDS = 20


@dataclass
class Parameters:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    weight: np.ndarray  # S x M
    mean: np.ndarray  # S x M x p
    var: np.ndarray  # S x M x p


#: exp of less is slow to compute and nothing beside the 1 of the nearest mixture.
LEAST_LOG = -700.0


def _emission(params: Parameters, x: np.ndarray, shares: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Emission likelihoods (states x rows) scaled by their largest mixture, the log scale, and mixture shares (states x mixtures x rows, in pieces)."""
    s, m, p = params.mean.shape
    mean, var = params.mean.reshape(s * m, p), params.var.reshape(s * m, p)
    at_zero = -0.5 * ((mean ** 2 / var).sum(axis=1) + np.log(2 * np.pi * var).sum(axis=1)) + np.log(params.weight + TINY).ravel()
    factors = np.hstack([at_zero[:, None], mean / var, -0.5 / var])
    b, scale, pieces, powers = np.empty((s, len(x))), np.empty(len(x)), [], _powers(x)
    for rows in _pieces(params, len(x)):
        parts = (factors @ powers[:, rows]).reshape(s, m, -1)
        top = parts.max(axis=1)
        parts -= top[:, None]
        np.maximum(parts, LEAST_LOG, out=parts)
        np.exp(parts, out=parts)
        total = parts.sum(axis=1)
        scale[rows] = top.max(axis=0)
        b[:, rows] = total * np.exp(top - scale[rows])
        if shares:
            parts /= total[:, None]
            pieces.append(parts)
    return b, scale, pieces


def _powers(x: np.ndarray) -> np.ndarray:
    """1, the columns and their squares, below each other."""
    return np.vstack([np.ones(len(x)), x.T, x.T ** 2])


def _pieces(params: Parameters, n: int) -> list[slice]:
    """Rows whose densities stay in a core's cache."""
    step = max(256, 16_384 // params.weight.size)
    return [slice(a, a + step) for a in range(0, n, step)]


def expectations(params: Parameters, x: np.ndarray, codes: np.ndarray, lengths: np.ndarray, first: np.ndarray, ahead: np.ndarray,
                 behind: np.ndarray) -> np.ndarray:
    """Sufficient statistics of many chunks, added up and flattened.  ``codes``: the row of ``x`` that each row has, in the order of the steps.

    For each chunk, by falling length, ``first``: it begins its sequence; ``ahead``: forward message before it (the start
    distribution for a first one); ``behind``: backward message at its last row.
    """
    c, move = Chunks.by_step(lengths), params.move
    emitted, scale, shares = _emission(params, x, shares=True)
    b = emitted[:, codes]
    alpha, norm = forward(c, b.T, move, first, ahead)
    alpha, beta = alpha.T, backward(c, b.T, move, behind).T
    gamma = alpha * beta
    gamma /= gamma.sum(axis=0) + TINY
    heads = len(lengths)
    beta *= b
    xi = _moves(move, ahead.T[:, ~first], beta[:, :heads][:, ~first]) + _moves(move, alpha[:, c.previous()], beta[:, heads:])
    mass = np.array([np.bincount(codes, weights=g, minlength=len(x)) for g in gamma])
    sums, powers = 0, _powers(x)
    for rows, share in zip(_pieces(params, len(x)), shares):
        share *= mass[:, None, rows]
        sums = sums + share.reshape(params.weight.size, -1) @ powers[:, rows].T
    post, sx, sxx = np.split(sums, [1, 1 + x.shape[1]], axis=1)
    likelihood = np.log(norm).sum() + scale[codes].sum()
    return np.concatenate([gamma[:, :heads][:, first].sum(axis=1), xi.ravel(), post.ravel(), sx.ravel(), sxx.ravel(), [likelihood]])


def _moves(move: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Expected moves between rows, from the messages before and after them (states x rows)."""
    weights = 1 / (((move.T @ before) * after).sum(axis=0) + TINY)
    return move * ((before * weights) @ after.T)


def maximise(stats: np.ndarray, s: int, m: int, p: int) -> tuple[Parameters, float]:
    cuts = np.cumsum([s, s * s, s * m, s * m * p, s * m * p])
    start, xi, post, sx, sxx, likelihood = np.split(stats, cuts)
    post = post.reshape(s, m)
    mass = post[:, :, None] + 1e-10
    mean = sx.reshape(s, m, p) / mass
    var = np.maximum(sxx.reshape(s, m, p) / mass - mean ** 2, VARIANCE_FLOOR)
    xi = xi.reshape(s, s) + 1e-10
    return Parameters((start + 1e-10) / (start + 1e-10).sum(), xi / xi.sum(axis=1, keepdims=True),
                      (post + 1e-10) / (post + 1e-10).sum(axis=1, keepdims=True), mean, var), float(likelihood[0])


def _free(params: Parameters) -> np.ndarray:
    """Parameters as one vector without constraints: logs of shares and variances."""
    return np.concatenate([np.log(params.start + TINY), np.log(params.move + TINY).ravel(), np.log(params.weight + TINY).ravel(),
                           params.mean.ravel(), np.log(params.var).ravel()])


def _bound(v: np.ndarray, like: Parameters) -> Parameters:
    """The parameters of a free vector; shares are made to add up to one."""
    s, m, p = like.mean.shape
    start, move, weight, mean, var = np.split(v, np.cumsum([s, s * s, s * m, s * m * p]))

    def shares(log: np.ndarray) -> np.ndarray:
        out = np.exp(log - log.max(axis=-1, keepdims=True)) + 1e-12
        return out / out.sum(axis=-1, keepdims=True)
    return Parameters(shares(start), shares(move.reshape(s, s)), shares(weight.reshape(s, m)), mean.reshape(s, m, p),
                      np.maximum(np.exp(np.clip(var, -50.0, 50.0)).reshape(s, m, p), VARIANCE_FLOOR))


def extrapolate(a: Parameters, b: Parameters, c: Parameters) -> Parameters | None:
    """The squared step from three successive rounds; none when it is no longer than they are."""
    x, y, z = map(_free, (a, b, c))
    r, v = y - x, z - 2 * y + x
    length = -np.sqrt((r @ r) / max(v @ v, TINY))
    return _bound(x - 2 * length * r + length ** 2 * v, a) if length < -1 else None


def squared_em(round_of: Callable[[Parameters], tuple[Parameters, float]], params: Parameters, n_iter: int,
               tol: float) -> tuple[Parameters, list[float]]:
    """(parameters, likelihoods of the rounds kept, never falling).  ``round_of``: the next parameters, and the likelihood of the given ones.

    Ends when a cycle of three rounds gains less than ``tol`` (a share of the likelihood), or after ``n_iter`` rounds.
    """
    kept: list[float] = []
    path, best, guess = [params], params, False  # the last of ``path`` is judged next; ``best`` has been judged
    plain = params
    for _ in range(n_iter):
        found, likelihood = round_of(path[-1])
        if guess and not likelihood >= kept[-1]:
            path, guess = [plain], False  # the longer step is worse: on from the plain round
            continue
        gain = likelihood - kept[-1] if kept else np.inf
        kept.append(likelihood)
        # a plain round after a long step gains little: what counts is the gain of a whole cycle, or of the first rounds
        cycle = likelihood - kept[-4] if len(kept) > 3 else gain
        if not guess and abs(cycle) < tol * max(1.0, abs(likelihood)):
            return path[-1], kept
        best, path, guess = path[-1], [*path, found], False
        if len(path) == 3:
            plain, longer = found, extrapolate(*path)
            path, guess = ([longer], True) if longer else ([plain], False)
    return best, kept


def _tables(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Chunks side by side, sorted: a task for each core at most, of a quarter of a table or more, but none of too many rows."""
    spark = rows.sparkSession
    parts = max(1, min(spark.sparkContext.defaultParallelism, 4 * n // TABLE_ROWS), -(-n // max_rows_per_task(spark)))
    return rows.repartition(parts, *by).sortWithinPartitions(*by, "_i")


def _vectors(table: pa.Table) -> np.ndarray:
    return table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _rows_by_chunk(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows and the lengths of their chunks, about ``most`` rows at a time; the input is sorted by key, chunk and position."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        i, chunk = table.column("_i").to_numpy(), table.column("_chunk").to_numpy()
        return np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(chunk) != 0)]))

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= most:
            table = pa.Table.from_batches(held)
            edges = cut(table)
            if len(edges) > 1:
                # the last chunk may go on in the next batch
                yield table.slice(0, edges[-1]), np.diff(edges)
                held = table.slice(edges[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.diff(np.append(cut(table), len(table)))


#: Rows of a chunk; longer series are cut, with the same result.  A task steps through the chunks of about TABLE_ROWS rows together.
CHUNK_ROWS, TABLE_ROWS = 4_096, 65_536
#: Bytes that the mixture shares (or the vectors) of a block take at most, which bounds the rows of a block.
BLOCK_BYTES = 32 << 20
_NUMBERS = T.ArrayType(T.DoubleType())
#: Up to so many tasks send their statistics to the driver; those of more are added up in Spark first.
FEW_TASKS = 256


def _whole(first: np.ndarray, lengths: np.ndarray, chunk: int) -> np.ndarray:
    """Chunks that are certainly a whole sequence, which needs no messages."""
    return first & (lengths < chunk)


def _blocks(rows: DataFrame, by: Sequence[str], chunk: int, most: int, p: int) -> DataFrame:
    """Rows of ``_tables`` packed: a row for each block of about ``most`` rows, with the keys of the chunks that are cut."""
    key = T.StructType([T.StructField("_at", T.IntegerType()), T.StructField("_i", T.LongType()), *[rows.schema[k] for k in by]])
    schema = (T.StructType().add("_block", "long").add("_vectors", "binary").add("_codes", "binary").add("_lengths", "binary")
              .add("_first", "binary").add("_cut", T.ArrayType(key)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for table, lengths in _rows_by_chunk(batches, most):
            c = Chunks.of(lengths)
            x = np.ascontiguousarray(_vectors(table)[c.rows_by_step()])
            coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * p), len(x), [None, pa.py_buffer(x)]).dictionary_encode()
            vectors = b"".join(coded.dictionary.to_pylist())
            heads = table.take(c.starts).combine_chunks()
            first = heads.column("_chunk").to_numpy() == 0
            at = np.flatnonzero(~_whole(first, c.lengths, chunk))
            cut = heads.take(at)
            keys = pa.StructArray.from_arrays([pa.array(at, pa.int32()), *[cut.column(k).combine_chunks() for k in ("_i", *by)]], ["_at", "_i", *by])
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), *[pa.array([a], pa.binary()) for a in (
                    vectors, coded.indices.to_numpy().astype(np.int32).tobytes(), c.lengths.astype(np.int32).tobytes(), first.tobytes())],
                pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), keys)], schema.names)
            number += 1
    return rows.mapInArrow(pack, schema)


def _unpacked(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block with its vectors, codes, lengths of chunks and which of them begin a sequence."""
    for batch in batches:
        for i in range(len(batch)):
            x, codes, lengths, first = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (
                ("_vectors", np.float64), ("_codes", np.int32), ("_lengths", np.int32), ("_first", np.bool_)))
            yield batch.slice(i, 1), x.reshape(-1, p), codes, lengths, first


@dataclass
class HiddenMarkov:
    scaler: Scaler
    params: Parameters
    key: list[str]
    order: list[str]
    chunk: int
    log_likelihood: float = float("-inf")
    history: list[float] = field(default_factory=list)
    labels: list | None = None

    def _chunks(self, df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, bool]:
        """Rows with position, chunk and scaled vector, one partition per few chunks; whether any key is cut."""
        sizes = group_sizes(df, self.key)
        rows = row_index(df, self.order, key=self.key, name="_i", sizes=sizes)
        x = F.array(*[self.scaler.scaled(c) for c in self.scaler.cols])
        one = [] if self.key else [F.lit(0).alias("_one")]
        rows = rows.select(*keep, *one, "_i", F.floor(F.col("_i") / self.chunk).alias("_chunk"), x.alias("_x"))
        by = [*self._by, "_chunk"]
        return _tables(rows, by, sizes[1]), sizes[0] > self.chunk

    @property
    def _by(self) -> list[str]:
        return self.key or ["_one"]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], n_states: int, order: str | Sequence[str],
            key: str | Sequence[str] | None = None, n_mix: int = 10, n_iter: int = 1000, tol: float = 1e-4,
            chunk: int | None = None, seed: int = 42, target: str | None = None) -> HiddenMarkov:
        """EM on complete rows until three rounds gain less than ``tol`` of the likelihood, or ``n_iter`` rounds; one job a round.

        With ``target`` the states are named by their majority label.
        """
        key, order = as_list(key), as_list(order)
        df = df.na.drop(subset=list(cols))
        scaler = Scaler.fit(df, cols)
        chunk = chunk or min(CHUNK_ROWS, max_rows_per_task(df.sparkSession))
        model = cls(scaler, _start(df, scaler, n_states, n_mix, seed), key, order, chunk)
        rows, split = model._chunks(df, key)
        p, n_tasks = len(cols), rows.rdd.getNumPartitions()
        blocks = _blocks(rows, model._by, chunk, max(chunk, BLOCK_BYTES // (8 * max(n_states * n_mix, 2 * p + 1))), p).persist()

        def round_of(params: Parameters) -> tuple[Parameters, float]:
            model.params = params
            return maximise(model._e_step(blocks, n_tasks, split), n_states, n_mix, p)

        model.params, model.history = squared_em(round_of, model.params, n_iter, tol)
        model.log_likelihood = model.history[-1] if model.history else model.log_likelihood
        blocks.unpersist()
        if target:
            named = (model.transform(df).groupBy("state", target).agg(F.count(F.lit(1)).alias("n"))
                     .groupBy("state").agg(F.min(F.struct(-F.col("n"), F.col(target))).alias("b")))
            found = {r["state"]: r["b"][1] for r in named.collect()}  # one row per state
            model.labels = [found.get(i) for i in range(n_states)]
        return model

    def _chained(self, steps: DataFrame, place: Sequence[str], best: bool) -> DataFrame:
        """From the matrices ``_m`` of chunks (by, _i of the first row): at each ``place``, the message before its chunk and behind it
        (sum-product), or before it and its final state."""
        params, by = self.params, self._by
        s = len(params.start)
        schema = T.StructType([steps.schema[c] for c in place]).add("_ahead", _NUMBERS).add("_behind", _NUMBERS)

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            """One small matrix per chunk of one sequence."""
            pdf = pdf.sort_values("_i")
            ms = [np.asarray(m, float).reshape(s, s) for m in pdf["_m"]]
            out = pdf[list(place)].copy()
            ahead = [np.log(params.start + TINY) if best else params.start]
            for m in ms:
                nxt = (ahead[-1][:, None] + m).max(axis=0) if best else ahead[-1] @ m
                ahead.append(nxt if best else nxt / (nxt.sum() + TINY))
            behind = []
            if best:
                state = int(ahead[-1].argmax())
                for m, a in zip(reversed(ms), reversed(ahead[:-1])):
                    behind.append([float(state)])
                    state = int((a + m[:, state]).argmax())
            else:
                b = np.full(s, 1.0 / s)
                for m in reversed(ms):
                    behind.append(b.tolist())
                    b = m @ b
                    b = b / (b.sum() + TINY)
            out["_ahead"] = [a.tolist() for a in ahead[:-1]]
            out["_behind"] = behind[::-1]
            return out

        return durable(steps.groupBy(*by).applyInPandas(chain, schema))

    def _best_messages(self, rows: DataFrame) -> DataFrame:
        """(by, _i of its first row, message before it, final state) of each chunk that is cut."""
        params, by, chunk = self.params, self._by, self.chunk
        schema = T.StructType([rows.schema[k] for k in by]).add("_i", "long").add("_m", _NUMBERS)
        log_move = np.log(params.move + TINY)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, lengths in _rows_by_chunk(batches, TABLE_ROWS):
                c, heads = Chunks.of(lengths), table.take(np.cumsum(lengths) - lengths)
                first = heads.column("_chunk").to_numpy() == 0
                b, scale, _ = _emission(params, _vectors(table))
                found = best_transfers(c, (np.log(b + TINY) + scale).T, log_move, first[c.place])
                m = np.empty_like(found)
                m[c.place] = found
                out = heads.select([*by, "_i"]).append_column("_m", pa.array(list(m.reshape(len(m), -1)), pa.list_(pa.float64())))
                yield from out.take(np.flatnonzero(~_whole(first, lengths, chunk))).to_batches()

        return self._chained(rows.select(*by, "_i", "_chunk", "_x").mapInArrow(step, schema), [*by, "_i"], best=True)

    def _with_best_messages(self, rows: DataFrame) -> DataFrame:
        """Rows with (_ahead, _behind) at the first row of each chunk that is cut, sorted as before."""
        edges = self._best_messages(rows).withColumnsRenamed({k: f"_edge{n}" for n, k in enumerate([*self._by, "_i"])})
        by = [*self._by, "_chunk"]
        same = [rows[k].eqNullSafe(edges[f"_edge{n}"]) for n, k in enumerate([*self._by, "_i"])]
        if held_bytes(edges) <= BROADCAST_BYTES:
            joined = rows.join(F.broadcast(edges), same, "left")
        else:
            joined = _tables(rows.join(edges, same, "left"), by, rows.count())
        return joined.drop(*edges.columns[:len(same)]).sortWithinPartitions(*by, "_i")

    def _with_messages(self, blocks: DataFrame) -> DataFrame:
        """Blocks with ``_messages``: place in the block, message before and behind each chunk that is cut."""
        params, by = self.params, self._by
        p = params.mean.shape[2]
        keys = blocks.schema["_cut"].dataType.elementType
        schema = T.StructType([keys[k] for k in by]).add("_i", "long").add("_block", "long").add("_at", "integer").add("_m", _NUMBERS)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, x, codes, lengths, first in _unpacked(batches, p):
                cut = block.column("_cut").flatten()
                if len(cut):
                    b = _emission(params, x)[0][:, codes]
                    at = cut.field("_at").to_numpy()
                    m = transfers(Chunks.by_step(lengths), b.T, params.move, first)[at].reshape(len(at), -1)
                    yield pa.RecordBatch.from_arrays([*[cut.field(k) for k in (*by, "_i")], block.column("_block").take([0] * len(at)), cut.field("_at"),
                                                      pa.array(list(m), pa.list_(pa.float64()))], schema.names)

        edges = self._chained(blocks.mapInArrow(step, schema), ["_block", "_at"], best=False)
        small = held_bytes(edges) <= BROADCAST_BYTES
        edges = edges.groupBy("_block").agg(F.collect_list(F.struct("_at", "_ahead", "_behind")).alias("_messages"))
        return blocks.join(F.broadcast(edges) if small else edges, "_block", "left")

    def _e_step(self, blocks: DataFrame, n_tasks: int, split: bool) -> np.ndarray:
        params = self.params
        s, _, p = params.mean.shape

        def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for block, x, codes, lengths, first in _unpacked(batches, p):
                ahead, behind = np.tile(params.start, (len(lengths), 1)), np.full((len(lengths), s), 1.0 / s)
                for edge in (block.column("_messages")[0].as_py() or []) if split else []:
                    ahead[edge["_at"]], behind[edge["_at"]] = edge["_ahead"], edge["_behind"]
                total = total + expectations(params, x, codes, lengths, first, ahead, behind)
            if np.ndim(total):
                yield pa.RecordBatch.from_pydict({"_s": pa.array([total], pa.list_(pa.float64()))})

        parts = (self._with_messages(blocks) if split else blocks).mapInArrow(statistics, "_s array<double>")
        if n_tasks <= FEW_TASKS:
            # a fixed number of statistics from each of a few tasks
            return np.sum([r["_s"] for r in parts.collect()], axis=0)
        sums = (parts.select(F.posexplode("_s").alias("_pos", "_v")).groupBy("_pos").agg(F.sum("_v").alias("_v")).orderBy("_pos").collect())
        return np.array([r["_v"] for r in sums])

    def transform(self, df: DataFrame) -> DataFrame:
        """Most probable state path: ``state`` and, when states are named, ``y_pred``.

        The path runs over complete rows; a row with a missing sensor has null there.
        """
        params, chunk = self.params, self.chunk
        keep = list(df.columns)
        complete = F.lit(True)
        for c in self.scaler.cols:
            complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        rows, split = self._chunks(df.filter(complete), keep)
        schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("state", T.IntegerType())])
        log_start, log_move = np.log(params.start + TINY), np.log(params.move + TINY)

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, lengths in _rows_by_chunk(batches, TABLE_ROWS):
                c, heads = Chunks.of(lengths), table.take(np.cumsum(lengths) - lengths)
                first = heads.column("_chunk").to_numpy() == 0
                before, last = np.tile(log_start, (len(lengths), 1)), np.full(len(lengths), -1)
                if split:
                    for n in np.flatnonzero(~_whole(first, lengths, chunk)):
                        before[n], last[n] = heads.column("_ahead")[n].as_py(), heads.column("_behind")[n].as_py()[0]
                b, scale, _ = _emission(params, _vectors(table))
                path = best_paths(c, (np.log(b + TINY) + scale).T, log_move, first[c.place], before[c.place], last[c.place])
                yield from table.select(keep).append_column("state", pa.array(path, pa.int32())).to_batches()

        if split:
            by = [*self._by, "_chunk"]
            rows = durable(rows)
            rows = _tables(rows, by, rows.count())
        done = (self._with_best_messages(rows) if split else rows).mapInArrow(decode, schema)
        done = done.unionByName(df.filter(~complete).withColumn("state", F.lit(None).cast("int")))
        if not self.labels:
            return done
        name = F.lit(None)
        for i, label in enumerate(self.labels):
            name = F.when(F.col("state") == i, F.lit(label)).otherwise(name)
        return done.withColumn("y_pred", name)


def _start(df: DataFrame, scaler: Scaler, s: int, m: int, seed: int) -> Parameters:
    """k-means centres as component means; states take the centres in order of their first column."""
    names = [f"_z{i}" for i in range(len(scaler.cols))]
    scaled = df.select(*[scaler.scaled(c).alias(n) for c, n in zip(scaler.cols, names)])
    ready = keep_cached(VectorAssembler(inputCols=names, outputCol="_v").transform(scaled).select("_v"))
    try:
        found = KMeans(k=s * m, featuresCol="_v", seed=seed, maxIter=START_ROUNDS).fit(ready).clusterCenters()
    finally:
        ready.unpersist()
    centres = np.array(sorted(map(tuple, found)))
    while len(centres) < s * m:
        centres = np.vstack([centres, centres[-1] + 1e-2 * (len(centres) + 1)])
    mean = centres.reshape(s, m, -1)
    move = np.full((s, s), 0.4 / max(s - 1, 1))
    np.fill_diagonal(move, 0.6 if s > 1 else 1.0)
    return Parameters(np.full(s, 1.0 / s), move, np.full((s, m), 1.0 / m), mean, np.ones_like(mean))
