"""Whitening of embeddings with distributed block matrices of Spark MLlib.

Vectors become integers x = floor(64 c) + 1,000,000 (``scale`` and ``shift``).
Their sums S are exact, so that n x - S, the centred vector times n, is exact
too; divided by n it fills blocks of up to ``rows_per_block`` rows.  Transpose
times matrix gives the scatter, p x p numbers are solved on the driver, and a
second block product with the whitening matrix projects the rows.

A last block column carries what must come out again with a row, its id and its
deviation, as 32-bit halves that a double holds exactly; the whitening matrix
passes it through unchanged.  So projected rows need no join with their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lynceus.session import durable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block, at most; blocks whose products one task adds up; columns of a block; columns that can be solved on the driver.
ROWS_PER_BLOCK, BLOCKS_PER_TASK, COLUMNS_PER_BLOCK, MOST_COLUMNS = 4096, 16, 1024, 4096
#: Entries beyond this can't be told apart after the shift; their rows count as not finite.
LARGEST = float(1 << 40)
#: Columns carried along: flags, two halves of the id, two of the deviation.
CARRIED = 5
HERE, NO_ID, NO_DEVIATION = 1, 2, 4

BLOCKS = T.StructType([T.StructField("at", T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType())])),
                       T.StructField("matrix", MatrixUDT())])


@dataclass(frozen=True)
class Sums:
    """Of all vectors: their number, the sum of every dimension, and the largest entry."""
    n: int
    sums: list[int]
    largest: int

    @property
    def p(self) -> int:
        return len(self.sums)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v): vectors without null or non-finite entries and of the most frequent length (of equally frequent ones the longest)."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{id_col} must hold integers, not {kind.simpleString()}")
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))))
    most = rows.groupBy(F.size("v").alias("p")).count().orderBy(F.desc("count"), F.desc("p")).first()
    return rows.filter((F.size("v") == (most.p if most else 0)) & (F.size("v") > 0))


def integers(column: pa.ListArray, p: int, scale: int, shift: int) -> np.ndarray:
    """The integer vectors of a batch, one a row."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    return np.floor(c * scale).astype(np.int64) + shift


def sums_of(vectors: DataFrame, scale: int, shift: int) -> Sums | None:
    """Exact sums of the integer vectors; every task sends one row for each dimension."""
    low = (1 << 24) - 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts, largest = 0, None, 0
        for batch in batches:
            if len(batch):
                x = integers(batch.column(0), len(batch.column(0)[0]), scale, shift)
                here = np.stack([(x >> 24).sum(0), (x & low).sum(0)])
                n, parts, largest = n + len(x), here if parts is None else parts + here, max(largest, int(np.abs(x).max(initial=0)))
        if n:
            p = parts.shape[1]
            yield pa.RecordBatch.from_pydict({"pos": pa.array(range(p), pa.int32()), "n": pa.array([n] * p, pa.int64()),
                                              "high": pa.array(parts[0]), "low": pa.array(parts[1]), "largest": pa.array([largest] * p, pa.int64())})

    found = (vectors.select("v").mapInArrow(partial, "pos int, n long, high long, low long, largest long").groupBy("pos")
             .agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.max("largest").alias("largest"))
             .orderBy("pos").limit(MOST_COLUMNS + 1).collect())
    if not found:
        return None
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"vectors of more than {MOST_COLUMNS} entries can't be solved on the driver")
    return Sums(found[0].n, [(r.high << 24) + r.low for r in found], max(r.largest for r in found))


def _halves(values: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    known = np.array([v or 0 for v in values], np.int64)
    return (known >> 32).astype(float), (known & 0xFFFFFFFF).astype(float)


def centred(x: np.ndarray, sums: Sums) -> tuple[np.ndarray, list[int | None]]:
    """Rows x - S / n as doubles, and the exact deviations; None for one that a long can't hold."""
    wide = sums.n * sums.largest + max(map(abs, sums.sums)) >= 1 << 62
    d = x.astype(object if wide else np.int64) * sums.n - np.array(sums.sums, object if wide else np.int64)
    top = int(abs(d).max()) if d.size else 0
    if sums.p * top * top >= 1 << 63:
        d2 = d.astype(object)
        found = [v if v < 1 << 63 else None for v in (d2 * d2).sum(1).tolist()]
    else:
        found = (d * d).sum(1).tolist()
    return (d / sums.n).astype(float), found


def _matrix(values: np.ndarray, kind: pa.StructType) -> pa.StructArray:
    """One dense matrix, as MLlib lays it out: type, rows, columns, no sparse fields, values by column."""
    def of(field: str, value) -> pa.Array:
        return pa.array([value], kind.field(field).type)
    flat = pa.array(np.ascontiguousarray(values.T).ravel())
    held = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat, type=kind.field("values").type)
    return pa.StructArray.from_arrays(
        [of("type", 1), of("numRows", values.shape[0]), of("numCols", values.shape[1]), of("colPtrs", None), of("rowIndices", None),
         held, of("isTransposed", False)], fields=[kind.field(i) for i in range(kind.num_fields)])


def blocks_of(vectors: DataFrame, sums: Sums, rows_per_block: int, width: int, scale: int, shift: int) -> DataFrame:
    """Blocks (at, matrix): every task cuts its own rows into blocks, padded with zero rows, numbered by task and place."""
    schema = to_arrow_schema(BLOCKS)
    columns = -(-sums.p // width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []

        def block(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            full = np.zeros((rows_per_block, rows.shape[1]))
            full[:len(rows)] = rows
            ends = [*range(0, columns * width, width), columns * width, full.shape[1]]
            for col, (a, b) in enumerate(zip(ends, ends[1:])):
                at = pa.StructArray.from_arrays([pa.array([(task << 32) + count], pa.int64()), pa.array([col], pa.int64())],
                                                fields=list(schema.field("at").type))
                yield pa.RecordBatch.from_arrays([at, _matrix(full[:, a:b], schema.field("matrix").type)], schema=schema)

        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("id").to_pylist()
            y, deviations = centred(integers(batch.column("v"), sums.p, scale, shift), sums)
            flags = np.array([HERE + NO_ID * (i is None) + NO_DEVIATION * (d is None) for i, d in zip(ids, deviations)], float)
            padded = np.zeros((len(y), columns * width))
            padded[:, :sums.p] = y
            held.append(np.column_stack([padded, flags, *_halves(ids), *_halves(deviations)]))
            while sum(map(len, held)) >= rows_per_block:
                rows = np.concatenate(held)
                yield from block(rows[:rows_per_block])
                held, count = [rows[rows_per_block:]], count + 1
        if sum(map(len, held)):
            yield from block(np.concatenate(held))

    return vectors.mapInArrow(cut, BLOCKS)


def _block_matrix(blocks: DataFrame, rows_per_block: int, width: int, n_rows: int, n_cols: int) -> BlockMatrix:
    """A block matrix of the JVM from a table of blocks, without Python objects in between."""
    made = callMLlibFunc("createBlockMatrix", blocks, rows_per_block, width, n_rows, n_cols)
    return BlockMatrix(made, rows_per_block, width, n_rows, n_cols)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int, rows_per_block: int, width: int) -> BlockMatrix:
    """``left.multiply(right)`` with the number of splits along the inner dimension, which the Python class has no argument for."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, rows_per_block, width)


def _dense(cell: pa.StructScalar) -> np.ndarray:
    rows, cols = cell["numRows"].as_py(), cell["numCols"].as_py()
    values = cell["values"].values.to_numpy()
    return values.reshape(rows, cols) if cell["isTransposed"].as_py() else values.reshape(cols, rows).T


def solve(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the scatter over n rows: eigenvalues by falling size, their unit vectors as columns, and the whitening matrix.

    A component whose eigenvalue is zero but for rounding has NaN in its column of the whitening matrix.
    The largest entry of every vector is positive.
    """
    e, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    e, vectors = np.maximum(e[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(e))] < 0, -1, 1)
    flat = e <= max(e.max(initial=0), 0) * len(e) * np.finfo(float).eps
    w = np.where(flat, np.nan, vectors / np.sqrt(np.where(flat, 1, e)))
    return e, vectors, w[:, :components]


def _moments(projected: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the projected rows; every task sends k + k k numbers."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            for cell in batch.column(0):
                z = _dense(cell)
                z = z[z[:, k] > 0, :k]
                total += np.concatenate([z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})

    rows = projected.mapInArrow(partial, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").collect()
    total = np.array([r.v for r in rows])
    return total[:k], total[k:].reshape(k, k)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
           shift: int = SHIFT, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), one for each usable row and component.

    Usable are rows whose vector is there, holds only finite numbers (up to 2^40) and has the most frequent
    length (vectors of no entries have no components).  Components are numbered from 1 by falling variance, ``components`` at
    most.  ``deviation`` is the sum over dimensions of (n x - S)^2, null beyond a long.
    A component without variance has a null ``whitened`` and stays out of
    ``identity_error``; where no vector varies, ``explained`` is null too, and ``identity_error`` where no component does.  Null
    ids stay null; repeated rows count each for itself.  An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    vectors = usable(df, id_col, vector_col)
    sums = sums_of(vectors, scale, shift)
    if sums is None:
        return spark.createDataFrame([], "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    p, k = sums.p, min(components, sums.p)
    width = max(CARRIED, min(p, COLUMNS_PER_BLOCK))
    columns = -(-p // width)
    tall = min(rows_per_block, max(64, -(-sums.n // max(1, vectors.rdd.getNumPartitions()))))
    cut = durable(blocks_of(vectors, sums, tall, width, scale, shift))

    # block numbers from (task, place): tasks are few, places are counted from 0 in each
    last = cut.agg(F.max(F.shiftright("at.row", 32)), F.max(F.col("at.row").bitwiseAND((1 << 32) - 1)), F.count(F.lit(1))).first()
    tasks, places, n_blocks = last[0] + 1, last[1] + 1, last[2] // (columns + 1)
    if tasks * places >= 1 << 31:
        raise ValueError("block matrices hold at most 2^31 blocks: use more rows a block")
    number = F.shiftright("at.row", 32) * places + F.col("at.row").bitwiseAND((1 << 32) - 1)
    placed = cut.select(F.struct(number.alias("row"), F.col("at.col").alias("col")).alias("at"), "matrix")
    n_rows = tasks * places * tall

    y = _block_matrix(placed.filter(F.col("at.col") < columns), tall, width, n_rows, columns * width)
    splits = -(-n_blocks // BLOCKS_PER_TASK)
    scatter = _product(y.transpose(), y, splits, width, width).toLocalMatrix().toArray()[:p, :p]
    e, _, w = solve(scatter, sums.n, components)

    right = np.zeros((columns * width + CARRIED, k + CARRIED))
    right[:p, :k] = np.nan_to_num(w)
    right[columns * width:, k:] = np.eye(CARRIED)
    pieces = [((i, 0), DenseMatrix(len(part), k + CARRIED, part.T.ravel().tolist()))
              for i in range(columns + 1) for part in [right[i * width:(i + 1) * width]]]
    whole = _block_matrix(placed, tall, width, n_rows, columns * width + CARRIED)
    side = _block_matrix(spark.createDataFrame(pieces, BLOCKS), width, k + CARRIED, len(right), k + CARRIED)
    projected = callMLlibFunc("getMatrixBlocks", _product(whole, side, 1, tall, k + CARRIED)._java_matrix_wrapper._java_model).select("_2")

    real = np.flatnonzero(~np.isnan(w).any(0))
    total, squares = _moments(projected, k)
    mean = total / sums.n
    off = np.abs(squares / sums.n - np.outer(mean, mean) - np.eye(k))[np.ix_(real, real)]
    error = float(off.max()) if off.size else None
    return _rows(projected, k, set(real.tolist())).join(
        F.broadcast(_components(spark, e[:k], float(e.sum()), sums.n, error)), "component").select(
        "id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def _components(spark, e: np.ndarray, trace: float, n: int, error: float | None) -> DataFrame:
    """One row for each component: at most ``components`` rows."""
    return spark.createDataFrame([(i + 1, n, float(v) / trace if trace > 0 else None, error) for i, v in enumerate(e)],
                                 "component int, n long, explained double, identity_error double")


def _rows(projected: DataFrame, k: int, real: set[int]) -> DataFrame:
    """The projected blocks as rows (id, component, deviation, whitened); padding is left out."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                z = _dense(cell)
                z = z[z[:, k] > 0]
                flags, high, low, dev_high, dev_low = (z[:, k + i].astype(np.int64) for i in range(CARRIED))
                each = np.repeat(np.arange(len(z)), k)
                component = np.tile(np.arange(k, dtype=np.int32), len(z))
                lost = ~np.isin(component, sorted(real))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((high << 32) + low)[each], mask=((flags & NO_ID) > 0)[each]), pa.array(component + 1),
                     pa.array(((dev_high << 32) + dev_low)[each], mask=((flags & NO_DEVIATION) > 0)[each]),
                     pa.array(z[:, :k].ravel(), mask=lost)], names=["id", "component", "deviation", "whitened"])

    return projected.mapInArrow(take, "id long, component int, deviation long, whitened double")
