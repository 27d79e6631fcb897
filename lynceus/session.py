"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "lynceus", master: str | None = None, **conf) -> SparkSession:
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the folder the cluster names in ``spark.checkpoint.dir``.  Only a
    local session may fall back to a temporary folder of the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lynceus-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_STEPS: list[str] = []
#: The list that collects the intermediate tables of the running scope, if any; each thread has its own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def drop_steps(spark: SparkSession, steps: list[str] | None = None) -> None:
    """Delete intermediate tables (all that this process has written outside of scopes, unless given)."""
    steps = _STEPS if steps is None else steps
    hadoop = spark._jvm.org.apache.hadoop.fs
    while steps:
        path = hadoop.Path(steps.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scoped_steps(spark: SparkSession):
    """Intermediate tables written inside are deleted at the end; only for work whose results are stored elsewhere by then."""
    steps: list[str] = []
    token = _SCOPE.set(steps)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        drop_steps(spark, steps)


def durable(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder once and go on from the written table.

    This cuts the lineage like a reliable checkpoint, but computes the rows a
    single time and lets later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = new_folder(spark, "step")
    df.write.parquet(path)
    scope = _SCOPE.get()
    (_STEPS if scope is None else scope).append(path)
    return spark.read.schema(df.schema).parquet(path)


# A derived side that would take more memory than this is never broadcast by a hint.
BROADCAST_BYTES = 64 << 20
# The same for tables whose rows are a few numbers and whose row count is bounded beforehand.
BROADCAST_ROWS = 100_000


def held_bytes(table: DataFrame) -> int:
    """About what a table takes in memory: every row and field, and what texts, lists and the like hold beyond."""
    wide = [F.sum(F.length(F.to_json(F.struct(f.name))) if not isinstance(f.dataType, (T.StringType, T.BinaryType))
                  else F.octet_length(f.name)) for f in table.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    n, *more = table.agg(F.count(F.lit(1)), *wide).first()
    return n * (32 + 8 * len(table.columns)) + sum(x or 0 for x in more)


def sized(table: DataFrame) -> DataFrame:
    """Materialise a derived table and broadcast it when its size in memory proves small.

    Meant for the small side of a join on few, uneven keys (states, activities,
    series statistics), where the optimizer's size guess for a derived table
    would shuffle the large side.  A table beyond ``BROADCAST_BYTES`` is joined
    by shuffle, with adaptive skew handling.
    """
    table = durable(table)
    return F.broadcast(table) if held_bytes(table) <= BROADCAST_BYTES else table


def keep_cached(df: DataFrame, rows_per_task: int = 10_000) -> DataFrame:
    """Persist the input of an iterative algorithm, over enough partitions to use the cores.

    Only data with fewer partitions than cores is spread again; the caller
    unpersists the result.
    """
    cached = df.persist()
    n = cached.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = min(cores, n // rows_per_task)
    if wanted <= cached.rdd.getNumPartitions():
        return cached
    spread = cached.repartition(wanted).persist()
    spread.count()
    cached.unpersist()
    return spread
