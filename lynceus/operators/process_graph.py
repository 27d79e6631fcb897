"""Directly-follows and dependency graphs, heuristics net.

Dependency measures follow Weijters & van der Aalst (heuristics miner).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.ordering import as_list, over_order
from lynceus.session import sized

# Default thresholds of the heuristics miner.
DEPENDENCY_THRESHOLD = 0.5
AND_THRESHOLD = 0.65
MIN_ACTIVITY_COUNT = 10


def frequent_activities(log: DataFrame, activity: str, min_count: int) -> DataFrame:
    return (log.groupBy(activity).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def _followed(log: DataFrame, case: str | Sequence[str], order: str | Sequence[str], activity: str,
              min_count: int) -> DataFrame:
    """(activity, next activity, the one after, first-of-case flag) of the frequent activities."""
    keep = frequent_activities(log, activity, min_count).select(activity)
    rows = (log.join(sized(keep), activity, "left_semi")
            .select(*as_list(case), *[c for c in as_list(order) if c not in as_list(case)],
                    F.col(activity).alias("src")))

    def neighbours(w):
        return {"dst": F.lead("src", 1).over(w), "then": F.lead("src", 2).over(w),
                "prior": F.lag("src", 1).over(w)}

    return over_order(rows, order, neighbours, key=case, back=1, ahead=2)


def directly_follows(log: DataFrame, case: str | Sequence[str], order: str | Sequence[str],
                     activity: str, min_count: int = MIN_ACTIVITY_COUNT) -> DataFrame:
    """Edges (src, dst, freq) between activities that occur at least ``min_count`` times."""
    return (_followed(log, case, order, activity, min_count).filter(F.col("dst").isNotNull())
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("freq")))


def _transition_counts(log, case, order, activity, min_count) -> DataFrame:
    """One pass over the ordered log: counts of a>b, of a>b>a, of starts and of ends."""
    rows = _followed(log, case, order, activity, min_count)
    return rows.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("freq"),
        F.count(F.when((F.col("then") == F.col("src")) & (F.col("dst") != F.col("src")), 1)).alias("loop2"),
        F.count(F.when(F.col("prior").isNull(), 1)).alias("starts"))


def _with_dependency(counts: DataFrame) -> DataFrame:
    edges = counts.filter(F.col("dst").isNotNull()).select("src", "dst", "freq", "loop2")
    mirror = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                          F.col("freq").alias("_back"), F.col("loop2").alias("_loop2"))
    both = edges.join(mirror, ["src", "dst"], "left").na.fill(0, ["_back", "_loop2"])
    f, b = F.col("freq"), F.col("_back")
    loops = F.col("loop2") + F.col("_loop2")
    same = F.col("src") == F.col("dst")
    return both.select(
        "src", "dst", "freq",
        F.when(same, f / (f + 1)).otherwise((f - b) / (f + b + 1)).alias("dependency"),
        F.when(same, F.lit(0.0)).otherwise(loops / (loops + 1)).alias("loop2_dependency"))


def dependency_graph(log: DataFrame, case: str | Sequence[str], order: str | Sequence[str],
                     activity: str, min_count: int = MIN_ACTIVITY_COUNT) -> DataFrame:
    """Edges with frequency, dependency and length-two-loop measure."""
    return _with_dependency(_transition_counts(log, case, order, activity, min_count))


def heuristics_net(log: DataFrame, case: str | Sequence[str], order: str | Sequence[str],
                   activity: str, min_count: int = MIN_ACTIVITY_COUNT,
                   dependency: float = DEPENDENCY_THRESHOLD) -> DataFrame:
    """Net edges (kind, src, dst, freq, dependency): thresholded dependencies, starts and ends."""
    counts = _transition_counts(log, case, order, activity, min_count)
    none = F.lit(None).cast("string")
    edges = (_with_dependency(counts)
             .filter((F.col("dependency") >= dependency) | (F.col("loop2_dependency") >= dependency))
             .select(F.lit("edge").alias("kind"), "src", "dst", "freq", "dependency"))
    starts = (counts.groupBy(F.col("src").alias("dst")).agg(F.sum("starts").alias("freq"))
              .filter(F.col("freq") > 0)
              .select(F.lit("start").alias("kind"), none.alias("src"), "dst", "freq",
                      F.lit(None).cast("double").alias("dependency")))
    ends = (counts.filter(F.col("dst").isNull())
            .select(F.lit("end").alias("kind"), "src", none.alias("dst"), "freq",
                    F.lit(None).cast("double").alias("dependency")))
    return edges.unionByName(starts).unionByName(ends)


def and_splits(log: DataFrame, case: str | Sequence[str], order: str | Sequence[str],
               activity: str, min_count: int = MIN_ACTIVITY_COUNT,
               dependency: float = DEPENDENCY_THRESHOLD, threshold: float = AND_THRESHOLD) -> DataFrame:
    """Parallelism of two successors b, c of a: (b>c + c>b) / (a>b + a>c + 1)."""
    graph = _with_dependency(_transition_counts(log, case, order, activity, min_count))
    kept = graph.filter((F.col("dependency") >= dependency) & (F.col("src") != F.col("dst")))
    b = kept.select("src", F.col("dst").alias("b"), F.col("freq").alias("_ab"))
    c = kept.select("src", F.col("dst").alias("c"), F.col("freq").alias("_ac"))
    siblings = b.join(c, "src").filter("b < c")
    for x, y, name in (("b", "c", "_bc"), ("c", "b", "_cb")):
        one_way = graph.select(F.col("src").alias(x), F.col("dst").alias(y), F.col("freq").alias(name))
        siblings = siblings.join(one_way, [x, y], "left")
    measure = ((F.coalesce("_bc", F.lit(0)) + F.coalesce("_cb", F.lit(0)))
               / (F.col("_ab") + F.col("_ac") + 1))
    return (siblings.select("src", "b", "c", measure.alias("and_measure"))
            .withColumn("is_and", F.col("and_measure") >= threshold))
