"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.session import durable, sized

#: A node of more links than this, or than the share of all links, does not meet its links in one task.
HOT_LINKS, HOT_SHARE = 256, 1 / 500_000


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(links: DataFrame, n_links: int) -> DataFrame:
    """Rows (u, v, m): every link and the smallest end ``m`` among the links of its ``u``.

    Minima are combined before the shuffle.  The minima of hot nodes are broadcast to their
    links: a hot node has more than a fixed share of the links, so there are a million of
    them at most.  The others meet their links by shuffle.
    """
    least = durable(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    bound = max(HOT_LINKS, int(n_links * HOT_SHARE))
    hot = least.filter(F.col("n") > bound).select("u", "m")
    if hot.isEmpty():
        return links.join(least.drop("n"), "u")
    hot = sized(hot)
    rest = links.join(hot, "u", "left_anti").join(least.filter(F.col("n") <= bound).drop("n"), "u")
    return links.join(hot, "u").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root): every node of the links (a, b) and the smallest node that it reaches.

    Links with a null end are no links; repeated links and links of a node with itself add nothing; without links there are no rows.
    Each round links all larger neighbours of a node to its smallest one, then
    all smaller neighbours.  Rounds grow with the logarithm of the table.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    stamp = _stamp(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(_with_least(both, 2 * stamp[0]).filter("v > u")
                        .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        rooted = _with_least(large, stamp[0])
        small = (rooted.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(rooted.select("u", F.col("m").alias("v"))))
        edges, before = durable(small.distinct()), stamp
        stamp = _stamp(edges)
        if stamp == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(roots.select("node", F.col("node").alias("root"))))
