"""Frequent itemsets and association rules."""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.session import durable

KEY_MARK = "\u0001"


def frequent_itemsets(baskets: DataFrame, items: str, min_support: float, min_len: int = 1,
                      max_len: int | None = None) -> DataFrame:
    """(items sorted, support count) of the itemsets in at least min_support * n baskets; none where no basket has items."""
    every = durable(baskets.select(F.array_distinct(items).alias("items")))
    n, n_sets = every.agg(F.count(F.lit(1)), F.count(F.when(F.size("items") > 0, 1))).first()
    sets = every.filter(F.size("items") > 0)
    # FPGrowth compares counts with share * n; the basket total includes empty baskets
    wanted = ceil(min_support * n - 1e-9)
    if not n_sets:
        return sets.select("items", F.lit(0).cast("long").alias("support")).limit(0)
    share = min(1.0, max(0.0, (wanted - 0.5) / n_sets))
    found = FPGrowth(itemsCol="items", minSupport=share).fit(sets).freqItemsets
    size = F.size("items")
    keep = size >= min_len
    if max_len:
        keep = keep & (size <= max_len)
    return found.filter(keep).select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))


def association_rules(itemsets: DataFrame, min_conf: float) -> DataFrame:
    """Rules with consequents of any size: (antecedent, consequent, support, confidence).

    ``itemsets`` must hold every frequent set up to the longest rule.
    Consequents grow by one item a step, and only where confidence suffices: a
    larger consequent of the same set can't have more.
    """
    text = lambda c: F.array_join(c, KEY_MARK)
    longest = itemsets.agg(F.max(F.size("items"))).first()[0] or 0
    known = durable(itemsets.select(text("items").alias("_key"), F.col("support").alias("_base")))
    empty = F.array().cast("array<int>")
    grown = itemsets.filter(F.size("items") > 1).select("items", "support", empty.alias("_picked"))
    rules = None
    for step in range(1, max(longest, 2)):
        # places after the last picked one, so that each consequent is reached once
        first = F.coalesce(F.element_at("_picked", -1) + 1, F.lit(0)) if step > 1 else F.lit(0)
        later = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: i >= first)
        grown = (grown.filter(F.size("items") > step).select("items", "support", "_picked", F.explode(later).alias("_next"))
                 .select("items", "support", F.concat("_picked", F.array("_next")).alias("_picked"))
                 .withColumn("antecedent", F.filter("items", lambda x, i: ~F.array_contains("_picked", i)))
                 .withColumn("_key", text("antecedent")).join(known, "_key")
                 .withColumn("confidence", F.col("support") / F.col("_base")).filter(F.col("confidence") >= min_conf)
                 .select("items", "support", "_picked", "antecedent", "confidence"))
        if longest > 4:
            grown = durable(grown)
            if grown.isEmpty():
                break
        found = grown.select("antecedent", F.filter("items", lambda x, i: F.array_contains("_picked", i)).alias("consequent"),
                             "support", "confidence")
        rules = found if rules is None else rules.unionByName(found)
    return rules if rules is not None else found_nothing(itemsets)


def found_nothing(itemsets: DataFrame) -> DataFrame:
    return itemsets.filter(F.lit(False)).select(
        F.col("items").alias("antecedent"), F.col("items").alias("consequent"), "support",
        F.lit(None).cast("double").alias("confidence"))


def rule_text(rules: DataFrame) -> DataFrame:
    arrow = F.concat(F.array_join("antecedent", " "), F.lit(" ==> "), F.array_join("consequent", " "))
    return rules.withColumn("rule", arrow)


def top_k_rules(rules: DataFrame, k: int = 10, min_conf: float = 0.8) -> DataFrame:
    """The k rules of highest support (then confidence, then text) with enough confidence."""
    return (rule_text(rules.filter(F.col("confidence") >= min_conf))
            .orderBy(F.col("support").desc(), F.col("confidence").desc(), "rule").limit(k))


def rule_edges(rules: DataFrame) -> DataFrame:
    """Network of rules: one edge from each antecedent node to each consequent node."""
    return rules.select(F.array_join("antecedent", " ").alias("src"),
                        F.array_join("consequent", " ").alias("dst"), "support", "confidence")
