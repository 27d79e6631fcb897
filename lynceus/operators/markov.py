"""Markov chain over observed states."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.operators.metrics import label_pairs
from lynceus.operators.ordering import as_list, over_order
from lynceus.session import durable, sized


def _steps(df: DataFrame, state: str, order, key) -> DataFrame:
    return over_order(df, order, lambda w: {"state_from": F.lag(state, 1).over(w)}, key=key, back=1)


def transition_matrix(df: DataFrame, state: str, order: str | Sequence[str],
                      key: str | Sequence[str] | None = None) -> DataFrame:
    """(state_from, state_to, n, p) over all pairs of states, zero cells included."""
    keep = list(dict.fromkeys([*as_list(key), *as_list(order), state]))
    steps = _steps(df.select(*keep), state, order, key)
    counts = (steps.filter(F.col("state_from").isNotNull() & F.col(state).isNotNull())
              .groupBy("state_from", F.col(state).alias("state_to"))
              .agg(F.count(F.lit(1)).alias("n")))
    every = label_pairs(df.select(state).distinct(), "state_from", "state_to")
    cells = every.join(counts, ["state_from", "state_to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # as many rows as pairs of states
    total = F.sum("n").over(Window.partitionBy("state_from"))
    return cells.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def next_states(matrix: DataFrame) -> DataFrame:
    """Most probable next state of every state; ties go to the smallest label."""
    best = matrix.groupBy("state_from").agg(F.max("p").alias("p"))
    return (matrix.join(best, ["state_from", "p"]).groupBy("state_from")
            .agg(F.min("state_to").alias("next_state"), F.max("p").alias("next_p")))


def score_transitions(df: DataFrame, matrix: DataFrame, state: str, order: str | Sequence[str],
                      key: str | Sequence[str] | None = None, min_p: float = 0.05) -> DataFrame:
    """Probability of every observed step, the predicted state, and a flag for rare steps.

    The first row of a sequence has no step; a step out of an unseen state has
    probability 0.
    """
    matrix = durable(matrix)
    rows = _steps(df, state, order, key)
    p = matrix.select("state_from", F.col("state_to").alias(state), F.col("p").alias("_p"))
    guess = next_states(matrix).select("state_from", F.col("next_state").alias("y_pred"))
    # states are few and uneven: a shuffle of the rows by state would put most of them into few tasks
    scored = rows.join(sized(p), ["state_from", state], "left").join(sized(guess), "state_from", "left")
    seen = F.col("state_from").isNotNull()
    return (scored.withColumn("p", F.when(seen, F.coalesce("_p", F.lit(0.0))))
            .withColumn("is_anomaly", F.coalesce(F.col("p") < min_p, F.lit(False))).drop("_p"))


@dataclass
class MarkovChain:
    """Fitted transition matrix that scores the steps of new sequences."""

    matrix: DataFrame
    state: str
    order: list[str]
    key: list[str]
    min_p: float

    @classmethod
    def fit(cls, df: DataFrame, state: str, order: str | Sequence[str],
            key: str | Sequence[str] | None = None, min_p: float = 0.05) -> MarkovChain:
        matrix = durable(transition_matrix(df, state, order, key))
        return cls(matrix, state, as_list(order), as_list(key), min_p)

    def transform(self, df: DataFrame) -> DataFrame:
        return score_transitions(df, self.matrix, self.state, self.order, self.key, self.min_p)
