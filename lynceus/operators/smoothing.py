"""Exponential smoothing (simple, Holt, Holt-Winters) with a parameter search.

Every series is cut into chunks of consecutive rows.  A one-chunk series is
searched and fitted in one grouped task, all candidates side by side.  In a
longer series the state at each chunk start is found first: the additive
models are affine in their state, so all chunks run at once from a zero state
and the chunk maps are then composed; the multiplicative ones hand the state
from chunk to chunk, one round per chunk of the longest series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.least_squares import with_model
from lynceus.operators.arima import error_limits, score_ahead, with_periods
from lynceus.operators.ordering import as_list, group_sizes, max_rows_per_task, row_index, spread
from lynceus.session import durable

KINDS = (None, "add", "mul")


@dataclass(frozen=True)
class Model:
    trend: str | None
    seasonal: str | None
    m: int

    def __post_init__(self):
        if self.trend not in KINDS or self.seasonal not in KINDS:
            raise ValueError("trend and seasonal are None, 'add' or 'mul'")
        if self.seasonal and self.m < 2:
            raise ValueError("seasonal smoothing needs seasonal_periods of at least 2")

    @property
    def width(self) -> int:
        """State: level, trend, and the next m seasonal terms."""
        return 2 + (self.m if self.seasonal else 0)

    @property
    def warm_up(self) -> int:
        """Rows used up by the start values."""
        return self.m if self.seasonal else 1

    @property
    def affine(self) -> bool:
        return "mul" not in (self.trend, self.seasonal)

    def start(self, y: np.ndarray) -> np.ndarray:
        """State after the warm-up rows, from the first rows of the series."""
        neutral = 1.0 if self.trend == "mul" else 0.0
        if not self.seasonal:
            slope = neutral
            if self.trend and len(y) > 1:
                slope = y[1] / y[0] if self.trend == "mul" else y[1] - y[0]
            return np.array([y[0], slope])
        first = y[:self.m]
        level = first.mean()
        slope = neutral
        if self.trend and len(y) >= 2 * self.m:
            second = y[self.m:2 * self.m].mean()
            slope = (second / level) ** (1 / self.m) if self.trend == "mul" else (second - level) / self.m
        season = first / level if self.seasonal == "mul" else first - level
        return np.concatenate([[level, slope], season])

    def run(self, y: np.ndarray, params: np.ndarray, state: np.ndarray,
            keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Run the recursion for all candidates at once.

        ``params`` (G x 3: alpha, beta, gamma), ``state`` (G x width).  Returns the
        final state, the sum of squared errors, and the fitted values when asked.
        """
        alpha, beta, gamma = params.T
        level, slope = state[:, 0].copy(), state[:, 1].copy()
        season = state[:, 2:].copy()
        at, sse = 0, np.zeros(len(params))
        fitted = np.empty((len(y), len(params))) if keep else None
        for t, value in enumerate(y):
            base = level * slope if self.trend == "mul" else level + slope
            if self.seasonal == "mul":
                s = season[:, at]
                guess = base * s
                new = base + alpha * (value / s - base)
                season[:, at] = s + gamma * (value / base - s)
            elif self.seasonal == "add":
                s = season[:, at]
                guess = base + s
                new = base + alpha * (value - guess)
                season[:, at] = s + gamma * (value - guess)
            else:
                guess = base
                new = base + alpha * (value - guess)
            if self.trend == "mul":
                slope = slope + beta * (new / level - slope)
            elif self.trend == "add":
                slope = slope + beta * (new - level - slope)
            level = new
            at = (at + 1) % self.m if self.seasonal else 0
            sse += (value - guess) ** 2
            if keep:
                fitted[t] = guess
        season = np.roll(season, -at, axis=1) if self.seasonal else season
        return np.column_stack([level, slope, season]), sse, fitted

    def step_map(self, params: np.ndarray) -> np.ndarray:
        """Transition matrix of the affine models for one candidate (state -> next state, y = 0)."""
        d = self.width
        rows, _, _ = self.run(np.zeros(1), np.repeat(params[None], d, axis=0), np.eye(d))
        return rows.T

    def ahead(self, state: np.ndarray, steps: int) -> np.ndarray:
        """Forecast path from one state."""
        h = np.arange(1, steps + 1)
        base = state[0] * state[1] ** h if self.trend == "mul" else state[0] + h * state[1]
        if not self.seasonal:
            return base
        s = state[2:][(h - 1) % self.m]
        return base * s if self.seasonal == "mul" else base + s


def parameter_grid(model: Model, step: float = 0.1) -> np.ndarray:
    inner = np.round(np.arange(step, 1.0, step), 10)
    none = np.zeros(1)
    return np.array(list(product(inner, inner if model.trend else none, inner if model.seasonal else none)))


def refined_grid(model: Model, best: np.ndarray, step: float) -> np.ndarray:
    """Candidates around ``best``, a fifth of the coarse step apart."""
    axes = []
    for value, used in zip(best, (True, model.trend, model.seasonal)):
        around = value + np.arange(-2, 3) * step / 5
        axes.append(np.unique(np.clip(around, 0.01, 0.99)) if used else np.zeros(1))
    return np.array(list(product(*axes)))


@dataclass
class Smoothing:
    """Parameters (key..., alpha, beta, gamma, sse, state) and fitted training rows."""

    model: Model
    key: list[str]
    params: DataFrame
    limits: DataFrame | None  # key..., threshold
    order: str
    y: str
    rows: DataFrame | None = None  # fitted training rows; not stored

    def transform(self, df: DataFrame) -> DataFrame:
        """Score rows that follow the training rows against the forecast, in order."""
        return score_ahead(df, self.forecast, self.limits, self.key, self.order, self.y)

    def forecast(self, periods: int | DataFrame) -> DataFrame:
        """Steps 1..periods ahead per series; ``periods`` may be a table (key..., periods)."""
        model, key = self.model, self.key
        fields = [self.params.schema[k] for k in key]
        schema = T.StructType(fields + [T.StructField("step", T.LongType()),
                                        T.StructField("y_pred", T.DoubleType())])

        def run(batches):
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    n = int(r["periods"])
                    path = model.ahead(np.asarray(r["state"], float), n)
                    yield pd.DataFrame({**{k: [r[k]] * n for k in key}, "step": np.arange(1, n + 1), "y_pred": path})

        return with_periods(self.params.select(*key, "state"), periods, key).mapInPandas(run, schema)


def exp_smoothing(df: DataFrame, trend: str | None = None, seasonal: str | None = None,
                  seasonal_periods: int = 0, key: str | Sequence[str] | None = None, order: str = "ds",
                  y: str = "y", params: Sequence[float] | None = None, step: float = 0.1, k: float = 3.0,
                  chunk: int | None = None) -> Smoothing:
    """Fit the smoothing of every series; ``params`` = (alpha, beta, gamma) skips the search."""
    model = Model(trend, seasonal, seasonal_periods if seasonal else 0)
    key = as_list(key)
    chunk = chunk or max_rows_per_task(df.sparkSession)
    chunk = max(chunk, 2 * model.warm_up + 1)
    rows = df.select(*key, order, F.col(y).cast("double").alias(y)).filter(F.col(y).isNotNull())
    sizes = group_sizes(rows, key)
    if not sizes[1]:
        raise ValueError("the series has no values")
    rows = row_index(rows, order, key=key, name="_i", sizes=sizes)
    rows = rows.withColumn("_chunk", F.floor(F.col("_i") / chunk))
    fixed = None if params is None else np.array([list(params)], float)
    search = _one_chunk if sizes[0] <= chunk else _many_chunks
    fit = search(model, rows, key, order, y, fixed, step, sizes[1])
    fit.limits = error_limits(fit.rows, key, k)
    return fit


def _schemas(rows: DataFrame, key: list[str], order: str, y: str) -> tuple[list, T.StructType]:
    fields = [rows.schema[k] for k in key]
    fit = T.StructType(fields + [
        rows.schema[order], T.StructField(y, T.DoubleType()), T.StructField("y_pred", T.DoubleType()),
        T.StructField("alpha", T.DoubleType()), T.StructField("beta", T.DoubleType()),
        T.StructField("gamma", T.DoubleType()), T.StructField("sse", T.DoubleType()),
        T.StructField("state", T.ArrayType(T.DoubleType()))])
    return fields, fit


def _search(model: Model, y: np.ndarray, fixed, step: float) -> np.ndarray:
    """Best parameters of one series that fits a task: coarse grid, then one refinement."""
    if fixed is not None:
        return fixed[0]
    start = model.start(y)
    rest = y[model.warm_up:]
    best = None
    for grid in (parameter_grid(model, step), None):
        grid = refined_grid(model, best, step) if grid is None else grid
        _, sse, _ = model.run(rest, grid, np.repeat(start[None], len(grid), axis=0))
        best = grid[int(np.nanargmin(sse))] if np.isfinite(sse).any() else grid[0]
    return best


def _one_chunk(model: Model, rows: DataFrame, key, order, y, fixed, step, n_rows: int) -> Smoothing:
    _, fit_schema = _schemas(rows, key, order, y)
    w = model.warm_up

    def fit(data: pa.Table) -> pa.Table:
        data = data.take(np.argsort(data.column("_i").to_numpy(), kind="stable"))
        values = data.column(y).to_numpy()
        n = len(values)
        fitted = np.full(n, np.nan)
        best, last, total = np.full(3, np.nan), None, np.nan
        if n > w:
            best = _search(model, values, fixed, step)
            state, sse, path = model.run(values[w:], best[None], model.start(values)[None], keep=True)
            fitted[w:] = path[:, 0]
            last, total = state[0].tolist(), float(sse[0])
        out = data.select([*key, order, y])
        for name, column in (("y_pred", fitted), ("alpha", np.full(n, best[0])), ("beta", np.full(n, best[1])),
                             ("gamma", np.full(n, best[2])), ("sse", np.full(n, total))):
            out = out.append_column(name, pa.array(column))
        # the final state travels with the last row only
        return out.append_column("state", pa.array([None] * (n - 1) + [last], pa.list_(pa.float64())))

    by = key or ["_chunk"]
    done = durable(spread(rows, by, n_rows).groupBy(*by).applyInArrow(fit, fit_schema))
    params = done.filter("state is not null").select(*key, "alpha", "beta", "gamma", "sse", "state")
    return Smoothing(model, key, params, None, order, y, _errors(done, key, order, y))


def _errors(done: DataFrame, key, order, y) -> DataFrame:
    value = F.nanvl("y_pred", F.lit(None).cast("double"))
    return (done.select(*key, order, y, value.alias("y_pred")).filter(F.col("y_pred").isNotNull())
            .withColumn("error", F.col(y) - F.col("y_pred")))


def _many_chunks(model: Model, rows: DataFrame, key, order, y, fixed, step, n_rows: int) -> Smoothing:
    by = key or ["_one"]
    rows = durable(rows if key else rows.withColumn("_one", F.lit(0)))
    w = model.warm_up
    head = rows.filter(F.col("_i") < 2 * w + 1).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(y).alias("v")))), lambda c: c["v"])
        .alias("_head"))  # the few rows behind the start values

    def candidates(table: DataFrame | None) -> DataFrame:
        """(by..., cand, alpha, beta, gamma): the same coarse grid for all, or refined per series."""
        if table is None:
            grid = fixed if fixed is not None else parameter_grid(model, step)
            cells = F.array(*[F.struct(F.lit(i).alias("cand"), *[F.lit(float(v)).alias(n) for v, n in
                                                                zip(g, ("alpha", "beta", "gamma"))])
                              for i, g in enumerate(grid)])
            return head.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")
        fields = [head.schema[k] for k in by]
        schema = T.StructType(fields + T.StructType.fromDDL(
            "cand int, alpha double, beta double, gamma double").fields)

        def refine(batches):
            for pdf in batches:
                out = [[*[r[k] for k in by], i, *map(float, g)] for r in pdf.to_dict("records")
                       for i, g in enumerate(refined_grid(model, np.array(
                           [r["alpha"], r["beta"], r["gamma"]]), step))]
                yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

        return table.select(*by, "alpha", "beta", "gamma").mapInPandas(refine, schema)

    def best_of(table: DataFrame) -> DataFrame:
        states = _chunk_states(model, rows, head, candidates(table), by, y)
        sums = _chunk_runs(model, rows, states, by, order, y, keep=False)
        total = sums.groupBy(*by, "cand", "alpha", "beta", "gamma").agg(F.sum("sse").alias("sse"))
        rank = F.struct(F.when(F.isnan("sse"), F.lit(float("inf"))).otherwise(F.col("sse")).alias("sse"),
                        "cand", "alpha", "beta", "gamma")
        return durable(total.groupBy(*by).agg(F.min(rank).alias("_b")).select(*by, "_b.*"))

    best = best_of(None)
    if fixed is None:
        best = best_of(best)
    states = _chunk_states(model, rows, head, best.select(*by, "cand", "alpha", "beta", "gamma"), by, y)
    done = durable(_chunk_runs(model, rows, states, by, order, y, keep=True))
    last = done.filter("state is not null").groupBy(*by).agg(F.max_by("state", "_chunk").alias("state"))
    params = best.join(last, by).select(*key, "alpha", "beta", "gamma", "sse", "state")
    return Smoothing(model, key, params, None, order, y, _errors(done, key, order, y))


STATE = "cand int, alpha double, beta double, gamma double, state array<double>"


def _grouped(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    params = pdf[["alpha", "beta", "gamma"]].to_numpy(float)
    return params, (np.stack(pdf["state"].to_numpy()) if "state" in pdf else None)


def _chunk_states(model: Model, rows: DataFrame, head: DataFrame, cands: DataFrame, by, y) -> DataFrame:
    """State at the start of every chunk per candidate (after the warm-up in chunk 0)."""
    fields = [rows.schema[k] for k in by]
    chunk_field = T.StructField("_chunk", T.LongType())
    out_schema = T.StructType(fields + [chunk_field] + T.StructType.fromDDL(STATE).fields)
    names = [f.name for f in out_schema.fields]
    w = model.warm_up
    start_fields = T.StructType(fields + T.StructType.fromDDL(STATE).fields)

    def begin(batches):
        for pdf in batches:
            out = [[*[r[k] for k in by], r["cand"], r["alpha"], r["beta"], r["gamma"],
                    model.start(np.asarray(r["_head"], float)).tolist()] for r in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=[f.name for f in start_fields.fields])

    starts = durable(cands.join(head, by).mapInPandas(begin, start_fields))

    def end_states(key: tuple, data: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        """Candidates' states at the end of one chunk."""
        if data.empty or cand.empty:
            return pd.DataFrame(columns=names)
        data = data.sort_values("_i")
        values = data[y].to_numpy(float)
        number = int(data["_chunk"].iloc[0])
        params, state = _grouped(cand)
        if number == 0:
            values = values[w:]
        end, _, _ = model.run(values, params, state)
        out = cand[[*by, "cand", "alpha", "beta", "gamma"]].copy()
        out["_chunk"] = number + 1
        out["state"] = list(end)
        return out[names]

    if not model.affine:
        states = starts.withColumn("_chunk", F.lit(0).cast("long")).select(*names)
        every = states
        for number in range(rows.agg(F.max("_chunk")).first()[0]):
            here = rows.filter(F.col("_chunk") == number)
            states = durable(here.groupBy(*by).cogroup(states.groupBy(*by)).applyInPandas(end_states, out_schema))
            every = every.unionByName(states)
        more = rows.select(*by, "_chunk").distinct()
        return durable(every.join(more, [*by, "_chunk"], "left_semi"))

    chunks = rows.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_len"))
    zero = F.when(F.col("_chunk") == 0, F.col("state")).otherwise(
        F.array_repeat(F.lit(0.0), model.width))
    asked = durable(chunks.join(starts, by).withColumn("state", zero).drop("_len"))
    pieces = durable(rows.groupBy(*by, "_chunk").cogroup(asked.groupBy(*by, "_chunk"))
                     .applyInPandas(end_states, out_schema))
    with_length = pieces.join(chunks.select(*by, (F.col("_chunk") + 1).alias("_chunk"), "_len"), [*by, "_chunk"])

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per chunk of one series and candidate: chain the chunk maps."""
        pdf = pdf.sort_values("_chunk")
        params, ends = _grouped(pdf)
        move = model.step_map(params[0])
        powers: dict[int, np.ndarray] = {}
        state = ends[0]
        out = [state]
        for length, shift in zip(pdf["_len"].to_numpy()[1:], ends[1:]):
            if length not in powers:
                powers[length] = np.linalg.matrix_power(move, int(length))
            state = powers[length] @ state + shift
            out.append(state)
        pdf = pdf[[*by, "_chunk", "cand", "alpha", "beta", "gamma"]].copy()
        pdf["state"] = out
        return pdf[names]

    chained = with_length.groupBy(*by, "cand").applyInPandas(compose, out_schema)
    firsts = starts.withColumn("_chunk", F.lit(0).cast("long")).select(*names)
    # the state after the last chunk starts no chunk
    return durable(firsts.unionByName(chained).join(chunks.select(*by, "_chunk"), [*by, "_chunk"], "left_semi"))


def _chunk_runs(model: Model, rows: DataFrame, states: DataFrame, by, order, y, keep: bool) -> DataFrame:
    """Run every chunk from its start state: errors per candidate, or fitted rows of the only one."""
    fields = [rows.schema[k] for k in by]
    w = model.warm_up
    if keep:
        ddl = T.StructType(fields + [T.StructField("_chunk", T.LongType()), rows.schema[order],
                                     T.StructField(y, T.DoubleType()), T.StructField("y_pred", T.DoubleType()),
                                     T.StructField("state", T.ArrayType(T.DoubleType()))])
    else:
        ddl = T.StructType(fields + T.StructType.fromDDL(
            "cand int, alpha double, beta double, gamma double, sse double").fields)
    names = [f.name for f in ddl.fields]

    def run(key: tuple, data: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        if data.empty or cand.empty:
            return pd.DataFrame(columns=names)
        data = data.sort_values("_i")
        values = data[y].to_numpy(float)
        skip = w if int(data["_chunk"].iloc[0]) == 0 else 0
        params, state = _grouped(cand)
        end, sse, fitted = model.run(values[skip:], params, state, keep=keep)
        if keep:
            out = data[[*by, "_chunk", order, y]].copy()
            out["y_pred"] = np.concatenate([np.full(skip, np.nan), fitted[:, 0]])
            out["state"] = [None] * (len(out) - 1) + [end[0].tolist()]
            return out[names]
        out = cand[[*by, "cand", "alpha", "beta", "gamma"]].copy()
        out["sse"] = sse
        return out[names]

    return (rows.groupBy(*by, "_chunk").cogroup(states.groupBy(*by, "_chunk"))
            .applyInPandas(run, ddl))


def smoothing_anomalies(df: DataFrame, **options) -> DataFrame:
    """Fitted values flagged by the sigma rule, with one threshold per series."""
    fit = exp_smoothing(df, **options)
    rows = with_model(fit.rows, fit.limits, fit.key, ["threshold"])
    return rows.withColumns({"score": F.abs("error"), "is_anomaly": F.abs("error") > F.col("threshold")})


def ses(df: DataFrame, alpha: float, key: str | Sequence[str] | None = None, order: str = "ds",
        y: str = "y", chunk: int | None = None) -> DataFrame:
    """Simple smoothing with a given alpha: one-step fitted values from the second row on."""
    return exp_smoothing(df, key=key, order=order, y=y, params=(alpha, 0.0, 0.0), chunk=chunk).rows
