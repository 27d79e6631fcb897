"""Models by family and name.

Each entry is a function ``fit(df, layout, params)`` that returns a fitted
model with ``transform``, or, for process mining, a dict of report tables.
``layout`` carries the column roles found by the experiment's setup.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators import (arima, bayes_net, density, eventlog, hidden_markov, isolation_forest, itemsets,
                               markov, multivariate, naive_bayes, process_graph, sequences, smoothing, top_rules,
                               trees, trend_season, windows)
from lynceus.plans.params import names_of, translate


@dataclass
class Layout:
    """Column roles of an experiment's table."""

    family: str
    features: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    target: str | None = None
    case: str | None = None
    activity: str | None = None


Fit = Callable[[DataFrame, Layout, dict], object]
MODELS: dict[str, dict[str, Fit]] = {"detection": {}, "isolation": {}, "series": {}, "mining": {}}


def register(family: str, name: str, *takes: Callable, more: tuple[str, ...] = ()):
    """Add a model under a name: ``@register("detection", "mine")``.

    ``takes`` are the functions whose optional parameters a configuration may
    set, besides ``more``; without them every parameter is handed on as it is.
    """
    if family not in MODELS:
        raise ValueError(f"unknown family {family!r}; known: {sorted(MODELS)}")
    known = names_of(*takes) | set(more)

    def add(fit: Fit) -> Fit:
        def named(df: DataFrame, layout: Layout, params: dict) -> object:
            return fit(df, layout, translate(family, name, params, known) if known else dict(params or {}))

        MODELS[family][name] = named
        return fit
    return add


def get(family: str, name: str) -> Fit:
    if family not in MODELS:
        raise ValueError(f"unknown family {family!r}; known: {sorted(MODELS)}")
    if name not in MODELS[family]:
        raise ValueError(f"unknown {family} model {name!r}; known: {sorted(MODELS[family])}")
    return MODELS[family][name]


# --- detection ----------------------------------------------------------------------------------

@register("detection", "dbscan", density.DensityOutliers.fit)
def _dbscan(df, layout, params):
    return density.DensityOutliers.fit(df, layout.features, **params)


@register("detection", "ee", multivariate.EllipticEnvelope.fit)
def _envelope(df, layout, params):
    return multivariate.EllipticEnvelope.fit(df, layout.features, **params)


@register("detection", "iforest", isolation_forest.IsolationForest.fit)
def _forest_outliers(df, layout, params):
    return isolation_forest.IsolationForest.fit(df, layout.features, **params)


@register("detection", "pca", multivariate.PcaMonitor.fit)
def _pca(df, layout, params):
    return multivariate.PcaMonitor.fit(df, layout.features, **params)


# --- isolation ----------------------------------------------------------------------------------

@register("isolation", "dt", trees.fit_tree)
def _tree(df, layout, params):
    return trees.fit_tree(df, layout.features, layout.target, **params)


@register("isolation", "rf", trees.fit_forest)
def _forest(df, layout, params):
    return trees.fit_forest(df, layout.features, layout.target, **params)


@register("isolation", "nb", naive_bayes.GaussianNB.fit)
def _bayes(df, layout, params):
    return naive_bayes.GaussianNB.fit(df, layout.features, layout.target, **params)


@register("isolation", "bn", bayes_net.BayesNet.fit)
def _network(df, layout, params):
    return bayes_net.BayesNet.fit(df, layout.features, layout.target, **params)


@register("isolation", "hmm", hidden_markov.HiddenMarkov.fit)
def _hidden(df, layout, params):
    options = {"n_states": df.select(layout.target).distinct().count(), **params}
    return hidden_markov.HiddenMarkov.fit(df, layout.features, order=layout.order, key=layout.key,
                                          target=layout.target, **options)


@register("isolation", "mc", markov.MarkovChain.fit)
def _chain(df, layout, params):
    return markov.MarkovChain.fit(df, layout.target, layout.order, layout.key, **params)


# --- series -------------------------------------------------------------------------------------

@register("series", "ae", windows.WindowReconstruction.fit)
def _reconstruction(df, layout, params):
    return windows.WindowReconstruction.fit(df, key=layout.key, **params)


@register("series", "lstm", windows.LagForecaster.fit)
def _lagged(df, layout, params):
    return windows.LagForecaster.fit(df, key=layout.key, **params)


@register("series", "prophet", trend_season.TrendSeason.fit, more=("periods", "forecast_window"))
def _trend_season(df, layout, params):
    # how far ahead a run forecasts is read by the experiment, not by the fit
    options = {k: v for k, v in params.items() if k not in ("periods", "forecast_window")}
    return trend_season.TrendSeason.fit(df, key=layout.key, **options)


@register("series", "ssa", windows.Ssa.fit)
def _spectrum(df, layout, params):
    return windows.Ssa.fit(df, key=layout.key, **params)


@register("series", "arima", arima.fit_arima)
def _arima(df, layout, params):
    return arima.fit_arima(df, key=layout.key, **params)


@register("series", "es", smoothing.exp_smoothing)
def _smoothing(df, layout, params):
    return smoothing.exp_smoothing(df, key=layout.key, **params)


# --- mining -------------------------------------------------------------------------------------

def _baskets(df: DataFrame, layout: Layout) -> DataFrame:
    # distinct activities only: a basket never exceeds the number of activities
    return df.groupBy(layout.case).agg(F.collect_set(layout.activity).alias("items"))


@register("mining", "apriori", more=("min_support", "min_conf", "min_len", "max_len"))
def _apriori(df, layout, params):
    p = {"min_support": 0.1, "min_conf": 0.1, "min_len": 1, "max_len": None, **params}
    sets = itemsets.frequent_itemsets(_baskets(df, layout), "items", p["min_support"], 1, p["max_len"])
    rules = itemsets.association_rules(sets, p["min_conf"])
    return {"rules": itemsets.rule_text(rules), "association_rules": itemsets.rule_edges(rules),
            "itemsets": sets.filter(F.size("items") >= p["min_len"])}


@register("mining", "topk", more=("k", "min_conf"))
def _top_rules(df, layout, params):
    p = {"k": 10, "min_conf": 0.8, **params}
    rules = top_rules.best_rules(_baskets(df, layout), "items", p["k"], p["min_conf"])
    return {"rules": rules, "association_rules": itemsets.rule_edges(rules)}


@register("mining", "cmspam", sequences.sequential_patterns)
def _patterns(df, layout, params):
    log = eventlog.order_log(df, layout.case, layout.order)
    return {"patterns": sequences.sequential_patterns(log, layout.case, "event_idx", layout.activity, **params)}


@register("mining", "heuristics", process_graph.heuristics_net)
def _heuristics(df, layout, params):
    log = (df, layout.case, layout.order, layout.activity)
    return {"net": process_graph.heuristics_net(*log, **params),
            "dependency": process_graph.dependency_graph(*log, **{k: v for k, v in params.items()
                                                                  if k == "min_count"})}
