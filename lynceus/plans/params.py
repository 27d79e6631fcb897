"""Parameter names of run configurations, by model, and what they mean here.

A value may be a new name, a function of the value that gives parameters, or
None for what a distributed fit has no use for (network layouts, solver batches).
Empty values stand for the default.  A name that is neither listed nor a
parameter of the model is refused.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping


def share(value) -> float:
    """"10%" or 0.1."""
    if isinstance(value, str) and value.strip().endswith("%"):
        return float(value.strip()[:-1]) / 100
    return float(value)


def _supported(value) -> dict:
    return {"min_support": share(value)}


def _confident(value) -> dict:
    return {"min_conf": share(value)}


def _not_seasonal(value) -> dict:
    if value:
        raise ValueError("seasonal terms are not part of this ARIMA; give a seasonal model (es, prophet) instead")
    return {}


def _diagonal(value) -> dict:
    if value != "diag":
        raise ValueError(f"covariance_type {value!r}: states have diagonal covariances")
    return {}


_NETWORK = dict.fromkeys(("layer_no", "epoch_no", "batch_size", "shuffle", "neuron_no_enc", "neuron_no_dec", "act_enc", "act_dec",
                          "cell_no", "patience"))

#: The names of the shipped configurations.
NAMES: dict[tuple[str, str], Mapping[str, str | Callable[[object], dict] | None]] = {
    ("detection", "iforest"): {"n_estimators": "n_trees", "random_state": "seed"},
    ("isolation", "hmm"): {"covariance_type": _diagonal},
    ("series", "arima"): {"seasonal": _not_seasonal, "threshold_for_anomaly": "k"},
    ("series", "es"): {"threshold_for_anomaly": "k", "freq": None},
    ("series", "ssa"): {"window_size": "window", "lower_frequency_bound": "f_bound", "lower_frequency_contribution": "contribution",
                        "threshold": "k"},
    ("series", "prophet"): {},
    ("series", "ae"): {**_NETWORK, "threshold_for_anomaly": "k"},
    ("series", "lstm"): {**_NETWORK, "threshold_for_anomaly": "k", "seq_length": "lags"},
    ("mining", "apriori"): {"minsup": _supported, "min_conf": _confident},
    ("mining", "cmspam"): {"minsup": _supported, "req_items": "required"},
    ("mining", "topk"): {"minconf_ar": _confident},
    ("mining", "heuristics"): {"mac": "min_count"},
}


def translate(family: str, model: str, given: Mapping | None, known: set[str]) -> dict:
    """The parameters of a configuration as those of the model; ``known`` are the names it takes itself."""
    names, out = NAMES.get((family, model), {}), {}
    unknown = sorted(k for k in given or {} if k not in names and k not in known)
    if unknown:
        raise ValueError(f"unknown parameters {unknown} of {family} model {model!r}; known: {sorted(known | set(names))}")
    for name, value in (given or {}).items():
        if value is None:
            continue
        to = names.get(name, name)
        if callable(to):
            out |= to(value)
        elif to is not None:
            out[to] = value
    return out


def names_of(*functions: Callable) -> set[str]:
    """The optional parameters of functions, without the roles that an experiment's layout fills."""
    roles = {"df", "cols", "target", "key", "order", "y", "log", "case", "activity", "events", "seq", "pos", "item"}
    return {p.name for f in functions for p in inspect.signature(f).parameters.values() if p.name not in roles}
