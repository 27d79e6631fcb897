"""Quantiles of the normal and chi-square distributions (driver-side scalars)."""

from __future__ import annotations

from math import exp, lgamma, log
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_cdf(x: float, df: float) -> float:
    """Regularised lower incomplete gamma function P(df/2, x/2), by its power series."""
    if x <= 0:
        return 0.0
    a, t = df / 2.0, x / 2.0
    if t > a + 1000 + 40 * a ** 0.5:
        return 1.0
    term = total = 1.0 / a
    k = 0
    while term > total * 1e-17:
        k += 1
        term *= t / (a + k)
        total += term
    return min(1.0, total * exp(a * log(t) - t - lgamma(a)))


def chi2_quantile(p: float, df: float) -> float:
    low, high = 0.0, max(1.0, df)
    while chi2_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if chi2_cdf(mid, df) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
