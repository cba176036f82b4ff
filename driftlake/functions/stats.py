"""Quantiles of the normal and of Student's distribution."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float, mean: float = 0.0, sd: float = 1.0) -> float:
    """mean + sd * z(p); sd may be 0."""
    return mean + sd * NormalDist().inv_cdf(p)


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 1 - NormalDist().cdf(z)


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards by the recurrence of its convergents."""
    below, above = 1.0, 1.0
    out = below
    num_0, den_0, num_1, den_1 = 1.0, 0.0, 1.0, 1.0
    for m in range(1, 400):
        half = m // 2
        if m % 2:
            c = -(a + half) * (a + b + half) * x / ((a + 2 * half) * (a + 2 * half + 1))
        else:
            c = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        num_0, num_1 = num_1, num_1 + c * num_0
        den_0, den_1 = den_1, den_1 + c * den_0
        num_0, num_1, den_0, den_1 = num_0 / den_1, num_1 / den_1, den_0 / den_1, 1.0
        if abs(num_1 - out) < 1e-15 * abs(num_1):
            return num_1
        out = num_1
    return out


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front / (a * _beta_fraction(x, a, b))
    return 1 - front / (b * _beta_fraction(1 - x, b, a))


def t_cdf(t: float, df: float) -> float:
    tail = incomplete_beta(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """The t at which Student's distribution reaches p, by bisection."""
    if not 0 < p < 1 or df <= 0:
        raise ValueError("p must be between 0 and 1, df positive")
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 2.0
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if t_cdf(mid, df) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
