"""Histograms and distances between them, as Column builders over arrays of counts and as NumPy functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(x: Column, low: Column, high: Column, bins: Column) -> Column:
    """Equal-width bin (from 0) of x between low and high; the last bin is closed. Where low = high, bins span half a unit to either side."""
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    start = F.when(high > low, low).otherwise(low - 0.5)
    return F.greatest(F.lit(0), F.least(F.floor((x - start) / width * bins), bins - 1)).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once a row: an expression named inside a lambda would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _shares(counts: Column) -> Column:
    return bound(counts, lambda each: bound(_sum(F.transform(each, lambda c: c.cast("double"))), lambda total: F.transform(each, lambda c: c / total)))


def hellinger(ref: Column, test: Column) -> Column:
    """sqrt of the sum over bins of (sqrt(test share) - sqrt(reference share))^2; between 0 and sqrt(2)."""
    gaps = F.zip_with(_shares(ref), _shares(test), lambda r, t: F.pow(F.sqrt(t) - F.sqrt(r), F.lit(2.0)))
    return F.sqrt(_sum(gaps))


def kullback(p: Column, q: Column) -> Column:
    """Sum of p ln(p / q) over normalised p, q; bins with p = 0 add nothing."""
    terms = F.zip_with(_shares(p), _shares(q), lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0)))
    return _sum(terms)


def jensen_shannon(ref: Column, test: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in natural logarithms."""
    half = lambda a, b: F.when(a > 0, a * F.log(a * 2 / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(_shares(ref), _shares(test), lambda r, t: (half(r, t) + half(t, r)) / 2)
    return F.sqrt(F.greatest(_sum(terms), F.lit(0.0)))


def intersection(ref: Column, test: Column) -> Column:
    """1 - the sum over bins of the smaller share; 0 for equal, 1 for disjoint distributions."""
    return 1 - _sum(F.zip_with(_shares(ref), _shares(test), lambda r, t: F.least(r, t)))


#: Distances by the letters and names that detectors take.
DISTANCES = {"H": hellinger, "KL": jensen_shannon, "intersection": intersection}


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Shares with half a point added to each cell."""
    counts = np.asarray(counts, float)
    return (counts + 0.5) / (counts.sum(-1, keepdims=True) + counts.shape[-1] / 2)


def kullback_np(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Along the last axis, both normalised."""
    p, q = p / p.sum(-1, keepdims=True), q / q.sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log(p / q), 0.0).sum(-1)


def jensen_shannon_np(p: np.ndarray, q: np.ndarray) -> float:
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(np.sqrt(max(0.0, (kullback_np(p, m) + kullback_np(q, m)) / 2)))


def hellinger_np(p: np.ndarray, q: np.ndarray) -> float:
    return float(np.sqrt(((np.sqrt(q / q.sum()) - np.sqrt(p / p.sum())) ** 2).sum()))


def epanechnikov(sample: np.ndarray) -> np.ndarray:
    """Kernel density estimate of a sample at its own points; bandwidth 1.06 s n^(-1/5)."""
    n = len(sample)
    h = 1.06 * sample.std(ddof=1) * n ** (-0.2)
    u = (sample[:, None] - sample[None, :]) / h
    return 0.75 / (h * n) * np.maximum(0.0, 1 - u * u).sum(1)
