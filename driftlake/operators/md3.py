"""Margin density: a linear classifier, its margin, and the statistics of a reference by cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions.hashrng import uniform, uniform_of
from driftlake.operators.inject import with_index


class Linear(NamedTuple):
    """w . x + b > 0 stands for label 1."""

    weights: tuple[float, ...]
    bias: float


def fit_linear(df: DataFrame, features: Sequence[str], label: str, **params) -> Linear:
    """A linear support vector machine, learnt in Spark. One class only: that class, always."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    seen = sorted(r[0] for r in df.select(F.col(label).cast("int")).distinct().limit(3).collect())
    if len(seen) < 2:
        return Linear((0.0,) * len(features), 1.0 if seen == [1] else -1.0)
    rows = VectorAssembler(inputCols=list(features), outputCol="v_").transform(df.select(*features, F.col(label).cast("double").alias("y_"))).select("v_", "y_")
    model = LinearSVC(featuresCol="v_", labelCol="y_", **params).fit(rows)
    return Linear(tuple(float(w) for w in model.coefficients), float(model.intercept))


def decision(model: Linear, features: Sequence[str]) -> Column:
    out = F.lit(model.bias)
    for w, f in zip(model.weights, features, strict=True):
        out = out + F.lit(w) * F.col(f)
    return out


def predicted(model: Linear, features: Sequence[str]) -> Column:
    return (decision(model, features) > 0).cast("int")


#: functional, scaled or a function of the model and the names of the features.
Margin = str | Callable[[Linear, Sequence[str]], Column]


def _shown(model: Linear, mode: str) -> Linear:
    """The linear function whose values from -1 to 1 are the margin."""
    if mode == "functional":
        return model
    if mode != "scaled":
        raise ValueError(f"no margin of the name {mode}")
    if len(model.weights) < 2:
        raise ValueError("a scaled margin needs two features")
    second = model.weights[1]
    return model._replace(bias=model.bias / second if second else 0.0)


def inside_margin(model: Linear, features: Sequence[str], mode: Margin = "scaled") -> Column:
    """1 if a row lies in the margin. scaled: |w . x + b / w[1]| <= 1, which needs two features; functional: |w . x + b| <= 1."""
    if callable(mode):
        return mode(model, features).cast("int")
    return (F.abs(decision(_shown(model, mode), features)) <= 1).cast("int")


def fit_local(xs: Sequence[Sequence[float]], ys: Sequence[int], reg: float = 0.01, steps: int = 30) -> Linear:
    """A linear support vector machine (squared hinge, Newton steps) of a few rows, such as those of an oracle round. One class only: that class."""
    x, t = np.asarray(xs, float), np.where(np.asarray(ys) > 0, 1.0, -1.0)
    if len(set(t)) < 2:
        return Linear((0.0,) * x.shape[1], float(t[0]))
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([reg] * (x.shape[1] - 1) + [1e-9])
    v = np.zeros(x.shape[1])
    for _ in range(steps):
        near = t * (x @ v) < 1
        slope = ridge @ v - 2 / len(x) * x[near].T @ (t[near] - x[near] @ v)
        step = np.linalg.solve(ridge + 2 / len(x) * x[near].T @ x[near], slope)
        v = v - step
        if np.abs(step).max() < 1e-9:
            break
    return Linear(tuple(v[:-1].tolist()), float(v[-1]))


def scorer(model: Linear, mode: str = "scaled") -> Callable[[Sequence[float]], tuple[int, int]]:
    """x to (inside the margin, label), as inside_margin() and predicted() say for rows."""
    value = lambda m, x: sum(w * v for w, v in zip(m.weights, x, strict=True)) + m.bias
    shown = _shown(model, mode)
    return lambda x: (int(abs(value(shown, x)) <= 1), int(value(model, x) > 0))


def reference_statistics(df: DataFrame, features: Sequence[str], label: str, k: int = 10, seed: int = 42, fit: Callable[[DataFrame], Linear] | None = None, mode: Margin = "scaled", id_col: str | None = None) -> dict[str, float]:
    """length, md, md_std, acc, acc_std over k folds (population deviations): share inside the margin and accuracy on each fold of a model learnt from the others.

    Folds are k equal parts of a hash order of the rows (of id_col, if given), numbered in parallel. The rows are written once and read k times.
    """
    fit = fit or (lambda part: fit_linear(part, features, label))
    key = [F.col(id_col)] if id_col else [F.col(c) for c in (*features, label)]
    n = df.count()
    if n < k:
        raise ValueError("fewer rows than folds")
    ranked = df.withColumn("turn_", uniform(seed, *key))
    order = ["turn_", *([id_col] if id_col else [*features, label])]
    folds = with_index(ranked, order, "at_").withColumn("fold_", F.floor(F.col("at_") * k / n).cast("int") + 1)
    found = []
    for fold in range(1, k + 1):
        model = fit(folds.where(F.col("fold_") != fold))
        right = (predicted(model, features) == F.col(label).cast("int")).cast("int")
        found.append(folds.where(F.col("fold_") == fold).agg(F.avg(inside_margin(model, features, mode)), F.avg(right)).first())
    md, acc = ([float(r[i]) for r in found if r[i] is not None] for i in (0, 1))
    mean = lambda v: sum(v) / len(v)
    sd = lambda v: (sum((x - mean(v)) ** 2 for x in v) / len(v)) ** 0.5
    return {"length": n, "md": mean(md), "md_std": sd(md), "acc": mean(acc), "acc_std": sd(acc)}


def folds_of(n: int, k: int, seed: int = 42) -> list[list[int]]:
    """The numbers 0 to n - 1 in k equal parts of a hash order, in n parts if there are fewer than k."""
    order = sorted(range(n), key=lambda i: (uniform_of(seed, i), i))
    k = min(k, n)
    return [order[n * i // k : n * (i + 1) // k] for i in range(k)]


def fold_moments(inside: Sequence[Sequence[float]], right: Sequence[Sequence[float]]) -> dict[str, float]:
    """md, md_std, acc, acc_std (population deviations) of the folds' values."""
    mean = lambda v: sum(v) / len(v)
    md, acc = ([mean(part) for part in parts] for parts in (inside, right))
    sd = lambda v: (sum((x - mean(v)) ** 2 for x in v) / len(v)) ** 0.5
    return {"md": mean(md), "md_std": sd(md), "acc": mean(acc), "acc_std": sd(acc)}


def scored_statistics(rows: Sequence[Sequence], k: int = 10, seed: int = 42) -> dict[str, float]:
    """Statistics over k folds of rows (inside, right) of a classifier that has nothing to learn."""
    parts = folds_of(len(rows), k, seed)
    return fold_moments([[float(rows[i][0]) for i in p] for p in parts], [[float(rows[i][1]) for i in p] for p in parts])


def refit_statistics(rows: Sequence[Sequence], fit: Callable[[list, list], Callable], k: int = 10, seed: int = 42) -> dict[str, float]:
    """Statistics over k folds of rows (inside, right, x, y), at least two: fit(xs, ys) learns from the other folds and gives score(x) -> (inside, label)."""
    if len(rows) < 2:
        raise ValueError("fewer than two rows")
    inside, right = [], []
    for part in folds_of(len(rows), k, seed):
        rest = [r for i, r in enumerate(rows) if i not in set(part)]
        score = fit([r[2] for r in rest], [r[3] for r in rest])
        found = [(score(rows[i][2]), rows[i][3]) for i in part]
        inside.append([float(s[0]) for s, _ in found])
        right.append([float(s[1] == y) for s, y in found])
    return fold_moments(inside, right)
