"""Monitors of a classifier's performance: they see labels and predictions, or a score beside a margin."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.hashrng import uniform_of
from driftlake.operators import md3
from driftlake.operators.change import Adwin
from driftlake.operators.fold import Detector, run_fold

LABELS = ("y_true", "y_pred")


class AdwinAccuracy(Adwin):
    """Adwin over 1 for each right prediction, 0 for each wrong one."""

    inputs = LABELS

    def observe(self, s, y_true, y_pred):
        super().observe(s, float(y_true == y_pred))


def _spread(sd: float, x: float, mean: float, before: float, n: int, mode: str) -> float:
    """Running deviation. recursive: the root itself is fed back, as in the detectors' usual form; welford: sd holds the sum of squares."""
    return math.sqrt(max(0.0, sd + (x - mean) * (x - before)) / n) if mode == "recursive" else sd + (x - mean) * (x - before)


class Ddm(Detector):
    """Error rate p and its deviation s against their least sum: warning and drift at p + s >= p_min + scale * s, from row n_threshold on."""

    inputs = LABELS
    extra = "error_rate double, error_std double"

    def __init__(self, n_threshold: int = 30, warning_scale: float = 2, drift_scale: float = 3, std_mode: str = "recursive"):
        self.n_threshold, self.warning_scale, self.drift_scale, self.std_mode = n_threshold, warning_scale, drift_scale, std_mode

    def epoch(self):
        return {"p": 0.0, "s": 0.0, "raw": 0.0, "p_min": math.inf, "s_min": math.inf}

    def observe(self, s, y_true, y_pred):
        n, e, before = s["since"], float(y_true != y_pred), s["p"]
        s["p"] = before + (e - before) / n
        s["raw"] = _spread(s["raw"], e, s["p"], before, n, self.std_mode)
        s["s"] = s["raw"] if self.std_mode == "recursive" else math.sqrt(s["raw"] / n)
        if n < self.n_threshold:
            return
        level = s["p"] + s["s"]
        if level <= s["p_min"] + s["s_min"]:
            s["p_min"], s["s_min"] = s["p"], s["s"]
        reached = lambda scale: level >= s["p_min"] + scale * s["s"]
        s["verdict"] = "drift" if reached(self.drift_scale) else "warning" if reached(self.warning_scale) else None
        self.recommend(s)

    def report(self, s):
        return s["p"], s["s"]


class Eddm(Detector):
    """Distance between errors: mean + 2 deviations against its greatest value so far. Only wrong rows change anything; the verdict stands between."""

    inputs = LABELS
    extra = "statistic double"

    def __init__(self, n_threshold: int = 30, warning_thresh: float = 0.95, drift_thresh: float = 0.9, std_mode: str = "recursive"):
        self.n_threshold, self.warning_thresh, self.drift_thresh, self.std_mode = n_threshold, warning_thresh, drift_thresh, std_mode

    def epoch(self):
        return {"errors": 0, "at": 0, "mean": 0.0, "raw": 0.0, "top": 0.0, "ratio": None}

    def observe(self, s, y_true, y_pred):
        if y_true == y_pred:
            return
        s["errors"] += 1
        m, here = s["errors"], s["since"] - 1
        gap, s["at"] = here - s["at"], here
        before = s["mean"]
        s["mean"] = before + (gap - before) / m
        s["raw"] = _spread(s["raw"], gap, s["mean"], before, m, self.std_mode)
        if m < self.n_threshold:
            return
        sd = s["raw"] if self.std_mode == "recursive" else math.sqrt(s["raw"] / m)
        reach = s["mean"] + 2 * sd
        s["top"] = max(s["top"], reach)
        s["ratio"] = reach / s["top"] if s["top"] else None
        low = lambda limit: s["ratio"] is not None and s["ratio"] <= limit
        s["verdict"] = "drift" if low(self.drift_thresh) else "warning" if low(self.warning_thresh) else None
        self.recommend(s)

    def report(self, s):
        return (s["ratio"],)


class Stepd(Detector):
    """Accuracy of the last window_size rows against that of the rows before: test of equal proportions, one-sided."""

    inputs = LABELS
    extra = "recent_accuracy double, past_accuracy double, overall_accuracy double, statistic double, p_value double"

    def __init__(self, window_size: int = 30, alpha_warning: float = 0.05, alpha_drift: float = 0.003):
        self.w, self.alpha_warning, self.alpha_drift = window_size, alpha_warning, alpha_drift

    def epoch(self):
        return {"window": [], "older": 0, "stat": None, "p": None}

    def accuracies(self, s: dict) -> tuple[float, float, float]:
        n, k, right = s["since"], len(s["window"]), sum(s["window"])
        return right / k if k else 0.0, s["older"] / (n - k) if n > k else 0.0, (s["older"] + right) / n if n else 0.0

    def observe(self, s, y_true, y_pred):
        s["window"].append(int(y_true == y_pred))
        if len(s["window"]) > self.w:
            s["older"] += s["window"].pop(0)
        n = s["since"]
        if n < 2 * self.w:
            return
        recent, past, overall = self.accuracies(s)
        k = 1 / (n - self.w) + 1 / self.w
        noise = math.sqrt(overall * (1 - overall) * k)
        s["verdict"] = s["stat"] = s["p"] = None
        if noise:
            s["stat"] = (abs(past - recent) - 0.5 * k) / noise
            s["p"] = 1 - NormalDist().cdf(s["stat"])
            if past > recent:
                s["verdict"] = "drift" if s["p"] < self.alpha_drift else "warning" if s["p"] < self.alpha_warning else None
        if s["verdict"] is None:
            s["first"] = s["last"] = None
        elif s["first"] is None:
            s["first"] = s["last"] = s["total"] - 1
        else:
            s["last"] += 1

    def report(self, s):
        return (*self.accuracies(s), s["stat"], s["p"])


RATES = ("tpr", "tnr", "ppv", "npv")


@lru_cache(maxsize=20_000)
def four_rates_bounds(rate: float, n: int, eta: float, warn: float, detect: float, draws: int, seed: int) -> tuple[float, float, float, float]:
    """Simulated (warn low, warn high, detect low, detect high) of (1 - eta) * sum of eta^(n - i) * Bernoulli(rate), i = 1..n.

    The generator is seeded by (seed, rate, n), so bounds depend on nothing else: not on the order of visits, not on the machine. Terms whose
    weights are under 1e-12 in all are left out; the rest is drawn in blocks of bounded size.
    """
    terms = n if not 0 < eta < 1 else min(n, math.ceil(math.log(1e-12) / math.log(eta)))
    weights = (1 - eta) * eta ** np.arange(terms, dtype=float)
    rng = np.random.default_rng(int(uniform_of(seed, repr(rate), n) * (1 << 52)))
    block = max(1, (1 << 20) // max(1, terms))
    sums = np.concatenate([(rng.random((min(block, draws - at), terms)) < rate) @ weights for at in range(0, draws, block)])
    return tuple(float(v) for v in np.percentile(sums, [warn * 100, 100 - warn * 100, detect * 100, 100 - detect * 100]))


class LinearFourRates(Detector):
    """Decayed true positive, true negative, positive and negative predictive rates against simulated bounds. Labels are 0 or 1."""

    inputs = LABELS
    extra = "r_tpr double, r_tnr double, r_ppv double, r_npv double, p_tpr double, p_tnr double, p_ppv double, p_npv double"

    def __init__(self, time_decay_factor: float = 0.9, warning_level: float = 0.05, detect_level: float = 0.05, burn_in: int = 50, num_mc: int = 10_000, subsample: int = 1, rates_tracked: tuple[str, ...] = RATES, round_val: int = 4, seed: int = 0):
        if unknown := set(rates_tracked) - set(RATES):
            raise ValueError(f"no such rates: {sorted(unknown)}")
        self.eta, self.warn, self.detect, self.burn_in = time_decay_factor, warning_level, detect_level, burn_in
        self.num_mc, self.subsample, self.rates, self.round_val, self.seed = num_mc, subsample, tuple(rates_tracked), round_val, seed

    def epoch(self):
        return {"c": [1, 1, 1, 1], "r": [0.5] * 4, "p": [0.5] * 4}  # c: counts by 2 * y_pred + y_true

    @staticmethod
    def _rates(c: list[int]) -> list[tuple[int, int]]:
        """Hits and denominator of each of RATES."""
        tn, fn, fp, tp = c
        return [(tp, tp + fn), (tn, tn + fp), (tp, tp + fp), (tn, tn + fn)]

    def observe(self, s, y_true, y_pred):
        t, p = int(y_true), int(y_pred)
        if t not in (0, 1) or p not in (0, 1):
            raise ValueError("labels must be 0 or 1")
        old = [a / b for a, b in self._rates(s["c"])]
        s["c"][2 * p + t] += 1
        found = self._rates(s["c"])
        test = s["since"] > self.burn_in and s["since"] % self.subsample == 0
        alarm = warning = False
        for i, name in enumerate(RATES):
            if name not in self.rates:
                continue
            hits, n = found[i]
            now = hits / n
            if now != old[i]:
                s["r"][i] = self.eta * s["r"][i] + (1 - self.eta) * (t == p)
            s["p"][i] = now
            if test:
                a, b, c, d = four_rates_bounds(round(now, self.round_val), n, self.eta, self.warn, self.detect, self.num_mc, self.seed)
                warning |= not a <= s["r"][i] <= b
                alarm |= not c <= s["r"][i] <= d
        s["verdict"] = "drift" if alarm else "warning" if warning else None
        self.recommend(s)

    def report(self, s):
        return (*s["r"], *s["p"])


class MarginDensity(Detector):
    """The protocol of margin density with an oracle, over rows that a classifier has scored.

    inputs: kind ("sample" or "oracle"), inside (1 if a sample lies in the margin), right (1 if the classifier is right on an oracle's row). md, md_std, acc, acc_std, length:
    statistics of the reference (see md3.reference_statistics). A warning asks for oracle_length labelled rows; then drift is confirmed or ruled out by accuracy
    and the oracle's rows are the reference, with the statistics md, md_std, acc and acc_std that `restate` gives for them, a list of (inside, right, *carry). By default these are
    taken over k folds of the rows as scored, which is right for a classifier with nothing to learn; for one that learns, carry names its features and label as further inputs and
    restate refits it on each fold, as with md3.refit_statistics. The state holds the rows of a round, oracle_length at most.
    Samples while labels are awaited raise ValueError, or are passed over with strict=False; so are labels that nobody asked for.
    """

    inputs = ("kind", "inside", "right")
    extra = "margin_density double, waiting boolean, labelled long"

    def __init__(self, md: float, md_std: float, acc: float, acc_std: float, length: int, sensitivity: float = 2, oracle_length: int | None = None, strict: bool = True, restate: Callable[[list], dict[str, float]] = md3.scored_statistics, carry: Sequence[str] = ()):
        self.inputs, self.restate = (*MarginDensity.inputs, *carry), restate
        self.ref = {"md": float(md), "md_std": float(md_std), "acc": float(acc), "acc_std": float(acc_std), "len": int(length)}
        self.sensitivity, self.oracle_length, self.strict = sensitivity, oracle_length or length, strict

    def lasting(self):
        return {"ref": dict(self.ref), "md": self.ref["md"], "waiting": False, "asked": []}

    def reset(self, s):
        super().reset(s)
        s["md"] = s["ref"]["md"]

    def step(self, s, kind, inside, right, *more):
        if (kind == "sample") == s["waiting"]:
            if self.strict:
                raise ValueError("labels are awaited" if s["waiting"] else "no labels were asked for")
        elif kind == "sample":
            return super().step(s, inside)
        else:
            self.label(s, inside, right, *more)
        return (s["verdict"], s["total"], s["since"], s["first"], s["last"], *self.report(s))

    def observe(self, s, inside):
        keep = (s["ref"]["len"] - 1) / s["ref"]["len"]
        s["md"] = keep * s["md"] + (1 - keep) * inside
        if abs(s["md"] - s["ref"]["md"]) > self.sensitivity * s["ref"]["md_std"]:
            s["verdict"], s["waiting"] = "warning", True

    def label(self, s, inside, right, *more):
        s["verdict"] = None
        s["asked"].append([int(inside), int(right), *more])
        n = len(s["asked"])
        if n == self.oracle_length:
            if s["ref"]["acc"] - sum(r[1] for r in s["asked"]) / n > self.sensitivity * s["ref"]["acc_std"]:
                s["verdict"] = "drift"
            s["ref"] = {**{c: float(v) for c, v in self.restate(s["asked"]).items() if c in s["ref"]}, "len": n}
            s["md"], s["waiting"], s["asked"] = s["ref"]["md"], False, []

    def report(self, s):
        return s["md"], s["waiting"], len(s["asked"])


def watch_margin(
    df: DataFrame,
    model: md3.Linear,
    reference: dict[str, float],
    features: Sequence[str],
    label: str,
    kind: str,
    key: Sequence[str],
    order: Sequence[str],
    mode: str = "scaled",
    k: int = 10,
    **kwargs,
) -> DataFrame:
    """Margin density of a learnt model over the rows of each key, in order; reference: reference_statistics() of the rows it was learnt from.

    kind: an expression that is sample or oracle. After an oracle round the statistics are those of models refitted on k folds of its rows. kwargs: as for MarginDensity.
    The columns are key, order and what MarginDensity gives. Rows with a null feature or label are passed over.
    """
    scored = df.where(F.array_position(F.array(*(F.col(f).isNull() for f in features)), F.lit(True)) == 0)
    inputs = {
        "kind": kind,
        "inside": md3.inside_margin(model, features, mode),
        "right": (md3.predicted(model, features) == F.col(label).cast("int")).cast("int"),
        "x": F.array(*(F.col(f).cast("double") for f in features)),
        "y": F.col(label).cast("int"),
    }
    step = MarginDensity(
        **reference,
        restate=lambda rows: md3.refit_statistics(rows, lambda xs, ys: md3.scorer(md3.fit_local(xs, ys), mode), k),
        carry=("x", "y"),
        **kwargs,
    )
    return run_fold(scored, step, key, order, inputs)


def four_rates_trace(df: DataFrame, key: str, order: list[str], y_true: Column, y_pred: Column) -> DataFrame:
    """The four rates of every row as windows, without resets; each cell of the table starts at 1."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = lambda t, p: 1 + F.sum(((y_true == t) & (y_pred == p)).cast("long")).over(upto)
    tp, tn, fp, fn = cell(1, 1), cell(0, 0), cell(0, 1), cell(1, 0)
    rates = {"tpr": tp / (tp + fn), "tnr": tn / (tn + fp), "ppv": tp / (tp + fp), "npv": tn / (tn + fn)}
    return df.select(key, *order, *(r.alias(n) for n, r in rates.items()))


def stepd_trace(df: DataFrame, key: str, order: list[str], right: Column, window: int = 30) -> DataFrame:
    """Recent, past and overall accuracy and the statistic of every row as windows, without resets; the statistic is null before two windows and where all rows are alike."""
    w = Window.partitionBy(key).orderBy(*order)
    bit = df.select(key, *order, right.cast("long").alias("bit")).withColumn("n", F.row_number().over(w))
    recent = F.sum("bit").over(w.rowsBetween(-(window - 1), 0))
    all_right = F.sum("bit").over(w.rowsBetween(Window.unboundedPreceding, 0))
    counted = bit.withColumns({"s": recent, "all_right": all_right})
    past, now, overall = (F.col("all_right") - F.col("s")) / (F.col("n") - window), F.col("s") / F.lit(window), F.col("all_right") / F.col("n")
    k = F.lit(1.0) / (F.col("n") - window) + F.lit(1.0 / window)
    ready = (F.col("n") >= 2 * window) & (F.col("all_right") > 0) & (F.col("all_right") < F.col("n"))
    stat = F.when(ready, (F.abs(past - now) - k * 0.5) / F.sqrt(overall * (1 - overall) * k))
    return counted.select(key, *order, F.when(F.col("n") > window, past).alias("past_accuracy"), F.when(F.col("n") >= window, now).alias("recent_accuracy"), overall.alias("overall_accuracy"), stat.alias("statistic"))
