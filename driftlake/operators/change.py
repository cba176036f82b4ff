"""Change detectors for one number at a time: cumulative sums, Page-Hinkley, adaptive windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.operators.fold import Detector


def _over(a: float, b: float) -> float:
    """a / b as floating point hardware has it."""
    if b:
        return a / b
    return math.nan if not a or math.isnan(a) else math.copysign(math.inf, a)


def _mean_sd(values: list[float]) -> tuple[float, float]:
    mean = math.fsum(values) / len(values)
    return mean, math.sqrt(math.fsum((v - mean) ** 2 for v in values) / len(values))


class Cusum(Detector):
    """Two reflected cumulative sums of standardised values.

    Without target and sd, both are those of the first burn_in rows. After drift they are those of the last burn_in rows. direction: None, "positive" or
    "negative". replay: after a drift, the sums run over the stream from its first row again, as users of other tools may
    expect; the whole stream is then kept in the state. replay=False reads the new rows and keeps burn_in values. A constant stream raises ValueError
    past burn_in, or, with constant="ignore", never drifts.
    """

    extra = "upper double, lower double"

    def __init__(self, target: float | None = None, sd_hat: float | None = None, burn_in: int = 30, delta: float = 0.005, threshold: float = 5, direction: str | None = None, replay: bool = True, constant: str = "raise"):
        if (target is None) != (sd_hat is None):
            raise ValueError("target and sd_hat are given together or not at all")
        if direction not in (None, "positive", "negative"):
            raise ValueError("direction is None, positive or negative")
        self.target, self.sd_hat, self.burn_in, self.delta, self.threshold = target, sd_hat, burn_in, delta, threshold
        self.direction, self.replay, self.constant = direction, replay, constant

    def epoch(self):
        return {"upper": 0.0, "lower": 0.0}

    def lasting(self):
        return {"target": self.target, "sd": self.sd_hat, "stream": []}

    def reset(self, s):
        s["target"], s["sd"] = _mean_sd(s["stream"][-self.burn_in :])
        super().reset(s)

    def observe(self, s, x):
        s["stream"].append(x)
        n = s["since"]
        if s["target"] is None and n == self.burn_in:
            s["target"], s["sd"] = _mean_sd(s["stream"])
        if s["target"] is not None:
            if s["sd"] == 0 and n > self.burn_in and self.constant == "raise":
                raise ValueError("the standard deviation is 0: the stream has one value only")
            z = _over((s["stream"][n - 1] if self.replay else x) - s["target"], s["sd"])
            if s["sd"] == 0 and self.constant == "ignore":
                z = 0.0
            up, low = s["upper"] + z - self.delta, s["lower"] - self.delta - z
            s["upper"], s["lower"] = up if up > 0 else 0.0, low if low > 0 else 0.0
        if not self.replay:
            del s["stream"][: -self.burn_in]
        high, low = s["upper"] > self.threshold, s["lower"] > self.threshold
        if n > self.burn_in and {None: high or low, "positive": high, "negative": low}[self.direction]:
            s["verdict"] = "drift"

    def report(self, s):
        return s["upper"], s["lower"]


class PageHinkley(Detector):
    """Distance of the cumulative deviation from its least (positive) or greatest (negative) value, against threshold times the running mean."""

    extra = "value double, ph_sum double, difference double, theta double, exceeds boolean, ph_max double, ph_min double, mean double"

    def __init__(self, delta: float = 0.01, threshold: float = 20, burn_in: int = 30, direction: str = "positive"):
        if direction not in ("positive", "negative"):
            raise ValueError("direction is positive or negative")
        self.delta, self.threshold, self.burn_in, self.direction = delta, threshold, burn_in, direction

    def epoch(self):
        return {"x": None, "mean": 0.0, "sum": 0.0, "min": 0.0, "max": 0.0, "gap": 0.0, "theta": 0.0}

    def observe(self, s, x):
        s["x"] = x
        s["mean"] += (x - s["mean"]) / s["since"]
        s["sum"] = s["sum"] + x - s["mean"] - self.delta
        s["theta"] = self.threshold * s["mean"]
        s["min"], s["max"] = min(s["min"], s["sum"]), max(s["max"], s["sum"])
        s["gap"] = s["sum"] - s["min"] if self.direction == "positive" else s["max"] - s["sum"]
        if s["gap"] > s["theta"] and s["since"] > self.burn_in:
            s["verdict"] = "drift"

    def report(self, s):
        return s["x"], s["sum"], s["gap"], s["theta"], s["gap"] > s["theta"], s["max"], s["min"], s["mean"]


class Adwin(Detector):
    """A window that drops its oldest part when two of its parts have means too far apart.

    The window is an exponential histogram: level i holds at most max_buckets buckets of 2^i rows, each a sum and a sum of squared deviations. Tests
    run every new_sample_thresh rows. rec_first and rec_last span the window after it was cut. The window outlives its verdicts.
    """

    extra = "window_size long, mean double, variance double"

    def __init__(self, delta: float = 0.002, max_buckets: int = 5, new_sample_thresh: int = 32, window_size_thresh: int = 10, subwindow_size_thresh: int = 5, conservative_bound: bool = False):
        if not 0 <= delta <= 1:
            raise ValueError("delta must be between 0 and 1")
        self.delta, self.max_buckets, self.every = delta, max_buckets, new_sample_thresh
        self.least_window, self.least_part, self.conservative = window_size_thresh, subwindow_size_thresh, conservative_bound

    def lasting(self):
        return {"size": 0, "sum": 0.0, "dev": 0.0, "levels": [[]]}  # levels[i]: buckets [sum, dev], oldest first

    def over(self, s):
        return s["verdict"] is not None

    def observe(self, s, x):
        s["size"] += 1
        n = s["size"]
        if n > 1:
            d = x - s["sum"] / (n - 1)
            s["dev"] += (n - 1) * d * d / n
        s["sum"] += x
        levels = s["levels"]
        levels[0].append([float(x), 0.0])
        for i, level in enumerate(levels):
            if len(level) <= self.max_buckets:
                break
            half = 1 << i
            (s1, v1), (s2, v2) = level[0], level[1]
            del level[:2]
            gap = s1 / half - s2 / half
            if i + 1 == len(levels):
                levels.append([])
            levels[i + 1].append([s1 + s2, v1 + v2 + half * gap * gap / 2])
        if s["total"] % self.every == 0 and s["size"] > self.least_window:
            while self._cut(s):
                s["verdict"] = "drift"
                self._drop_oldest(s)
                s["first"], s["last"] = s["total"] - s["size"], s["total"] - 1

    def _cut(self, s: dict) -> bool:
        """Whether the window parts somewhere; the newest bucket is never alone on its side."""
        n_old, sum_old, n_new, sum_new = 0, 0.0, s["size"], s["sum"]
        buckets = [(1 << i, b[0]) for i in range(len(s["levels"]) - 1, -1, -1) for b in s["levels"][i]]
        if s["levels"][0]:
            buckets.pop()
        for n, part in buckets:
            n_old, n_new, sum_old, sum_new = n_old + n, n_new - n, sum_old + part, sum_new - part
            if n_old >= self.least_part and n_new >= self.least_part and abs(sum_old / n_old - sum_new / n_new) > self._bound(s, n_old, n_new):
                return True
        return False

    def _bound(self, s: dict, n_old: int, n_new: int) -> float:
        h = 1 / (n_old - self.least_part + 1) + 1 / (n_new - self.least_part + 1)
        factor = 4 if self.conservative else 2
        log = math.log(factor * math.log(s["size"]) / self.delta) if self.delta else math.inf
        if self.conservative:
            return math.sqrt(h * log / 2)
        return math.sqrt(2 * h * s["dev"] / s["size"] * log) + 2 / 3 * h * log

    def _drop_oldest(self, s: dict) -> None:
        level = s["levels"][-1]
        n = 1 << (len(s["levels"]) - 1)
        total, dev = level.pop(0)
        s["size"] -= n
        s["sum"] -= total
        if s["size"]:
            d = total / n - s["sum"] / s["size"]
            s["dev"] -= dev + n * s["size"] * d * d / (n + s["size"])
        else:
            s["dev"] = 0.0
        while len(s["levels"]) > 1 and not s["levels"][-1]:
            s["levels"].pop()

    def report(self, s):
        n = s["size"]
        return n, s["sum"] / n if n else 0.0, s["dev"] / n if n else 0.0


def page_hinkley_trace(df: DataFrame, key: str, order: list[str], x: Column, delta: float = 0.01, threshold: float = 20, scale: int = 100) -> DataFrame:
    """The Page-Hinkley statistics of every row as windows, without resets: all in the JVM.

    x is taken in whole units of 1 / scale, so means are quotients of whole sums and the same in every engine. Null values are left out.
    """
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = df.where(x.isNotNull()).select(key, *order, F.round(x * scale).cast("long").alias("units"))
    n = F.row_number().over(w)
    mean = units.withColumn("mean", F.sum("units").over(upto) / (F.lit(float(scale)) * n)).withColumn("x", F.col("units") / F.lit(float(scale)))
    summed = mean.withColumn("ph_sum", F.sum(F.col("x") - F.col("mean") - delta).over(upto))
    low, high = F.least(F.lit(0.0), F.min("ph_sum").over(upto)), F.greatest(F.lit(0.0), F.max("ph_sum").over(upto))
    return summed.select(key, *order, "x", "mean", "ph_sum", (F.col("ph_sum") - low).alias("difference"), low.alias("ph_min"), high.alias("ph_max"), (F.col("mean") * threshold).alias("theta"))


def cusum_trace(df: DataFrame, key: str, order: list[str], x: Column, target: float, sd: float, delta: float = 0.005) -> DataFrame:
    """Both reflected sums of every row as windows, without resets: S_n - min(0, S_1..S_n) is max(0, S_(n-1) + step). All in the JVM."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = (x - target) / sd
    both = df.where(x.isNotNull()).select(key, *order, z.alias("z")).withColumns({"up": F.sum(F.col("z") - delta).over(upto), "down": F.sum(-F.col("z") - delta).over(upto)})
    over_least = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(upto))
    return both.select(key, *order, "z", over_least("up").alias("upper"), over_least("down").alias("lower"))
