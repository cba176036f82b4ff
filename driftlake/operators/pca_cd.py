"""Change of the densities along principal components, between a reference window and a sliding one."""

from __future__ import annotations

import math

import numpy as np

from driftlake.functions.density import epanechnikov, jensen_shannon_np
from driftlake.operators.change import PageHinkley
from driftlake.operators.fold import Detector


def components(x: np.ndarray, share: float) -> np.ndarray:
    """Rows: the leading principal components that explain at least that share of the variance (a share of 1 or more: that many or all)."""
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    if share >= 1:
        return vectors.T[: int(share)] if share > 1 else vectors.T
    told = np.cumsum(values) / values.sum() if values.sum() else np.ones(len(values))
    n = min(len(values), int(np.searchsorted(told, share, side="right")) + 1)
    return vectors.T[:n]


class PcaCd(Detector):
    """Two windows of window_size rows, standardised by the first (population deviation; constant columns are only centred) and projected on its components.

    Every `step` rows the largest divergence of any component between reference and test window goes to a Page-Hinkley detector. divergence_metric: "kl" (Jensen-Shannon distance of kernel
    densities, each at its own points) or "intersection" (of histograms; new projections are held within the bounds of the two windows, of each component or, with shared_bounds, of
    the last one). After drift the next row is not used, and the test window is the reference.
    """

    inputs = ("x",)
    extra = "change_score double"
    recs = False

    def __init__(self, window_size: int, ev_threshold: float = 0.99, delta: float = 0.1, divergence_metric: str = "kl", sample_period: float = 0.05, online_scaling: bool = True, shared_bounds: bool = False):
        if divergence_metric not in ("kl", "intersection"):
            raise ValueError("divergence_metric is kl or intersection")
        self.w, self.share, self.metric, self.scaling, self.shared = window_size, ev_threshold, divergence_metric, online_scaling, shared_bounds
        self.every = max(1, min(100, round(sample_period * window_size)))
        self.bins = math.isqrt(window_size)
        self.monitor = PageHinkley(delta=delta, threshold=round(0.01 * window_size), burn_in=0)

    def lasting(self):
        return {"ref": [], "test": [], "fit": None, "monitor": self.monitor.start(), "score": None}

    def step(self, s, x):
        if s["verdict"] == "drift":
            total = s["total"] + 1
            ref = np.asarray(s["test"]) * s["fit"]["scale"] + s["fit"]["mean"]
            self.reset(s)
            s.update(total=total, ref=ref.tolist(), test=[], fit=None, monitor=self.monitor.start(), score=None)
            return (None, total, 0, None, None, None)
        return super().step(s, x)

    def observe(self, s, x):
        x = [float(v) for v in x]
        if s["fit"] is None:
            s["ref" if len(s["ref"]) < self.w else "test"].append(x)
            if len(s["test"]) == self.w:
                self._fit(s)
            return
        fit = s["fit"]
        row = (np.array(x) - fit["mean"]) / fit["scale"]
        proj = (row - fit["centre"]) @ fit["axes"].T
        if self.metric == "intersection":
            proj = np.clip(proj, fit["low"], fit["high"])
        s["test"] = np.vstack([s["test"][1:], row])
        fit["proj"] = np.vstack([fit["proj"][1:], proj])
        here = s["total"] - 1
        if here and here % self.every == 0:
            s["score"] = max(self._divergence(fit, i, fit["proj"][:, i]) for i in range(len(fit["axes"])))
            if self.monitor.step(s["monitor"], s["score"])[0] == "drift":
                s["verdict"] = "drift"

    def _fit(self, s: dict) -> None:
        ref, test = np.array(s["ref"]), np.array(s["test"])
        mean, scale = (ref.mean(0), ref.std(0)) if self.scaling else (np.zeros(ref.shape[1]), np.ones(ref.shape[1]))
        scale = np.where(scale > 10 * np.finfo(float).eps, scale, 1.0)
        ref, test = (ref - mean) / scale, (test - mean) / scale
        axes, centre = components(ref, self.share), ref.mean(0)
        a, b = (ref - centre) @ axes.T, (test - centre) @ axes.T
        low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
        fit = {"mean": mean, "scale": scale, "axes": axes, "centre": centre, "proj": b, "low": low, "high": high}
        if self.shared:
            fit["own_low"], fit["own_high"] = low, high
            fit["low"], fit["high"] = np.full(len(low), low[-1]), np.full(len(high), high[-1])
        fit["density"] = np.array([epanechnikov(a[:, i]) if self.metric == "kl" else np.histogram(a[:, i], self.bins, (low[i], high[i]))[0] / self.w for i in range(len(axes))])
        s.update(ref=[], test=test, fit=fit)

    def _divergence(self, fit: dict, i: int, sample: np.ndarray) -> float:
        if self.metric == "kl":
            return jensen_shannon_np(fit["density"][i], epanechnikov(sample))
        counts = np.histogram(sample, self.bins, (fit["low"][i], fit["high"][i]))[0]
        return float(1 - np.minimum(fit["density"][i], counts / max(1, counts.sum())).sum())

    def report(self, s):
        return (s["score"],)
