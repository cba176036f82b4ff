"""State machines alone, without Spark: fixtures of known result."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlake.functions import stats
from driftlake.operators import change, concept, ensemble, kdq, md3, pca_cd
from driftlake.plans import streams
from driftlake.streaming.stateful import decode, encode

CORRECT, WRONG = (1, 1), (0, 1)


def run(step, rows):
    s = step.start()
    return [step.step(s, *(r if isinstance(r, tuple) else (r,))) for r in rows], s


def verdicts(step, rows):
    return [o[0] for o in run(step, rows)[0]]


def uniform(n, seed=1):
    r = random.Random(seed)
    return [r.random() for _ in range(n)]


def test_adwin_variance():
    out, _ = run(change.Adwin(new_sample_thresh=2), [1, 0] * 10)
    assert out[-1][-1] == 0.25 and out[-1][-2] == 0.5


@pytest.mark.parametrize("conservative", [False, True])
def test_adwin_jump(conservative):
    step = change.Adwin(new_sample_thresh=2, conservative_bound=conservative)
    s = step.start()
    for x in [0.1] * 20:
        step.step(s, x)
    for _ in range(20):
        if step.step(s, 100.0)[0] == "drift":
            break
    assert s["verdict"] == "drift" and s["last"] == s["total"] - 1
    again = step.step(s, 100.0)
    assert again[0] is None and again[3:5] == (None, None)


def test_adwin_bad_delta():
    with pytest.raises(ValueError):
        change.Adwin(delta=25)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=300))
def test_adwin_window_without_cut_is_the_stream(values):
    out, _ = run(change.Adwin(delta=0, new_sample_thresh=1), values)
    assert out[-1][5] == len(values)
    assert np.isclose(out[-1][6], np.mean(values), atol=1e-9) and np.isclose(out[-1][7], np.var(values), atol=1e-6)


@pytest.mark.parametrize("direction, x", [(None, 100), ("positive", 100), ("negative", -100)])
def test_cusum_drift(direction, x):
    assert verdicts(change.Cusum(threshold=10, direction=direction), [*uniform(30), x]) == [None] * 30 + ["drift"]


def test_cusum_constant():
    with pytest.raises(ValueError):
        run(change.Cusum(threshold=10), [1.0] * 31)
    assert set(verdicts(change.Cusum(threshold=10, constant="ignore"), [1.0] * 50)) == {None}
    with pytest.raises(ValueError):
        change.Cusum(target=1)


def test_cusum_replay_reads_the_stream_again():
    rows = [*uniform(30), 100, *uniform(60, 2)]
    old, new = (run(change.Cusum(threshold=10, replay=r), rows) for r in (True, False))
    assert [o[0] for o in old[0][:31]] == [o[0] for o in new[0][:31]]
    assert len(new[1]["stream"]) == 30 and len(old[1]["stream"]) == len(rows)


def test_page_hinkley():
    assert set(verdicts(change.PageHinkley(), [1.0] * 60)) == {None}
    for direction, x in (("positive", 100.0), ("negative", -100.0)):
        out, _ = run(change.PageHinkley(burn_in=30, direction=direction), [1.0] * 30 + [x, 1.0])
        assert [o[0] for o in out] == [None] * 30 + ["drift", None] and out[-1][2] == 1


def test_ddm():
    assert verdicts(concept.Ddm(n_threshold=2), [CORRECT] * 3) == [None, "drift", None]
    out = verdicts(concept.Ddm(10, 1.1, 1.5), [CORRECT] * 5 + [WRONG] * 6 + [CORRECT])
    assert out[-2:] == ["warning", None]


def test_eddm():
    assert verdicts(concept.Eddm(n_threshold=2), [CORRECT] * 2 + [WRONG] * 5)[5:] == ["drift", None]
    assert verdicts(concept.Eddm(n_threshold=2), [CORRECT] * 2 + [WRONG] * 3 + [CORRECT, WRONG])[4:] == ["warning", "warning", None]


def test_stepd():
    assert verdicts(concept.Stepd(1, alpha_warning=0.6), [CORRECT, WRONG, CORRECT])[1:] == ["warning", None]
    assert verdicts(concept.Stepd(1, alpha_warning=0.7, alpha_drift=0.6), [CORRECT, WRONG, CORRECT])[1:] == ["drift", None]
    out, _ = run(concept.Stepd(2), [WRONG, WRONG, CORRECT, CORRECT])
    assert out[-1][5:8] == (1.0, 0.0, 0.5)
    out, _ = run(concept.Stepd(5, 0.4, 0.24), [CORRECT, WRONG] * 5 + [WRONG] * 3 + [CORRECT] * 2)
    first = next(i for i, o in enumerate(out) if o[0])
    assert out[first][3] == first and out[-1][3] is None


def test_linear_four_rates():
    out, _ = run(concept.LinearFourRates(burn_in=30, num_mc=1, detect_level=0.5), [(1, 1)] * 31)
    assert out[-1][0] == "drift" and out[-1][3:5] == (30, 30)
    assert set(verdicts(concept.LinearFourRates(burn_in=30, num_mc=1, detect_level=0.5, rates_tracked=()), [(1, 1)] * 31)) == {None}
    with pytest.raises(ValueError):
        run(concept.LinearFourRates(), [(2, 1)])


def test_adwin_accuracy_is_adwin_of_hits():
    rows = [(i % 2, i % 3 % 2) for i in range(200)]
    assert run(concept.AdwinAccuracy(delta=0.9), rows)[0] == run(change.Adwin(delta=0.9), [float(a == b) for a, b in rows])[0]


def test_margin_density_protocol():
    make = lambda **k: concept.MarginDensity(md=0.0, md_std=0.0, acc=0.833, acc_std=0.166, length=5, oracle_length=2, **k)
    step = make()
    s = step.start()
    assert step.step(s, "sample", 0, 0)[0] is None
    with pytest.raises(ValueError):
        step.step(s, "oracle", 0, 0)
    assert step.step(s, "sample", 1, 0)[0] == "warning" and s["waiting"]
    with pytest.raises(ValueError):
        step.step(s, "sample", 1, 0)
    assert step.step(s, "oracle", 1, 0)[0] is None
    assert step.step(s, "oracle", 0, 0)[0] == "drift" and not s["waiting"] and s["ref"]["len"] == 2 and s["ref"]["md"] == 0.5
    loose = make(strict=False)
    s = loose.start()
    assert loose.step(s, "oracle", 0, 0)[1] == 0


def test_margin_density_restates_its_reference():
    step = concept.MarginDensity(md=0.0, md_std=0.0, acc=0.8, acc_std=0.1, length=5, oracle_length=4)
    s = step.start()
    step.step(s, "sample", 1, 0)
    for inside, right in ((1, 1), (0, 1), (0, 0), (0, 1)):
        step.step(s, "oracle", inside, right)
    sd = 0.1875**0.5  # four folds of one row: 1, 0, 0, 0 and 1, 1, 0, 1
    assert s["ref"] == pytest.approx({"md": 0.25, "md_std": sd, "acc": 0.75, "acc_std": sd, "len": 4})
    assert step.step(s, "sample", 1, 0)[0] is None  # 0.4375: within two of the new deviations, far beyond the old


def test_margin_density_refits_on_folds():
    def fit(xs, ys):
        at = (max(x for x, y in zip(xs, ys, strict=True) if not y) + min(x for x, y in zip(xs, ys, strict=True) if y)) / 2
        return lambda x: (abs(x - at) <= 1, int(x > at))

    step = concept.MarginDensity(md=0.0, md_std=0.0, acc=1.0, acc_std=0.1, length=5, oracle_length=4, restate=lambda rows: md3.refit_statistics(rows, fit, k=4), carry=("x", "y"))
    s = step.start()
    assert step.inputs == ("kind", "inside", "right", "x", "y") and step.step(s, "sample", 1, 0, 0.0, 0)[0] == "warning"
    found = [step.step(s, "oracle", 0, 0, x, y)[0] for x, y in ((0.0, 0), (2.0, 0), (3.0, 1), (9.0, 1))]
    # without 0: 2.5, right; without 2: 1.5, in the margin and wrong; without 3: 5.5, wrong; without 9: 2.5, right
    assert found == [None, None, None, "drift"] and s["ref"] == pytest.approx({"md": 0.25, "md_std": 0.1875**0.5, "acc": 0.5, "acc_std": 0.5, "len": 4})


def test_registered_queries_simulate_as_often_as_the_defaults():
    assert (streams.LFR.num_mc, streams.LFR.subsample) == (10_000, 1)
    assert streams.KDQ_STREAM.samples == 500


def test_confirmed_election():
    d, w = "drift", "warning"
    assert verdicts(ensemble.Confirmed(2, 10), [([d, None, None],), ([d, d, None],)]) == [None, d]
    assert verdicts(ensemble.Confirmed(2, 10), [([d, None, None],), ([d, w, None],)]) == [None, w]
    assert verdicts(ensemble.Confirmed(2, 10), [([d, None, None],)] * 2) == [None, None]
    out, _ = run(ensemble.Confirmed(1, 1), [([d],), ([d],)])
    assert [o[-1] for o in out] == [[1], [0]]


def test_kdq_stream():
    rng = np.random.default_rng(0)
    base, far = rng.random((60, 3)), rng.random((60, 3)) * 50
    step = kdq.KdqStream(20, persistence=0.1, bootstrap_samples=50, count_ubound=2)
    out = verdicts(step, [(r.tolist(),) for r in np.vstack([base, far])])
    assert "drift" in out[60:]
    with pytest.raises(ValueError):
        kdq.KdqStream(0)


@pytest.mark.parametrize("metric, delta", [("kl", 0.05), ("intersection", 0.1)])
def test_pca_cd(metric, delta):
    rng = np.random.default_rng(123)
    base = rng.multivariate_normal([2, 3, 8], np.diag([1.0, 2, 1]), 150)
    moved = rng.multivariate_normal([10, 3, 8], np.diag([1.0, 12, 20]), 150)
    step = pca_cd.PcaCd(50, delta=delta, divergence_metric=metric)
    out, s = run(step, [(r.tolist(),) for r in np.vstack([base, moved])])
    found = [i for i, o in enumerate(out) if o[0] == "drift"]
    assert found and found[0] >= 150
    after = out[found[0] + 1]
    assert after[0] is None and after[2] == 0


@pytest.mark.parametrize("step, rows", [(change.Adwin(), uniform(80)), (concept.Stepd(5), [(i % 2, i % 3 % 2) for i in range(60)]), (pca_cd.PcaCd(10), [([a, a * a, 1.0],) for a in uniform(60)]), (kdq.KdqStream(10, bootstrap_samples=10, count_ubound=2), [([a, a * a],) for a in uniform(60)])])
def test_state_survives_the_state_store(step, rows):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    plain, kept = step.start(), step.start()
    for r in rows:
        a = step.step(plain, *r)
        kept = decode(encode(kept))
        assert a == step.step(kept, *r)


def test_quantiles():
    for p, df, want in ((0.975, 10, 2.228139), (0.975, 30, 2.042272), (0.95, 5, 2.015048), (0.995, 2, 9.924843), (0.975, 1e6, 1.959966)):
        assert abs(stats.t_quantile(p, df) - want) < 1e-5
    assert stats.t_quantile(0.025, 10) == -stats.t_quantile(0.975, 10)
    with pytest.raises(ValueError):
        stats.t_quantile(1, 3)
