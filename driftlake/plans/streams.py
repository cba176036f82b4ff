"""Queries of the sequential detectors, elections and ensembles over the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import change, concept, ensemble, kdq, md3, pca_cd
from driftlake.operators.fold import Detector, run_fold

KEY, ORDER = ["user_id"], ["ts", "event_id"]
#: A prediction stream out of the events.
Y_TRUE, Y_PRED = "CAST(value > 50 AS INT)", "CAST(event_id % 2 AS INT)"
LABELS = {"y_true": Y_TRUE, "y_pred": Y_PRED}
#: Detectors with thresholds at which the events, 50 to 90 for each user, give verdicts of every kind.
PH = change.PageHinkley(delta=0.01, threshold=1, burn_in=10)
CUSUM = change.Cusum(target=50, sd_hat=30, burn_in=10, threshold=4, replay=False, constant="ignore")
DDM = concept.Ddm(n_threshold=10, warning_scale=1.1, drift_scale=1.5)
EDDM = concept.Eddm(n_threshold=5)
STEPD = concept.Stepd(window_size=10, alpha_warning=0.2, alpha_drift=0.05)
LFR = concept.LinearFourRates(burn_in=10, detect_level=0.01)
KDQ_STREAM = kdq.KdqStream(20, count_ubound=5, alpha=0.1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the detectors read; ts at microseconds, without a zone."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")


def folded(step: Detector, inputs: dict, *cols: str):
    """A query that gives user_id, event_id, the verdict, both counters and cols."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_fold(events(spark, sf_dir), step, KEY, ORDER, inputs).select("user_id", "event_id", "verdict", "total", "since", *cols)

    return query


def ph_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = change.page_hinkley_trace(events(spark, sf_dir), "user_id", ORDER, F.col("value"))
    return trace.select("user_id", "event_id", *(F.round(c, 6).alias(c) for c in ("x", "mean", "ph_sum", "difference", "ph_min", "ph_max", "theta")))


def cusum_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = change.cusum_trace(events(spark, sf_dir), "user_id", ORDER, F.col("value"), 50, 30)
    return trace.select("user_id", "event_id", *(F.round(c, 6).alias(c) for c in ("upper", "lower")))


def stepd_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = concept.stepd_trace(events(spark, sf_dir), "user_id", ORDER, F.expr(f"{Y_TRUE} = {Y_PRED}"), 10)
    return trace.select("user_id", "event_id", "past_accuracy", "recent_accuracy", "overall_accuracy", F.round("statistic", 9).alias("statistic"))


def lfr_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept.four_rates_trace(events(spark, sf_dir), "user_id", ORDER, F.expr(Y_TRUE), F.expr(Y_PRED)).drop("ts")


def cusum_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the default replay: after a drift, the sums run over the stream from its first row again."""
    found = run_fold(events(spark, sf_dir), change.Cusum(burn_in=10, threshold=4, constant="ignore"), KEY, ORDER, {"x": "value"})
    return found.select("user_id", "event_id", "verdict", "total", "since", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"))


def lfr_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four decayed rates and their undecayed ones over the whole stream: a burn-in that no stream ends leaves out all tests."""
    found = run_fold(events(spark, sf_dir), concept.LinearFourRates(burn_in=1 << 40), KEY, ORDER, LABELS)
    return found.select("user_id", "event_id", *(f"{kind}_{rate}" for kind in "rp" for rate in concept.RATES))


def md3_margin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = concept.MarginDensity(md=0.2, md_std=10, acc=0.8, acc_std=0.1, length=20)
    found = run_fold(events(spark, sf_dir), step, KEY, ORDER, {"kind": "'sample'", "inside": "CAST(abs(value - 50) <= 10 AS INT)", "right": "0"})
    return found.select("user_id", "event_id", "total", "margin_density")


def md3_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is a labelled row; those that nobody asked for, and samples while labels are awaited, are passed over.

    The predictions are a fixed rule with nothing to refit: after a round the reference is stated anew over folds of the 5 rows as scored.
    """
    step = concept.MarginDensity(md=0.2, md_std=0.05, acc=0.8, acc_std=0.1, length=20, oracle_length=5, strict=False)
    found = run_fold(events(spark, sf_dir), step, KEY, ORDER, {"kind": "IF(event_id % 3 = 0, 'oracle', 'sample')", "inside": "CAST(abs(value - 50) <= 10 AS INT)", "right": f"CAST({Y_TRUE} = {Y_PRED} AS INT)"})
    return found.select("user_id", "event_id", "verdict", "total", "since", "margin_density", "waiting", "labelled")


#: Features and label that a classifier learns from the first half of the time; in the last quarter the labels are turned round.
MD3_FEATURES, MD3_LABEL = ["f0", "f1"], "y"
MD3_KIND = "IF(event_id % 3 = 0, 'oracle', 'sample')"


def md3_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows to learn from and the rows to watch."""
    e = events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = e.agg(F.min("at"), F.max("at")).first()
    if low is None:
        low = high = 0
    rows = e.select(*KEY, *ORDER, "at", F.expr("value / 50").alias("f0"), F.expr("(event_id % 7) / 7D").alias("f1"), F.expr(Y_TRUE).alias("t"))
    late = F.col("at") >= high - (high - low) // 4
    labelled = rows.withColumn(MD3_LABEL, F.when(late, 1 - F.col("t")).otherwise(F.col("t"))).where(F.col("f0").isNotNull())
    first = F.col("at") < low + (high - low) // 2
    return labelled.where(first).drop("at", "t"), labelled.where(~first).drop("at", "t")


def md3_fit(df: DataFrame) -> md3.Linear:
    return md3.fit_linear(df, MD3_FEATURES, MD3_LABEL, regParam=0.01, maxIter=5)


def md3_watched(later: DataFrame, model: md3.Linear, reference: dict[str, float]) -> DataFrame:
    """Every user's rows, of which a density forgets all but some 20; oracle rounds of 5 rows."""
    reference = {**reference, "length": 20}
    found = concept.watch_margin(later, model, reference, MD3_FEATURES, MD3_LABEL, MD3_KIND, KEY, ORDER, "functional", oracle_length=5, strict=False)
    return found.select("user_id", "event_id", "verdict", "total", "since", F.round("margin_density", 6).alias("margin_density"), "waiting", "labelled")


def md3_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin density end to end: a model learnt in Spark, its reference over 10 folds, the later events watched, models refitted after oracle rounds."""
    known, later = md3_tables(spark, sf_dir)
    reference = md3.reference_statistics(known, MD3_FEATURES, MD3_LABEL, fit=md3_fit, mode="functional", id_col="event_id")
    return md3_watched(later, md3_fit(known), reference)


THREE = {"x": "array(value, CAST(event_id % 7 AS DOUBLE), value * 0.1 + CAST(event_id % 3 AS DOUBLE))"}


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = {"ddm": DDM, "eddm": EDDM, "stepd": STEPD}
    return ensemble.stream_members(events(spark, sf_dir), three, KEY, ORDER, dict.fromkeys(three, LABELS))


def elected(election):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ensemble.elect(_three(spark, sf_dir), election, KEY, ORDER).select("user_id", "event_id", "verdict")

    return query


def ensemble_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each member recommends for training."""
    members = _three(spark, sf_dir)
    rec = lambda name, end: F.try_element_at("retraining_recs", F.lit(name))[end].alias(f"{name}_{end}")
    return members.select("user_id", "event_id", *(rec(name, end) for name in ("ddm", "stepd") for end in ("first", "last")))


def ensemble_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two members of one kind, each with columns of its own choice."""
    selectors = {"value": lambda df: df.withColumn("x", F.col("value")), "rest": lambda df: df.select(*KEY, *ORDER, (F.lit(100.0) - F.col("value")).alias("x"))}
    found = ensemble.stream_ensemble(events(spark, sf_dir), {"value": PH, "rest": PH}, KEY, ORDER, selectors=selectors, election=ensemble.minimum(1))
    return found.select("user_id", "event_id", F.try_element_at("drift_states", F.lit("value")).alias("by_value"), F.try_element_at("drift_states", F.lit("rest")).alias("by_rest"), "verdict")


def ensemble_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ensemble.stream_ensemble(events(spark, sf_dir), {"ddm": DDM, "ph": PH}, KEY, ORDER, {"ddm": LABELS, "ph": {"x": "value"}}, election=ensemble.minimum(1))
    return found.select("user_id", "event_id", F.try_element_at("drift_states", F.lit("ddm")).alias("ddm"), F.try_element_at("drift_states", F.lit("ph")).alias("ph"), "verdict")


QUERIES = {
    "ph_trace": ph_trace,
    "ph_verdict": folded(PH, {"x": "value"}),
    "cusum_trace": cusum_trace,
    "cusum_verdict": folded(CUSUM, {"x": "value"}),
    "cusum_replay": cusum_replay,
    "ddm": folded(DDM, LABELS, "rec_first", "rec_last", "error_rate", "error_std"),
    "eddm": folded(EDDM, LABELS, "statistic"),
    "stepd": folded(STEPD, LABELS, "rec_first", "rec_last"),
    "stepd_trace": stepd_trace,
    "adwin_verdict": folded(change.Adwin(delta=0.3, new_sample_thresh=4), {"x": "value"}, "window_size", "mean", "variance"),
    "adwin_accuracy": folded(concept.AdwinAccuracy(delta=0.9, new_sample_thresh=4), LABELS, "window_size", "mean", "variance"),
    "lfr_rates": lfr_rates,
    "lfr_stat": lfr_stat,
    "lfr_verdict": folded(LFR, LABELS, "r_tpr", "r_tnr", "r_ppv", "r_npv"),
    "md3_margin_density": md3_margin_density,
    "md3_oracle": md3_oracle,
    "md3_learned": md3_learned,
    "kdq_stream": folded(KDQ_STREAM, THREE, "distance", "critical"),
    "pca_cd_kl": folded(pca_cd.PcaCd(20, delta=0.01), THREE, "change_score"),
    "pca_cd_intersection": folded(pca_cd.PcaCd(20, delta=0.01, divergence_metric="intersection"), THREE, "change_score"),
    "elect_majority": elected(ensemble.majority()),
    "elect_minimum": elected(ensemble.minimum(2)),
    "elect_ordered": elected(ensemble.ordered(1, 1)),
    "elect_confirmed": elected(ensemble.Confirmed(2, 10)),
    "ensemble_stream": ensemble_stream,
    "ensemble_recs": ensemble_recs,
    "ensemble_selectors": ensemble_selectors,
}

_E = f"e AS (SELECT user_id, event_id, value, {Y_TRUE} AS t, {Y_PRED} AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
_NEXT = "FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1"
_RESET = "f.verdict IS NOT DISTINCT FROM 'drift'"


def _fold_sql(start: str, step: str, out: str) -> str:
    return f"""WITH RECURSIVE {_E}, f AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS verdict, CAST(0 AS BIGINT) AS since, {start} FROM e
      UNION ALL {step})
      SELECT user_id, event_id, {out} FROM f WHERE i > 0"""


def _since(*state: tuple[str, str]) -> str:
    """The row, the reset counter and the state as it stands before the row."""
    cols = ", ".join(f"CASE WHEN {_RESET} THEN {zero} ELSE f.{name} END AS {name}0" for name, zero in state)
    return f"SELECT e.user_id, e.i, e.event_id, e.value, e.t, e.p, CASE WHEN {_RESET} THEN 0 ELSE f.since END + 1 AS since, {cols} {_NEXT}"


_PH = _fold_sql(
    "0.0::DOUBLE AS mean, 0.0::DOUBLE AS s, 0.0::DOUBLE AS mn",
    f"""SELECT user_id, i, event_id, CASE WHEN s - mn > 1 * mean AND since > 10 THEN 'drift' END, since, mean, s, mn FROM (
      SELECT *, least(mn0, s) AS mn FROM (SELECT *, s0 + value - mean - 0.01::DOUBLE AS s FROM (SELECT *, mean0 + (value - mean0) / since AS mean FROM (
      {_since(("mean", "0.0::DOUBLE"), ("s", "0.0::DOUBLE"), ("mn", "0.0::DOUBLE"))}))))""",
    "verdict, i AS total, since",
)
_CUSUM = _fold_sql(
    "50.0::DOUBLE AS target, 30.0::DOUBLE AS sd, CAST([] AS DOUBLE[]) AS kept, 0.0::DOUBLE AS up, 0.0::DOUBLE AS low",
    f"""SELECT user_id, i, event_id, CASE WHEN since > 10 AND (up > 4 OR low > 4) THEN 'drift' END, since, target, sd, kept, up, low FROM (
      SELECT *, greatest(0, up0 + z - 0.005::DOUBLE) AS up, greatest(0, low0 - 0.005::DOUBLE - z) AS low FROM (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE (value - target) / sd END AS z FROM (
      SELECT e.user_id, e.i, e.event_id, e.value, CASE WHEN {_RESET} THEN 0 ELSE f.since END + 1 AS since, list_append(kept, e.value)[-10:] AS kept,
        CASE WHEN {_RESET} THEN list_avg(kept) ELSE target END AS target, CASE WHEN {_RESET} THEN list_stddev_pop(kept) ELSE sd END AS sd,
        CASE WHEN {_RESET} THEN 0.0::DOUBLE ELSE up END AS up0, CASE WHEN {_RESET} THEN 0.0::DOUBLE ELSE low END AS low0 {_NEXT})))""",
    "verdict, i AS total, since",
)
_REC = "CASE WHEN r1 IS NULL AND verdict IS NOT NULL THEN i - 1 ELSE r1 END"
_DDM = _fold_sql(
    "0.0::DOUBLE AS er, 0.0::DOUBLE AS sd, CAST('inf' AS DOUBLE) AS pm, CAST('inf' AS DOUBLE) AS sm, CAST(NULL AS BIGINT) AS r1, CAST(NULL AS BIGINT) AS r2",
    f"""SELECT user_id, i, event_id, verdict, since, er, sd, pm, sm, {_REC.replace('r1', 'r10')} AS r1, CASE WHEN verdict = 'drift' THEN i - 1 ELSE r20 END AS r2 FROM (
      SELECT *, CASE WHEN since < 10 THEN verdict0 WHEN er + sd >= pm + 1.5::DOUBLE * sd THEN 'drift' WHEN er + sd >= pm + 1.1::DOUBLE * sd THEN 'warning' END AS verdict FROM (
      SELECT *, CASE WHEN low THEN er ELSE pm0 END AS pm, CASE WHEN low THEN sd ELSE sm0 END AS sm FROM (
      SELECT *, since >= 10 AND er + sd <= pm0 + sm0 AS low FROM (
      SELECT *, sqrt(greatest(0, sd0 + (x - er) * (x - er0)) / since) AS sd FROM (SELECT *, er0 + (x - er0) / since AS er FROM (
      SELECT *, CAST(t <> p AS DOUBLE) AS x FROM ({_since(("er", "0.0::DOUBLE"), ("sd", "0.0::DOUBLE"), ("pm", "CAST('inf' AS DOUBLE)"), ("sm", "CAST('inf' AS DOUBLE)"), ("r1", "NULL"), ("r2", "NULL"), ("verdict", "NULL"))})))))))""",
    "verdict, i AS total, since, r1 AS rec_first, r2 AS rec_last, er AS error_rate, sd AS error_std",
)
_EDDM = _fold_sql(
    "CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS pos, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS sd, 0.0::DOUBLE AS top, CAST(NULL AS DOUBLE) AS ratio",
    f"""SELECT user_id, i, event_id, CASE WHEN NOT hit THEN verdict0 WHEN ratio <= 0.9::DOUBLE THEN 'drift' WHEN ratio <= 0.95::DOUBLE THEN 'warning' END, since, m, pos, mean, sd, top, ratio FROM (
      SELECT *, CASE WHEN hit AND top > 0 THEN reach / top WHEN hit THEN NULL ELSE ratio0 END AS ratio FROM (
      SELECT *, CASE WHEN hit THEN greatest(top0, reach) ELSE top0 END AS top FROM (
      SELECT *, t <> p AND m >= 5 AS hit, mean + 2 * sd AS reach FROM (
      SELECT *, CASE WHEN t <> p THEN sqrt(greatest(0, sd0 + (gap - mean) * (gap - mean0)) / m) ELSE sd0 END AS sd FROM (
      SELECT *, CASE WHEN t <> p THEN mean0 + (gap - mean0) / m ELSE mean0 END AS mean FROM (
      SELECT *, m0 + CAST(t <> p AS BIGINT) AS m, CASE WHEN t <> p THEN since - 1 ELSE pos0 END AS pos, CAST(since - 1 - pos0 AS DOUBLE) AS gap FROM (
      {_since(("m", "0"), ("pos", "0"), ("mean", "0.0::DOUBLE"), ("sd", "0.0::DOUBLE"), ("top", "0.0::DOUBLE"), ("ratio", "NULL"), ("verdict", "NULL"))})))))))""",
    "verdict, i AS total, since, ratio AS statistic",
)
#: 1 - Phi(T) < alpha is T > z; the quantiles of 0.05 and 0.2.
_STEPD = _fold_sql(
    "CAST([] AS BIGINT[]) AS win, CAST(0 AS BIGINT) AS older, CAST(NULL AS BIGINT) AS r1, CAST(NULL AS BIGINT) AS r2",
    f"""SELECT user_id, i, event_id, verdict, since, win, older, CASE WHEN since < 20 THEN r10 WHEN verdict IS NULL THEN NULL ELSE coalesce(r10, i - 1) END AS r1,
        CASE WHEN since < 20 THEN r20 WHEN verdict IS NULL THEN NULL WHEN r10 IS NULL THEN i - 1 ELSE r20 + 1 END AS r2 FROM (
      SELECT *, CASE WHEN since < 20 THEN verdict0 WHEN past > recent AND overall < 1 AND overall > 0 THEN CASE WHEN stat > 1.6448536269514715::DOUBLE THEN 'drift' WHEN stat > 0.8416212335729143::DOUBLE THEN 'warning' END END AS verdict FROM (
      SELECT *, CASE WHEN since >= 20 AND overall > 0 AND overall < 1 THEN (abs(past - recent) - 0.5::DOUBLE * k) / sqrt(overall * (1 - overall) * k) END AS stat FROM (
      SELECT *, CAST(older AS DOUBLE) / nullif(since - 10, 0) AS past, list_sum(win) / 10.0::DOUBLE AS recent, CAST(older + list_sum(win) AS DOUBLE) / since AS overall, 1.0::DOUBLE / nullif(since - 10, 0) + 0.1::DOUBLE AS k FROM (
      SELECT * REPLACE (CASE WHEN len(win) > 10 THEN win[2:] ELSE win END AS win), older0 + CASE WHEN len(win) > 10 THEN win[1] ELSE 0 END AS older FROM (
      SELECT *, list_append(win0, CAST(t = p AS BIGINT)) AS win FROM ({_since(("win", "CAST([] AS BIGINT[])"), ("older", "0"), ("r1", "NULL"), ("r2", "NULL"), ("verdict", "NULL"))}))))))""",
    "verdict, i AS total, since, r1 AS rec_first, r2 AS rec_last",
)
_TEN = "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN"
_CUSUM_REPLAY = f"""WITH RECURSIVE {_E}, w AS (SELECT *, avg(value) {_TEN} 9 PRECEDING AND CURRENT ROW) AS m, stddev_pop(value) {_TEN} 9 PRECEDING AND CURRENT ROW) AS d,
      avg(value) {_TEN} 10 PRECEDING AND 1 PRECEDING) AS pm, stddev_pop(value) {_TEN} 10 PRECEDING AND 1 PRECEDING) AS pd FROM e), f AS (
    SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS verdict, CAST(0 AS BIGINT) AS since,
      CAST(NULL AS DOUBLE) AS target, CAST(NULL AS DOUBLE) AS sd, 0.0::DOUBLE AS up, 0.0::DOUBLE AS low FROM e
    UNION ALL SELECT user_id, i, event_id, CASE WHEN since > 10 AND (up > 4 OR low > 4) THEN 'drift' END, since, target, sd, up, low FROM (
      SELECT *, CASE WHEN target IS NULL THEN up0 ELSE greatest(0, up0 + z - 0.005::DOUBLE) END AS up, CASE WHEN target IS NULL THEN low0 ELSE greatest(0, low0 - 0.005::DOUBLE - z) END AS low FROM (
      SELECT *, CASE WHEN sd = 0 THEN 0 ELSE (x - target) / sd END AS z FROM (
      SELECT s.*, r.value AS x, CASE WHEN target0 IS NULL AND s.since = 10 THEN s.m ELSE target0 END AS target, CASE WHEN target0 IS NULL AND s.since = 10 THEN s.d ELSE sd0 END AS sd FROM (
      SELECT e.user_id, e.i, e.event_id, e.m, e.d, CASE WHEN {_RESET} THEN 0 ELSE f.since END + 1 AS since, CASE WHEN {_RESET} THEN e.pm ELSE f.target END AS target0,
        CASE WHEN {_RESET} THEN e.pd ELSE f.sd END AS sd0, CASE WHEN {_RESET} THEN 0.0::DOUBLE ELSE f.up END AS up0, CASE WHEN {_RESET} THEN 0.0::DOUBLE ELSE f.low END AS low0
        FROM f JOIN w e ON e.user_id = f.user_id AND e.i = f.i + 1) s JOIN e r ON r.user_id = s.user_id AND r.i = s.since))))
    SELECT user_id, event_id, verdict, i AS total, since, round(up, 6) AS upper, round(low, 6) AS lower FROM f WHERE i > 0"""


def _adwin_sql(x: str, delta: float) -> str:
    """A step is a row that comes in or, while the window parts somewhere, an oldest bucket that goes; buckets stand in one list, oldest first."""

    def merged(level: int, inner: str) -> str:
        size = f"{1 << level}"
        one, two = "b[k]", "b[k + 1]"
        new = f"{{'l': {level + 1}, 's': {one}.s + {two}.s, 'v': {one}.v + {two}.v + {size} * ({one}.s / {size} - {two}.s / {size}) * ({one}.s / {size} - {two}.s / {size}) / 2}}"
        full = f"len(list_filter(b, lambda y: y.l = {level})) > 5"
        return f"""SELECT * EXCLUDE (b, k), CASE WHEN k IS NULL THEN b ELSE b[:k - 1] || [{new}] || b[k + 2:] END AS b FROM (
          SELECT *, CASE WHEN {full} THEN list_position(list_transform(b, lambda y: y.l), {level}) END AS k FROM ({inner}))"""

    rows = f"""SELECT f.user_id, coalesce(e.i, f.i) AS i, coalesce(e.event_id, f.event_id) AS event_id, f.pend, {x} AS x, f.size, f.sm, f.dev, f.b,
        CASE WHEN f.pend THEN f.since WHEN f.verdict IS NOT NULL THEN 1 ELSE f.since + 1 END AS since, CASE WHEN f.pend THEN 'drift' END AS verdict
        FROM f LEFT JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1 AND NOT f.pend WHERE f.pend OR e.i IS NOT NULL"""
    moved = f"""SELECT user_id, i, event_id, since, verdict, pend,
        CASE WHEN pend THEN rest ELSE size + 1 END AS size, CASE WHEN pend THEN sm - b[1].s ELSE sm + x END AS sm,
        CASE WHEN pend THEN CASE WHEN rest = 0 THEN 0 ELSE dev - (b[1].v + n1 * rest * (b[1].s / n1 - (sm - b[1].s) / rest) * (b[1].s / n1 - (sm - b[1].s) / rest) / (n1 + rest)) END
          WHEN size = 0 THEN dev ELSE dev + size * (x - sm / size) * (x - sm / size) / (size + 1) END AS dev,
        CASE WHEN pend THEN b[2:] ELSE list_append(b, {{'l': 0, 's': x, 'v': 0.0::DOUBLE}}) END AS b
        FROM (SELECT *, CAST(1 << b[1].l AS BIGINT) AS n1, size - CAST(1 << b[1].l AS BIGINT) AS rest FROM ({rows}))"""
    for level in range(6):
        moved = merged(level, moved)
    part = "list_sum(list_transform(b[:j], lambda y: y.s))"
    old = "list_sum(list_transform(b[:j], lambda y: CAST(1 << y.l AS BIGINT)))"
    harmonic, log = f"(1.0::DOUBLE / ({old} - 4) + 1.0::DOUBLE / (size - {old} - 4))", f"ln(2 * ln(size) / {delta}::DOUBLE)"
    cut = f"""{old} >= 5 AND size - {old} >= 5 AND abs({part} / {old} - (sm - {part}) / (size - {old})) > sqrt(2 * {harmonic} * dev / size * {log}) + 2.0::DOUBLE / 3 * {harmonic} * {log}"""
    step = f"""SELECT user_id, i, event_id, verdict, since, size, sm, dev, b,
        (pend OR (i % 4 = 0 AND size > 10)) AND coalesce(list_bool_or(list_transform(range(1, len(b) + CASE WHEN b[len(b)].l = 0 THEN 0 ELSE 1 END), lambda j: {cut})), FALSE) AS pend FROM ({moved})"""
    return f"""WITH RECURSIVE {_E}, f AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS verdict, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS size, 0.0::DOUBLE AS sm,
        0.0::DOUBLE AS dev, CAST([] AS STRUCT(l INTEGER, s DOUBLE, v DOUBLE)[]) AS b, FALSE AS pend FROM e UNION ALL {step})
      SELECT user_id, event_id, verdict, i AS total, since, size AS window_size, sm / size AS mean, dev / size AS variance FROM f WHERE i > 0 AND NOT pend"""


_LFR_CELLS = (("tn", 0, 0), ("fn", 1, 0), ("fp", 0, 1), ("tp", 1, 1))
_LFR_RATES = {"tpr": ("tp", "fn"), "tnr": ("tn", "fp"), "ppv": ("tp", "fp"), "npv": ("tn", "fn")}
_RATE = lambda name, mark: f"({_LFR_RATES[name][0]}{mark}::DOUBLE / ({_LFR_RATES[name][0]}{mark} + {_LFR_RATES[name][1]}{mark}))"
_LFR_STAT = _fold_sql(
    ", ".join([f"CAST(1 AS BIGINT) AS {c}" for c, _, _ in _LFR_CELLS] + [f"0.5::DOUBLE AS r_{n}" for n in _LFR_RATES]),
    f"""SELECT user_id, i, event_id, NULL, since, {', '.join(c for c, _, _ in _LFR_CELLS)},
        {', '.join(f"CASE WHEN {_RATE(n, '')} <> {_RATE(n, '0')} THEN 0.9::DOUBLE * r_{n} + (1 - 0.9::DOUBLE) * (t = p)::INT ELSE r_{n} END" for n in _LFR_RATES)} FROM (
      SELECT e.user_id, e.i, e.event_id, e.t, e.p, f.since, {', '.join(f"f.{c} AS {c}0, f.{c} + (e.t = {t} AND e.p = {p})::INT AS {c}" for c, t, p in _LFR_CELLS)}, {', '.join(f'f.r_{n}' for n in _LFR_RATES)} {_NEXT})""",
    ", ".join([f"r_{n}" for n in _LFR_RATES] + [f"{_RATE(n, '')} AS p_{n}" for n in _LFR_RATES]),
)
_MD3_ORACLE = _fold_sql(
    "CAST(0 AS BIGINT) AS total, 0.2::DOUBLE AS md, 0.2::DOUBLE AS rm, 0.05::DOUBLE AS rs, 0.8::DOUBLE AS ra, 0.1::DOUBLE AS rd, CAST(20 AS BIGINT) AS n, FALSE AS waiting, CAST([] AS DOUBLE[]) AS ins, CAST([] AS DOUBLE[]) AS oks",
    """SELECT user_id, i, event_id, CASE WHEN sample THEN CASE WHEN warn THEN 'warning' END WHEN label THEN CASE WHEN done AND ra - list_avg(oks) > 2 * rd THEN 'drift' END ELSE verdict END, since,
        total + sample::INT, CASE WHEN done THEN list_avg(ins) ELSE md END, CASE WHEN done THEN list_avg(ins) ELSE rm END, CASE WHEN done THEN list_stddev_pop(ins) ELSE rs END,
        CASE WHEN done THEN list_avg(oks) ELSE ra END, CASE WHEN done THEN list_stddev_pop(oks) ELSE rd END, CASE WHEN done THEN 5 ELSE n END, CASE WHEN done THEN FALSE ELSE waiting OR warn END,
        CASE WHEN done THEN [] ELSE ins END, CASE WHEN done THEN [] ELSE oks END FROM (
      SELECT *, label AND len(ins) = 5 AS done, sample AND abs(md - rm) > 2 * rs AS warn FROM (
      SELECT * REPLACE (CASE WHEN sample THEN ((n - 1)::DOUBLE / n) * CASE WHEN fresh THEN rm ELSE md END + (1 - (n - 1)::DOUBLE / n) * inside ELSE md END AS md, CASE WHEN fresh THEN 0 ELSE since END + sample::INT AS since,
        CASE WHEN label THEN list_append(ins, inside::DOUBLE) ELSE ins END AS ins, CASE WHEN label THEN list_append(oks, ok::DOUBLE) ELSE oks END AS oks) FROM (
      SELECT *, sample AND verdict IS NOT DISTINCT FROM 'drift' AS fresh FROM (
      SELECT e.user_id, e.i, e.event_id, f.* EXCLUDE (user_id, i, event_id), e.event_id % 3 <> 0 AND NOT f.waiting AS sample, e.event_id % 3 = 0 AND f.waiting AS label, (abs(e.value - 50) <= 10)::INT AS inside, (e.t = e.p)::INT AS ok """
    + _NEXT
    + "))))",
    "verdict, total, since, md AS margin_density, waiting, len(ins) AS labelled",
)
_RUN = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_VOTES = "(verdict_1 IS NOT DISTINCT FROM 'drift')::INT + (verdict_2 IS NOT DISTINCT FROM 'drift')::INT + (verdict_3 IS NOT DISTINCT FROM 'drift')::INT"


def _vote_sql(least: int) -> str:
    member = lambda i, sql: f"(SELECT user_id, event_id, verdict AS verdict_{i} FROM ({sql}))"
    return f"SELECT user_id, event_id, CASE WHEN {_VOTES} >= {least} THEN 'drift' END AS verdict FROM {member(1, _DDM)} JOIN {member(2, _EDDM)} USING (user_id, event_id) JOIN {member(3, _STEPD)} USING (user_id, event_id)"


def _confirmed_sql(sensitivity: int, wait_time: int) -> str:
    member = lambda i, sql: f"(SELECT user_id, event_id, total AS i, verdict AS v{i} FROM ({sql}))"
    hit = lambda i: f"(v{i} IS DISTINCT FROM 'warning' AND (f.w{i} > 0 OR v{i} IS NOT DISTINCT FROM 'drift'))::INT"
    warn = lambda i: f"(v{i} IS NOT DISTINCT FROM 'warning')::INT"
    every = lambda what: " + ".join(what(i) for i in (1, 2, 3))
    waits = ", ".join(f"CASE WHEN f.w{i} + {hit(i)} > {wait_time} THEN 0 ELSE f.w{i} + {hit(i)} END" for i in (1, 2, 3))
    return f"""WITH RECURSIVE m AS MATERIALIZED (SELECT a.user_id, a.event_id, a.i, v1, v2, v3 FROM {member(1, _DDM)} a JOIN {member(2, _EDDM)} b USING (user_id, event_id) JOIN {member(3, _STEPD)} c USING (user_id, event_id)),
      f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS verdict, 0 AS w1, 0 AS w2, 0 AS w3 FROM m
        UNION ALL SELECT m.user_id, m.i, m.event_id, CASE WHEN {every(hit)} >= {sensitivity} THEN 'drift' WHEN {every(hit)} + {every(warn)} >= {sensitivity} THEN 'warning' END, {waits}
          FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i + 1)
      SELECT user_id, event_id, verdict FROM f WHERE i > 0"""


ORACLE_SQL = {
    "cusum_replay": _CUSUM_REPLAY,
    "adwin_verdict": _adwin_sql("e.value", 0.3),
    "adwin_accuracy": _adwin_sql("(e.t = e.p)::DOUBLE", 0.9),
    "lfr_stat": _LFR_STAT,
    "md3_oracle": _MD3_ORACLE,
    "elect_confirmed": _confirmed_sql(2, 10),
    "ensemble_recs": f"""
        SELECT user_id, event_id, d.rec_first AS ddm_first, d.rec_last AS ddm_last, s.rec_first AS stepd_first, s.rec_last AS stepd_last FROM ({_DDM}) d JOIN ({_STEPD}) s USING (user_id, event_id)""",
    "ensemble_selectors": f"""
        SELECT user_id, event_id, a.verdict AS by_value, b.verdict AS by_rest, CASE WHEN a.verdict = 'drift' OR b.verdict = 'drift' THEN 'drift' END AS verdict
        FROM ({_PH}) a JOIN ({_PH.replace("event_id, value, CAST", "event_id, 100 - value AS value, CAST")}) b USING (user_id, event_id)""",
    "ph_trace": f"""
        WITH a AS (SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS units FROM events),
        m AS (SELECT *, units / 100.0::DOUBLE AS x, (sum(units) {_RUN})::DOUBLE / (100.0::DOUBLE * count(*) {_RUN}) AS mean FROM a),
        s AS (SELECT *, sum(x - mean - 0.01::DOUBLE) {_RUN} AS ph_sum FROM m),
        l AS (SELECT *, least(0, min(ph_sum) {_RUN}) AS ph_min, greatest(0, max(ph_sum) {_RUN}) AS ph_max FROM s)
        SELECT user_id, event_id, round(x, 6) AS x, round(mean, 6) AS mean, round(ph_sum, 6) AS ph_sum, round(ph_sum - ph_min, 6) AS difference,
          round(ph_min, 6) AS ph_min, round(ph_max, 6) AS ph_max, round(mean * 20, 6) AS theta FROM l""",
    "ph_verdict": _PH,
    "cusum_trace": _fold_sql(
        "0.0::DOUBLE AS up, 0.0::DOUBLE AS low",
        f"SELECT e.user_id, e.i, e.event_id, NULL, f.since, greatest(0, up + (value - 50) / 30.0::DOUBLE - 0.005::DOUBLE), greatest(0, low - 0.005::DOUBLE - (value - 50) / 30.0::DOUBLE) {_NEXT}",
        "round(up, 6) AS upper, round(low, 6) AS lower",
    ),
    "cusum_verdict": _CUSUM,
    "ddm": _DDM,
    "eddm": _EDDM,
    "stepd": _STEPD,
    "stepd_trace": f"""
        WITH {_E}, w AS (SELECT user_id, event_id, i AS n, sum((t = p)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING) AS s, sum((t = p)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS a FROM e),
        x AS (SELECT *, CASE WHEN n > 10 THEN (a - s)::DOUBLE / (n - 10) END AS past, CASE WHEN n >= 10 THEN s / 10.0::DOUBLE END AS recent, a::DOUBLE / n AS overall, CASE WHEN n > 10 THEN 1.0::DOUBLE / (n - 10) + 0.1::DOUBLE END AS k FROM w)
        SELECT user_id, event_id, past AS past_accuracy, recent AS recent_accuracy, overall AS overall_accuracy,
          CASE WHEN n >= 20 AND a > 0 AND a < n THEN round((abs(past - recent) - k * 0.5::DOUBLE) / sqrt(overall * (1 - overall) * k), 9) + 0.0 END AS statistic FROM x""",
    "lfr_rates": f"""
        WITH c AS (SELECT user_id, event_id, {', '.join(f"1 + sum(({Y_TRUE} = {t} AND {Y_PRED} = {p})::BIGINT) {_RUN} AS {n}" for n, t, p in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0)))} FROM events)
        SELECT user_id, event_id, tp::DOUBLE / (tp + fn)::DOUBLE AS tpr, tn::DOUBLE / (tn + fp)::DOUBLE AS tnr, tp::DOUBLE / (tp + fp)::DOUBLE AS ppv, tn::DOUBLE / (tn + fn)::DOUBLE AS npv FROM c""",
    "md3_margin_density": _fold_sql(
        "0.2::DOUBLE AS md",
        f"SELECT e.user_id, e.i, e.event_id, NULL, f.since, (19.0::DOUBLE / 20) * md + (1 - 19.0::DOUBLE / 20) * (abs(value - 50) <= 10)::INT {_NEXT}",
        "i AS total, md AS margin_density",
    ),
    "elect_majority": _vote_sql(2),
    "elect_minimum": _vote_sql(2),
    "elect_ordered": _vote_sql(2),
    "ensemble_stream": f"""
        SELECT user_id, event_id, d.verdict AS ddm, h.verdict AS ph, CASE WHEN d.verdict = 'drift' OR h.verdict = 'drift' THEN 'drift' END AS verdict
        FROM ({_DDM}) d JOIN ({_PH}) h USING (user_id, event_id)""",
}
