"""Ensembles: many detectors over one input, and elections among their verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.operators.fold import Detector, Step, run_fold

#: From an array of verdicts, one per member in the order of the members, to the verdict of the whole.
Election = Callable[[Column], Column]


def _drifts(verdicts: Column) -> Column:
    return F.size(F.filter(verdicts, lambda v: F.coalesce(v == "drift", F.lit(False))))


def _if(condition: Column) -> Column:
    return F.when(condition, F.lit("drift"))


def majority() -> Election:
    """Drift if more than half of the members say so."""
    return lambda v: _if(_drifts(v) > F.floor(F.size(v) / 2))


def minimum(approvals_needed: int = 1) -> Election:
    """Drift if that many members say so, and one at least."""
    return lambda v: _if(_drifts(v) >= max(1, approvals_needed)) if approvals_needed > 0 else _if(F.size(v) > 0)


def ordered(approvals_needed: int = 1, confirmations_needed: int = 1) -> Election:
    """Drift if the members that alarm first, in order, approve and later ones confirm: all in all, as many alarms as both numbers together."""
    return lambda v: _if(_drifts(v) >= max(1, approvals_needed + confirmations_needed))


class Confirmed(Detector):
    """An alarm waits up to wait_time rows for others to confirm it; run as a fold over the array of verdicts."""

    inputs = ("verdicts",)
    extra = "waits array<int>"

    def __init__(self, sensitivity: int, wait_time: int):
        self.sensitivity, self.wait_time = sensitivity, wait_time

    def lasting(self):
        return {"waits": None}

    def over(self, s):
        return False

    def observe(self, s, verdicts):
        waits = s["waits"] or [0] * len(verdicts)
        drifts = warnings = 0
        for i, v in enumerate(verdicts):
            if v == "warning":
                warnings += 1
            elif waits[i] or v == "drift":
                drifts += 1
                waits[i] += 1
        s["verdict"] = "drift" if drifts >= self.sensitivity else "warning" if drifts + warnings >= self.sensitivity else None
        s["waits"] = [0 if w > self.wait_time else w for w in waits]

    def report(self, s):
        return (list(s["waits"]),)


def members_of(traces: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """on, verdicts (array in the order of traces; null where a member has no row or no verdict), drift_states (map) and, where members give them, retraining_recs (map).

    traces: for each member rows (on, verdict[, rec_first, rec_last]). One aggregation over the union, no joins.
    """
    names = list(traces)

    def rows(i: int, name: str) -> DataFrame:
        t = traces[name]
        recs = F.struct(F.col("rec_first").cast("long").alias("first"), F.col("rec_last").cast("long").alias("last")) if "rec_first" in t.columns else F.lit(None).cast("struct<first:bigint,last:bigint>")
        return t.select(*on, F.lit(i).alias("i_"), F.col("verdict").alias("v_"), recs.alias("r_"))

    union = reduce(lambda a, b: a.unionByName(b), (rows(i, n) for i, n in enumerate(names)))
    pick = lambda c, i: F.max(F.when(F.col("i_") == i, F.col(c)))
    met = union.groupBy(*on).agg(*(pick("v_", i).alias(f"v_{i}") for i in range(len(names))), *(pick("r_", i).alias(f"r_{i}") for i in range(len(names))))
    verdicts = F.array(*(F.col(f"v_{i}") for i in range(len(names))))
    pairs = lambda p: F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(F.col(f"{p}_{i}") for i in range(len(names)))))
    return met.select(*on, verdicts.alias("verdicts"), pairs("v").alias("drift_states"), F.map_filter(pairs("r"), lambda _, r: r.isNotNull()).alias("retraining_recs"))


def elect(members: DataFrame, election: Election | Confirmed, key: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """members with column verdict. Confirmed elections fold along order within key; the others look at each row alone."""
    if isinstance(election, Confirmed):
        kept = [c for c in members.columns if c not in (*key, *order)]
        return run_fold(members, election, key, order, keep=kept).select(*members.columns, "verdict")
    return members.withColumn("verdict", election(F.col("verdicts")))


class Together(Step):
    """Several detectors over the same rows, in one pass: each takes its arguments out of a struct of its own, and passes over rows where one is null."""

    output = "verdicts array<string>, seen array<boolean>, firsts array<long>, lasts array<long>"

    def __init__(self, detectors: dict[str, Detector]):
        self.detectors = list(detectors.values())
        self.inputs = tuple(f"of_{i}" for i in range(len(self.detectors)))

    def start(self) -> dict:
        return {"members": [d.start() for d in self.detectors]}

    def step(self, s: dict, *arguments) -> tuple:
        out = []
        for detector, state, x in zip(self.detectors, s["members"], arguments, strict=True):
            values = [x[n] for n in detector.inputs]
            if any(v is None for v in values):
                out.append((None, False, None, None))
            else:
                verdict, _, _, first, last, *_ = detector.step(state, *values)
                out.append((verdict, True, first, last))
        return tuple(map(list, zip(*out, strict=True)))


def stream_members(
    df: DataFrame,
    detectors: dict[str, Detector],
    key: Sequence[str],
    order: Sequence[str],
    inputs: dict[str, dict] | None = None,
) -> DataFrame:
    """key, order, verdicts, drift_states and retraining_recs as members_of() gives them, from one fold over df: one scan, one shuffle, one sort.

    Rows that no member can read, for nulls in its arguments, are left out; a member that cannot read a row has no verdict and no recommendation there.
    Repeated rows are rows of their own. inputs: for each detector its arguments as columns or expressions.
    """
    names = list(detectors)
    given = [{n: (inputs or {}).get(name, {}).get(n, n) for n in d.inputs} for name, d in detectors.items()]
    column = lambda c: F.expr(c) if isinstance(c, str) else c
    arguments = [F.struct(*(column(c).alias(n) for n, c in g.items())) for g in given]
    read = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (column(c).isNotNull() for c in g.values())) for g in given))
    found = run_fold(df.where(read), Together(detectors), key, order, {f"of_{i}": a for i, a in enumerate(arguments)})
    labels = F.array(*(F.lit(n) for n in names))
    recs = F.transform(F.arrays_zip("seen", "firsts", "lasts"), lambda r: F.when(r["seen"], F.struct(r["firsts"].alias("first"), r["lasts"].alias("last"))))
    return found.select(
        *key,
        *order,
        "verdicts",
        F.map_from_arrays(labels, F.col("verdicts")).alias("drift_states"),
        F.map_filter(F.map_from_arrays(labels, recs), lambda _, r: r.isNotNull()).alias("retraining_recs"),
    )


def stream_ensemble(
    df: DataFrame,
    detectors: dict[str, Detector],
    key: Sequence[str],
    order: Sequence[str],
    inputs: dict[str, dict] | None = None,
    selectors: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    election: Election | Confirmed | None = None,
) -> DataFrame:
    """Every detector over df (through its selector, if any), and the election. inputs: for each detector its arguments as columns.

    Without selectors all members are met in one fold; a selector gives its member a table of its own, so then each folds apart.
    """
    on = [*key, *order]
    if not selectors:
        return elect(stream_members(df, detectors, key, order, inputs), election or majority(), key, order)
    traces = {}
    for name, detector in detectors.items():
        mine = selectors.get(name, lambda x: x)(df)
        traces[name] = run_fold(mine, detector, key, order, (inputs or {}).get(name)).select(*on, "verdict", "rec_first", "rec_last")
    return elect(members_of(traces, on), election or majority(), key, order)


def batch_ensemble(traces: dict[str, DataFrame], batch: str, election: Election | Confirmed | None = None) -> DataFrame:
    """The election over the verdicts of batch detectors, one row per batch."""
    return elect(members_of(traces, [batch]), election or majority(), [], [batch])
