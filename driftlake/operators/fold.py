"""Keyed sequential folds: one state machine per key, rows in order, a verdict for every row.

A fold runs as a sort within hash partitions and a pass over Arrow batches: a task holds one batch and the state of one key, never a key's
rows, so a key of any length is safe. A single stream is serial by nature; parallelism is across keys. The same Step runs
on Structured Streaming (driftlake.streaming).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VERDICTS = ("drift", "warning", None)


class Step:
    """A state machine. inputs: names of its arguments; output: DDL of what it gives per row; state: a dict of plain values (numbers, strings, lists, dicts)."""

    inputs: Sequence[str] = ("x",)
    output = "verdict string"

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, s: dict, *x) -> tuple:
        """Changes s in place, returns the values of output."""
        raise NotImplementedError


class Detector(Step):
    """The lifecycle of stream detectors: a verdict stands until the next row, which starts a new epoch if it was drift.

    Gives verdict, total (rows seen), since (rows of the epoch), rec_first and rec_last (numbers from 0 of the rows recommended for training), then
    what `extra` names.
    """

    extra = ""
    recs = True

    @property
    def output(self) -> str:
        return "verdict string, total long, since long, rec_first long, rec_last long" + (f", {self.extra}" if self.extra else "")

    def epoch(self) -> dict:
        """State that a reset brings back."""
        return {}

    def lasting(self) -> dict:
        """State that survives a reset."""
        return {}

    def start(self) -> dict:
        return {"verdict": None, "total": 0, "since": 0, "first": None, "last": None, **self.epoch(), **self.lasting()}

    def over(self, s: dict) -> bool:
        """Whether the verdict of the row before ends the epoch."""
        return s["verdict"] == "drift"

    def reset(self, s: dict) -> None:
        s.update(verdict=None, since=0, first=None, last=None, **self.epoch())

    def observe(self, s: dict, *x) -> None:
        raise NotImplementedError

    def report(self, s: dict) -> tuple:
        return ()

    def recommend(self, s: dict) -> None:
        """First warning and drift of the epoch; a drift without warning stands for both."""
        here = s["total"] - 1
        if s["verdict"] is not None and s["first"] is None:
            s["first"] = here
        if s["verdict"] == "drift":
            s["last"] = here

    def step(self, s: dict, *x) -> tuple:
        if self.over(s):
            self.reset(s)
        s["total"] += 1
        s["since"] += 1
        self.observe(s, *x)
        return (s["verdict"], s["total"], s["since"], s["first"], s["last"], *self.report(s))


def run_fold(df: DataFrame, step: Step, key: Sequence[str], order: Sequence[str], inputs: dict[str, Column | str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """key, order, keep and the step's output for every row, folded by key in the given order.

    inputs: the step's arguments as columns or expressions of df (default: columns of the same names). Rows with a null argument
    are left out; null keys are a key of their own; rows equal in key and order come in no defined order, so order should tell rows
    apart. An empty table gives an empty result.
    """
    args = {n: (inputs or {}).get(n, n) for n in step.inputs}
    cols = {f"arg_{i}": (F.expr(c) if isinstance(c, str) else c) for i, c in enumerate(args.values())}
    named = {f"key_{i}": F.col(c) for i, c in enumerate([*key, *order, *keep])}
    slim = df.select(*(c.alias(n) for n, c in {**named, **cols}.items()))
    for c in cols:
        slim = slim.where(F.col(c).isNotNull())
    n_keys, n_named, n_args = len(key), len(named), len(cols)
    by = [f"key_{i}" for i in range(n_keys)]
    ordered = [f"key_{i}" for i in range(n_keys, n_keys + len(order))]
    dealt = slim.repartition(*by) if by else slim.coalesce(1)
    dealt = dealt.sortWithinPartitions(*by, *ordered)
    extra = StructType.fromDDL(step.output)
    schema = StructType([*(f for f in slim.schema.fields if f.name in named), *extra.fields])
    arrow, names = to_arrow_schema(extra), schema.names

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True) if n_keys else iter([()] * batch.num_rows)
            rows = zip(*(batch.column(n_named + i).to_pylist() for i in range(n_args)), strict=True)
            out = []
            for k, x in zip(keys, rows, strict=True):
                if k != now:
                    now, state = k, step.start()
                out.append(step.step(state, *x))
            if out:
                made = [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_named)] + made, names=names)

    folded = dealt.mapInArrow(fold, schema)
    return folded.toDF(*key, *order, *keep, *extra.names)
