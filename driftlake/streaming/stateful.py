"""Any Step on a streaming DataFrame: state per key in the state store, rows sorted within each micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from driftlake.operators.fold import Step


def encode(state: dict) -> str:
    """State as JSON; numbers keep all their bits."""
    return json.dumps(state, default=lambda v: {"nd": v.tolist()} if isinstance(v, np.ndarray) else v.item())


def decode(text: str) -> dict:
    return json.loads(text, object_hook=lambda d: np.array(d["nd"]) if d.keys() == {"nd"} else d)


def run_stream(df: DataFrame, step: Step, key: Sequence[str], order: str, inputs: dict[str, Column | str] | None = None) -> DataFrame:
    """key, order, the step's output and late for every row of a streaming DataFrame; write with append.

    order is one column of whole numbers. Rows of a micro-batch are sorted by it within their key; a row that is not after the last one of its key in an earlier batch
    comes too late: it is given back with late = true and nulls, and changes nothing. Rows with a null argument are left out.
    """
    cols = {f"arg_{i}": (inputs or {}).get(n, n) for i, n in enumerate(step.inputs)}
    slim = df.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(key)), F.col(order).cast("long").alias("at"), *((F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()))
    slim = slim.where(F.col("at").isNotNull())
    for c in cols:
        slim = slim.where(F.col(c).isNotNull())
    out = StructType.fromDDL(step.output)
    schema = StructType([*(f for f in slim.schema.fields if f.name not in cols), *out.fields]).add("late", "boolean")
    args = list(cols)

    def fold(group: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last, state = (kept.get[0], decode(kept.get[1])) if kept.exists else (None, step.start())
        rows = pd.concat(list(parts), ignore_index=True).sort_values("at", kind="stable")
        found = []
        for at, *x in rows[["at", *args]].itertuples(index=False):
            late = last is not None and at <= last
            found.append((*group, at, *((None,) * len(out) if late else step.step(state, *x)), late))
        last = max(int(rows["at"].max()), last if last is not None else int(rows["at"].max()))
        kept.update((last, encode(state)))
        yield pd.DataFrame(found, columns=schema.names).astype(object)

    folded = slim.groupBy(*(f"key_{i}" for i in range(len(key)))).applyInPandasWithState(fold, schema, "last long, state string", "append", GroupStateTimeout.NoTimeout)
    return folded.toDF(*key, order, *out.names, "late")
