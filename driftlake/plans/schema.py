"""Checks of inputs before any job runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

VERDICTS = ("drift", "warning")


def validate(df: DataFrame, features: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """df, if it has all features as numbers and, given a reference, the same columns in the same order; else ValueError."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if missing := [c for c in features if c not in types]:
        raise ValueError(f"no such columns: {missing}")
    if wrong := [c for c in features if not isinstance(types[c], NumericType)]:
        raise ValueError(f"not numbers: {wrong}")
    if reference is not None and reference.columns != df.columns:
        raise ValueError("columns differ from those of the reference")
    return df


def batch_sizes(df: DataFrame, batch: str) -> DataFrame:
    """batch, n, valid: a batch needs two rows at least."""
    return df.groupBy(F.col(batch).alias("batch")).agg(F.count("*").alias("n")).withColumn("valid", F.col("n") > 1)


def check_batches(df: DataFrame, batch: str) -> DataFrame:
    """df, or ValueError if a batch has one row only."""
    if batch_sizes(df, batch).where(~F.col("valid")).limit(1).count():
        raise ValueError("a batch needs two rows at least")
    return df


def check_verdicts(df: DataFrame, col: str = "verdict") -> DataFrame:
    """df, with an error raised at run time for verdicts that are none."""
    return df.withColumn(col, F.when(F.col(col).isNull() | F.col(col).isin(*VERDICTS), F.col(col)).otherwise(F.raise_error(F.concat(F.lit("no verdict: "), F.col(col)))))
