"""Drift put into tables: all injectors give a new DataFrame. `index` names a column with row numbers from 0; ranges are [start, stop)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.hashrng import gamma_of, uniform
from driftlake.sources.tables import settled


def _check(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such columns: {missing}")


def _inside(index: str, start: int, stop: int) -> Column:
    return (F.col(index) >= start) & (F.col(index) < stop)


def with_index(df: DataFrame, order: Sequence[str], index: str = "row_idx") -> DataFrame:
    """df with row numbers from 0 in the given order: ranges are written once, then numbered in parallel from their sizes."""
    cut = settled(df.repartitionByRange(*order).withColumn("pid_", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("pid_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select(F.col("pid_").alias("p_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    local = cut.withColumn("at_", F.row_number().over(Window.partitionBy("pid_").orderBy(*order)) - 1)
    joined = local.join(offsets, F.col("pid_") == F.col("p_"))
    return joined.select(*df.columns, (F.col("base_") + F.col("at_")).cast("long").alias(index))


def feature_shift(df: DataFrame, index: str, start: int, stop: int, col: str, shift_factor: float, alpha: float = 0.001) -> DataFrame:
    """Adds shift_factor * (alpha + mean over the range) inside the range."""
    _check(df, index, col)
    mean = df.where(_inside(index, start, stop)).agg(F.avg(col)).first()[0]
    delta = shift_factor * (alpha + (mean if mean is not None else 0.0))
    return df.withColumn(col, F.when(_inside(index, start, stop), F.col(col) + delta).otherwise(F.col(col).cast("double")))


def feature_swap(df: DataFrame, index: str, start: int, stop: int, col_1: str, col_2: str) -> DataFrame:
    """Exchanges two columns inside the range."""
    _check(df, index, col_1, col_2)
    swap = lambda a, b: F.when(_inside(index, start, stop), F.col(b)).otherwise(F.col(a))
    return df.withColumns({col_1: swap(col_1, col_2), col_2: swap(col_2, col_1)})


def feature_cover(df: DataFrame, col: str, sample_size: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """sample_size // groups rows of each group of col, drawn without replacement by a hash of key; col is left out."""
    _check(df, col, *key)
    n = sample_size // max(1, df.select(col).distinct().count())
    turn = F.row_number().over(Window.partitionBy(col).orderBy(uniform(seed, *(F.col(k) for k in key)), *key))
    return df.withColumn("turn_", turn).where(F.col("turn_") <= n).drop("turn_", col)


def label_swap(df: DataFrame, index: str, start: int, stop: int, target: str, class_1, class_2) -> DataFrame:
    """Exchanges two classes inside the range."""
    _check(df, index, target)
    t, here = F.col(target), _inside(index, start, stop)
    return df.withColumn(target, F.when(here & (t == class_1), F.lit(class_2)).when(here & (t == class_2), F.lit(class_1)).otherwise(t))


def label_join(df: DataFrame, index: str, start: int, stop: int, target: str, class_1, class_2, new_class) -> DataFrame:
    """Two classes become a new one inside the range."""
    _check(df, index, target)
    t = F.col(target)
    return df.withColumn(target, F.when(_inside(index, start, stop) & t.isin(class_1, class_2), F.lit(new_class)).otherwise(t))


def class_weights(counts: dict, every_class: Sequence, probabilities: dict) -> dict:
    """The weight of a row of each class of the range: its class's share over its rows; classes not named share what is left; what absent classes leave is
    spread over all rows."""
    if sum(probabilities.values()) > 1 + 1e-12:
        raise ValueError("probabilities add up to more than 1")
    if unknown := set(probabilities) - set(every_class):
        raise ValueError(f"classes not in the data: {sorted(map(str, unknown))}")
    open_classes = [c for c in every_class if c not in probabilities]
    left = 1 - sum(probabilities.values())
    share = {c: probabilities.get(c, left / len(open_classes) if open_classes else 0.0) for c in every_class}
    each = {c: share[c] / n for c, n in counts.items() if n}
    rows = sum(counts.values())
    spare = (1 - sum(each[c] * counts[c] for c in each)) / rows if rows else 0.0
    return {c: w + spare for c, w in each.items()}


def label_probability(df: DataFrame, index: str, start: int, stop: int, target: str, probabilities: dict, seed: int = 0) -> DataFrame:
    """The rows of the range are drawn again from it, with replacement, so that classes have the given probabilities.

    Row index i takes the row at which the cumulative weight of the range (by class, then index) first passes a hash of i: class from the few class
    totals, then the place in the class, so a draw is an equi-join on (class, place). Places are numbered in parallel. Classes are gathered on the driver.
    """
    _check(df, index, target)
    every = sorted((r[0] for r in df.select(target).distinct().collect()), key=lambda c: (c is None, c))
    here = df.where(_inside(index, start, stop))
    counts = {r[0]: r[1] for r in here.groupBy(target).count().collect()}
    weight = class_weights(counts, every, probabilities)
    if not weight:
        return df
    others = [c for c in df.columns if c != index]
    numbered = with_index(here, [target, index], "at_")
    firsts = numbered.groupBy(F.col(target).alias("class_")).agg(F.min("at_").alias("first_"))  # a row per class
    placed = numbered.join(F.broadcast(firsts), F.col(target).eqNullSafe(F.col("class_")))
    numbers = placed.select("class_", (F.col("at_") - F.col("first_")).alias("place_"), *others)
    u = uniform(seed, F.col(index))
    low, pick = 0.0, None
    chosen = sorted(weight, key=lambda c: (c is None, c))
    for i, c in enumerate(chosen):
        place = F.least(F.greatest(F.floor((u - low) / weight[c]), F.lit(0)), F.lit(counts[c] - 1)).cast("long") if weight[c] > 0 else F.lit(0).cast("long")
        one = F.struct(F.lit(c).alias("class_"), place.alias("place_"))
        low += weight[c] * counts[c]
        if i + 1 == len(chosen):
            pick = one if pick is None else pick.otherwise(one)
        else:
            pick = F.when(u < low, one) if pick is None else pick.when(u < low, one)
    draws = here.select(index, pick.alias("pick_")).select(index, F.col("pick_.class_").alias("c_"), F.col("pick_.place_").alias("p_"))
    drawn = draws.join(numbers, F.col("c_").eqNullSafe(F.col("class_")) & (F.col("p_") == F.col("place_"))).select(*df.columns)
    return df.where(~_inside(index, start, stop)).unionByName(drawn)


def label_dirichlet(df: DataFrame, index: str, start: int, stop: int, target: str, alpha: dict, seed: int = 0) -> DataFrame:
    """label_probability() with probabilities drawn from Dirichlet(alpha): shares of gamma deviates by hashes of seed and class."""
    if not alpha or min(alpha.values()) <= 0:
        raise ValueError("alpha must be positive")
    drawn = {c: gamma_of(seed, a, "dirichlet", c) for c, a in alpha.items()}
    return label_probability(df, index, start, stop, target, {c: g / sum(drawn.values()) for c, g in drawn.items()}, seed)


def brownian_noise(df: DataFrame, index: str, start: int, stop: int, col: str, x0: float, seed: int = 0) -> DataFrame:
    """Adds a random walk over the range: x0 at its first row, then steps of 1 / sqrt(rows), up or down by a hash of the row number.

    The walk is a prefix sum over the range only; blocks of 100,000 row numbers are summed in parallel first.
    """
    _check(df, index, col)
    inside = df.where(_inside(index, start, stop)).select(F.col(index).alias("i_"))
    up = F.when(F.col("i_") == start, 0).when(uniform(seed, F.col("i_")) < 0.5, -1).otherwise(1)
    steps = inside.select("i_", F.floor(F.col("i_") / 100_000).alias("b_"), up.cast("long").alias("up_"))
    before = Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    bases = steps.groupBy("b_").agg(F.sum("up_").alias("s_")).select(F.col("b_").alias("k_"), F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("base_"))
    local = F.sum("up_").over(Window.partitionBy("b_").orderBy("i_").rowsBetween(Window.unboundedPreceding, 0))
    walk = steps.withColumn("local_", local).join(bases, F.col("b_") == F.col("k_")).select("i_", (F.col("base_") + F.col("local_")).alias("walk_"))
    joined = df.join(walk, F.col(index) == F.col("i_"), "left")
    unit = 1 / math.sqrt(max(1, stop - start))
    value = F.when(F.col("walk_").isNotNull(), F.col(col) + x0 + F.col("walk_") * unit).otherwise(F.col(col).cast("double"))
    return joined.withColumn(col, value).select(*df.columns)
