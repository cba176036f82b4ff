"""Mixing sources to target weights along a curriculum that changes with training time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.llm.shared import fresh, numbered, prefix_sums, word_count, written

Knots = Sequence[tuple[float, float]]
WEIGHTS = (3, 1, 2)
#: For each weight, how it changes from the start (0) to the end (1) of training: linear between these points. Only the shape counts.
SCHEDULES: tuple[Knots, ...] = (((0, 1.5), (1, 0.5)), ((0, 1.0), (1, 1.0)), ((0, 0.5), (0.5, 0.75), (1, 1.5)))
#: Sources up to which their table (some 50 bytes a row) is broadcast to the documents.
BROADCAST_ROWS = 200_000


def inverse(share: Column, knots: Knots) -> Column:
    """The time at which a source has used up that share (0 to 1) of its demand: inverse of the integral of its schedule."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    y, out, base = share * sum(areas), None, sum(areas)
    for ((t0, w0), (t1, w1)), area in reversed([*zip(zip(knots, knots[1:], strict=False), areas, strict=True)]):
        base -= area
        z = F.greatest(y - base, F.lit(0.0)) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(float(w0 * w0)) + z * (2 * (w1 - w0)), F.lit(0.0)))
        t = F.lit(float(t0)) + F.coalesce(F.try_divide(z * 2, root + w0), F.lit(0.0)) * (t1 - t0)
        out = t if out is None else F.when(y < base + area, t).otherwise(out)
    return F.least(out, F.lit(float(knots[-1][0])))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, nth, target for a table (source, source_size) with a row per source.

    Sources by code point, null last, take the weights in turn and share `share` times the sum of sizes; none gets more than cap times its
    size, and the excess goes to the others by weight until none is above: target = min(cap * size, weight * level). The level comes from
    distributed prefix sums over the sources by the level at which each is full; one number comes to the driver.
    """
    ranked, _ = prefix_sums(sizes.withColumn("one", F.lit(1).cast("long")), ["source"], {"one": "nth"})
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("nth", F.lit(len(weights))).cast("int"))
    full = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap).withColumn("level", F.col("cap") / F.col("weight"))
    summed, path = prefix_sums(full, ["level", "nth"], {"cap": "caps", "weight": "weights"})
    total, all_weights = full.agg(F.sum("source_size"), F.sum("weight")).first()
    level = F.try_divide(F.lit(float(total or 0) * share) - F.col("caps"), F.lit(float(all_weights or 0)) - F.col("weights"))
    at = summed.select("level", level.alias("need")).where("level >= need").agg(F.min_by("need", "level")).first()[0]
    target = F.least("cap", F.col("weight") * at) if at is not None else F.col("cap")
    return full.select("source", "source_size", "nth", target.alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Knots] = SCHEDULES, share: float = 1.5, cap: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, positions (array<double>: when each copy is trained on), and keep.

    Size is the number of words (null texts: 0). In each source documents stand in an order by a hash of their id, then by size and keep, so reruns agree; pass after
    pass over it, the words up to the source's target are taken: a document is taken wholly, again in the next pass, and the last one in part.
    A copy that begins at word a of the target is trained on at the time at which the integral of the source's schedule reaches a /
    target. Null sources are a source of their own. Sources that hold most of the rows are cut into many ranges.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *keep)
    slim = slim.withColumn("turn", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    placed, path = prefix_sums(slim, ["turn", "id", "size", *keep], {"size": "start"}, "source")
    sizes, _ = written(slim.sparkSession.read.parquet(path).groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal, _ = written(targets(sizes, weights, share, cap).withColumnRenamed("source", "of"), "targets")
    side = F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal
    joined = placed.join(side, F.col("source").eqNullSafe(F.col("of")))
    passes = range(int(cap))
    begin = lambda e: F.col("start") + F.col("source_size") * e
    part = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - begin(e)))
    when = [F.when(part(e) > 0, _by_schedule(begin(e) / F.col("target"), schedules, len(weights))) for e in passes]
    return joined.select("id", "source", "size", "source_size", "target", sum((part(e) for e in passes), F.lit(0)).cast("long").alias("taken"), F.filter(F.array(*when), lambda t: t.isNotNull()).alias("positions"), *keep)


def _by_schedule(share: Column, schedules: Sequence[Knots], weights: int) -> Column:
    out = inverse(share, schedules[0])
    for i, knots in enumerate(schedules[1:weights], 1):
        out = F.when(F.pmod("nth", F.lit(weights)) % len(schedules) == i, inverse(share, knots)).otherwise(out)
    return out


def curriculum(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kwargs) -> DataFrame:
    """The documents (all columns) in training order: a row for each copy that the mix takes at least half of, range-sorted by position."""
    row, at, number = fresh(df, "row", "at", "number")
    marked = numbered(df, row)
    mixed = mix(marked, id_col, text_col, source_col, keep=[row], **kwargs)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(F.try_divide(F.col("taken") * 2 + F.col("size"), F.col("size") * 2))).cast("int")
    chosen = mixed.select(F.col(row).alias(number), F.slice("positions", 1, F.greatest(copies, F.lit(0))).alias(at)).where(F.size(at) > 0)
    taken = marked.join(chosen, F.col(row) == F.col(number)).withColumn(at, F.explode(at))
    return taken.repartitionByRange(F.col(at), F.col(row)).sortWithinPartitions(at, row).select(*df.columns)
