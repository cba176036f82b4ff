"""Histogram density methods: each batch against all batches since the last drift, feature by feature.

The data meet Spark twice: a distance table over (start of the reference, batch, feature), computed in one job per epoch from distinct values, and a
fold of one row per batch that decides. A reference is a run of batches, so it is a filter, never a copy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions.density import DISTANCES, bound
from driftlake.functions.hashrng import uniform
from driftlake.functions.stats import t_quantile
from driftlake.operators.inject import with_index
from driftlake.sources.tables import settled

Divergence = str | Callable[[Column, Column], Column]
#: Rows of (start, batch, feature) edges up to which they are broadcast (some 60 bytes each); beyond, they are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Batches that the first job of an epoch compares with the reference; each further job takes twice as many, until drift.
AHEAD = 8
RESULT = "batch long, total long, since long, distance double, epsilon double, threshold double, verdict string, reference_from long, feature_distances array<double>, feature_epsilons array<double>, drift_feature string"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _distance(bins: DataFrame, keys: Sequence[str], divergence: Divergence) -> DataFrame:
    """keys, distance, from rows (keys, bin, r, t, ref_n, test_n, bins): counts of one bin on both sides."""
    r, t = F.col("r") / F.col("ref_n"), F.col("t") / F.col("test_n")
    if divergence == "H":
        return bins.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.sqrt(t) - F.sqrt(r), F.lit(2.0)))).alias("distance"))
    if divergence == "KL":
        half = lambda a, b: F.when(a > 0, a * F.log(a * 2 / (a + b))).otherwise(F.lit(0.0))
        return bins.groupBy(*keys).agg(F.sqrt(F.greatest(F.sum((half(r, t) + half(t, r)) / 2), F.lit(0.0))).alias("distance"))
    if divergence == "intersection":
        return bins.groupBy(*keys).agg((1 - F.sum(F.least(r, t))).alias("distance"))
    function = DISTANCES[divergence] if isinstance(divergence, str) else divergence
    dense = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "r", "t"))).alias("cells"), F.max("bins").alias("bins"))  # sqrt(rows) bins
    sides = bound(F.col("cells"), lambda cells: _filled(cells, F.col("bins")))
    return dense.select(*keys, bound(sides, lambda x: bound(F.struct(x["r"].alias("r"), x["t"].alias("t")), lambda s: function(s["r"], s["t"]))).alias("distance"))


def _filled(cells: Column, bins: Column) -> Column:
    """(r, t) of every bin from 0, zeros where there is no cell; cells: (bin, r, t) in order. Each cell brings the gap before it, so the work grows with the bins."""
    zero = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t"))
    before = lambda i: F.when(i > 0, F.get(cells, i - 1)["bin"]).otherwise(F.lit(-1))
    pieces = F.transform(cells, lambda c, i: F.concat(F.array_repeat(zero, c["bin"] - before(i) - 1), F.array(F.struct(c["r"].alias("r"), c["t"].alias("t")))))
    return F.concat(F.flatten(pieces), F.array_repeat(zero, bins - F.element_at(cells, -1)["bin"] - 1))


def _bin(v: Column) -> Column:
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    start = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5)
    return F.greatest(F.lit(0), F.least(F.floor((v - start) / span * F.col("bins")).cast("int"), F.col("bins") - 1))


def values(df: DataFrame, batch: str, features: Sequence[str]) -> DataFrame:
    """b, f (number of the feature), v, n: distinct values of each feature in each batch. Nulls and NaN are left out."""
    cells = F.array(*(F.col(f).cast("double") for f in features))
    long = df.select(F.col(batch).cast("long").alias("b"), F.posexplode(cells).alias("f", "v")).where(F.col("b").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    return long.groupBy("b", "f", "v").agg(F.count("*").alias("n"))


def edges(vals: DataFrame, batches: Sequence[int], starts: Sequence[int]) -> DataFrame:
    """start, batch, f, lo, hi, ref_n, test_n, bins for every batch after each start; the reference is the batches from start up to it."""
    stats = vals.groupBy("b", "f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"))
    spread = _spread(stats, batches, starts)
    test = F.col("b") == F.col("batch")
    met = spread.groupBy("start", "batch", "f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.when(~test, F.col("n")).otherwise(0)).alias("ref_n"), F.sum(F.when(test, F.col("n")).otherwise(0)).alias("test_n"))
    return met.withColumn("bins", F.greatest(F.floor(F.sqrt("ref_n")).cast("int"), F.lit(1))).where("ref_n > 0 AND test_n > 0")


def _spread(rows: DataFrame, batches: Sequence[int], starts: Sequence[int]) -> DataFrame:
    """rows (column b), once for every (start, batch) whose reference or test it belongs to."""
    later = F.array(*(F.lit(int(b)) for b in batches)).cast("array<bigint>")

    def of(start: Column) -> Column:
        mine = F.filter(later, lambda x: (x > start) & (x >= F.col("b")) & (F.col("b") >= start))
        return F.transform(mine, lambda x: F.struct(start.alias("start"), x.alias("batch")))

    pairs = [of(F.lit(int(s)).cast("long")) for s in starts]
    return rows.withColumn("pair", F.explode(F.flatten(F.array(*pairs)))).select(*rows.columns, "pair.start", "pair.batch")


def distance_table(df: DataFrame, batch: str, features: Sequence[str], divergence: Divergence = "H", starts: Sequence[int] | None = None, batches: Sequence[int] | None = None) -> DataFrame:
    """start, batch, f, distance, ref_n, test_n: the distance of every batch from the run of batches from start up to it, by feature.

    Values are counted per batch first, then spread over the pairs and binned: work grows with distinct values times batches. batches are whole numbers.
    """
    batches = batches or batch_numbers(df, batch)
    starts = batches[:-1] if starts is None else starts
    return _distances(values(df, batch, features), len(features), divergence, starts, batches)


def _distances(vals: DataFrame, features: int, divergence: Divergence, starts: Sequence[int], batches: Sequence[int]) -> DataFrame:
    """distance_table() of counted values."""
    cuts = edges(vals, batches, starts)
    rows = len(starts) * len(batches) * features
    e = cuts.select(F.col("start").alias("s_"), F.col("batch").alias("b_"), F.col("f").alias("f_"), "lo", "hi", "ref_n", "test_n", "bins")
    met = _spread(vals, batches, starts).join(_small(e, rows), (F.col("start") == F.col("s_")) & (F.col("batch") == F.col("b_")) & (F.col("f") == F.col("f_")))
    test = F.col("b") == F.col("batch")
    keys = ["start", "batch", "f", "ref_n", "test_n"]
    binned = met.groupBy(*keys, "bins", _bin(F.col("v")).alias("bin")).agg(F.sum(F.when(~test, F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(test, F.col("n")).otherwise(0)).alias("t"))
    return _distance(binned, keys, divergence).select("start", "batch", "f", "distance", "ref_n", "test_n")


def batch_numbers(df: DataFrame, batch: str) -> list[int]:
    """The distinct batches in order; one number for each comes to the driver."""
    return sorted(r[0] for r in df.select(F.col(batch).cast("long")).distinct().collect() if r[0] is not None)


def poisson_counts(key: Sequence[Column], subsets: int, mean: float, seed: int) -> Column:
    """For each subset how often a row is drawn: Poisson deviates by hashes of the row's key, so that a bootstrap is one pass without a join."""
    limits, p, total = [], math.exp(-mean), 0.0
    for i in range(12):
        total += p
        limits.append(total)
        p *= mean / (i + 1)
    drawn = F.array(*(uniform(seed, F.lit(s), *key) for s in range(subsets)))
    return F.transform(drawn, lambda u: sum(((u >= x).cast("int") for x in limits), F.lit(0)))


def first_epsilon(df: DataFrame, vals: DataFrame, batch: str, features: Sequence[str], start: int, at: int, divergence: Divergence, subsets: int, seed: int, key: Sequence[str]) -> float:
    """Bootstrapped epsilon before a second distance exists: subsets of the reference (with replacement, (1 - 1 / subsets) of its size on average), all
    distances between them (features summed), the sum of all differences between these, over the number of subsets. vals: values() of df."""
    here = vals.where((F.col("b") >= start) & (F.col("b") <= at))
    cuts = edges(here, [at], [start]).select(F.col("f").alias("f_"), "lo", "hi", "bins")
    ref = df.where((F.col(batch) >= start) & (F.col(batch) < at))
    cells = F.array(*(F.col(f).cast("double") for f in features))
    drawn = ref.select(poisson_counts([F.col(k) for k in key], subsets, 1 - 1 / subsets, seed).alias("draws"), F.posexplode(cells).alias("f", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    binned = drawn.join(F.broadcast(cuts), F.col("f") == F.col("f_"))  # one row per feature
    cols = [F.sum(F.get("draws", F.lit(i))).alias(f"c{i}") for i in range(subsets)]
    table = binned.groupBy("f", "bins", _bin(F.col("v")).alias("bin")).agg(*cols)
    pairs = [(i, j) for i in range(subsets) for j in range(i + 1, subsets)]
    totals = table.groupBy(F.col("f").alias("g")).agg(*(F.sum(f"c{i}").alias(f"n{i}") for i in range(subsets)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.col(f"c{i}").alias("r"), F.col(f"c{j}").alias("t"), F.col(f"n{i}").alias("ref_n"), F.col(f"n{j}").alias("test_n")) for k, (i, j) in enumerate(pairs))))
    both = table.join(F.broadcast(totals), F.col("f") == F.col("g")).select("f", "bin", "bins", each.alias("x")).select("f", "bin", "bins", "x.*")
    sums = _distance(both, ["pair", "f"], divergence).groupBy("pair").agg(F.sum("distance").alias("d")).collect()  # subsets * (subsets - 1) / 2 rows
    d = [r["d"] for r in sorted(sums, key=lambda r: r["pair"])]
    return sum(abs(a - b) for i, a in enumerate(d) for b in d[i + 1 :]) / subsets


def hdm(df: DataFrame, batch: str, features: Sequence[str], divergence: Divergence = "H", detect_batch: int = 1, statistic: str = "tstat", significance: float = 0.05, subsets: int = 5, order: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """One row per batch with its distance from the reference, epsilon, threshold and verdict; the first batch is the first reference.

    detect_batch: the number of the batch of an epoch from which drift can be found: 1 (the reference is halved by `order` to get a first distance), 2 or 3. statistic: "tstat" or
    "stdev". After drift the drifted batch is the reference, otherwise the batch joins it. drift_feature: the feature whose distance grew most, with several features. The driver
    holds a few numbers per batch. Distinct values are counted once and written; an epoch is compared in jobs of 8, 16, 32... batches until drift, so that
    little is computed that its end makes void.
    """
    if detect_batch not in (1, 2, 3):
        raise ValueError("detect_batch must be 1, 2 or 3")
    if detect_batch == 1 and not order:
        raise ValueError("detect_batch=1 halves a batch by row order: name the columns of order")
    spark = df.sparkSession
    slim = df.select(F.col(batch).cast("long").alias("b_"), *dict.fromkeys([*features, *order]))
    numbers = {b: i for i, b in enumerate(batch_numbers(slim, "b_"))}
    names = list(numbers)
    if not names:
        return spark.createDataFrame([], RESULT)
    coded = slim.withColumn("b_", F.array_position(F.array(*(F.lit(b) for b in names)), F.col("b_")) - 1) if names != [*range(len(names))] else slim
    key = list(order) or list(features)
    total = since = lam = 0
    eps: list[float] = []
    eps_sum = 0.0
    prev, prev_f = 0.0, [0.0] * len(features)
    out = []

    vals = settled(values(coded, "b_", features)) if len(names) > 1 else values(coded, "b_", features)

    def table(counted: DataFrame, start: int, after: int, upto: int) -> dict[int, tuple[list[float], int, int]]:
        """By batch, of those after `after`: distances by feature, rows of the reference, rows of the batch."""
        found: dict[int, dict[int, tuple]] = {}
        here = counted.where((F.col("b") >= start) & (F.col("b") <= upto))
        for r in _distances(here, len(features), divergence, [start], [*range(after + 1, upto + 1)]).collect():  # batches times features
            found.setdefault(r["batch"], {})[r["f"]] = (r["distance"], r["ref_n"], r["test_n"])
        return {t: ([x.get(i, (0.0, 0, 0))[0] for i in range(len(features))], max(v[1] for v in x.values()), max(v[2] for v in x.values())) for t, x in found.items()}

    def threshold(ref_n: int, test_n: int) -> float:
        nonlocal eps_sum
        if since == 3 and detect_batch != 3:
            eps_sum -= eps.pop(0)
        scale = 1 if since == 2 and detect_batch != 3 else total - lam - 1
        eps_sum += eps[-2]
        mean = eps_sum / scale
        sd = math.sqrt(sum((e - mean) ** 2 for e in eps[:-1]) / scale)
        if statistic == "tstat":
            return mean + t_quantile(1 - significance / 2, ref_n + test_n - 2) * sd / math.sqrt(scale)
        return mean + significance * sd

    def update(distances: list[float], ref_n: int, test_n: int, start: int, at: int, label: int | None) -> bool:
        nonlocal total, since, lam, prev, prev_f
        total, since = total + 1, since + 1
        distance = sum(distances) / len(distances)
        f_eps = [a - b for a, b in zip(distances, prev_f, strict=True)] if total > 1 else None
        epsilon = beta = None
        if since >= 2:
            if since == 2 and detect_batch != 3:
                eps.append(first_epsilon(coded, vals, "b_", features, start, at, divergence, subsets, seed + total, key))
            epsilon = abs(distance - prev)
            eps.append(epsilon)
            if detect_batch != 3 or since >= 3:
                beta = threshold(ref_n, test_n)
        drift = beta is not None and epsilon > beta
        if drift:
            lam = total
        else:
            prev, prev_f = distance, distances
        if label is not None:
            worst = features[max(range(len(features)), key=lambda i: (f_eps[i], -i))] if drift and f_eps and len(features) > 1 else None
            out.append((names[label], total, since, distance, epsilon, beta, "drift" if drift else None, names[start], distances, f_eps, worst))
        return drift

    def begin(start: int) -> None:
        nonlocal since, eps, eps_sum
        since, eps, eps_sum = 0, [], 0.0
        if detect_batch == 1:
            rows = with_index(coded.where(F.col("b_") == start), order, "at_")
            half = rows.count() // 2
            halves = rows.withColumn("b_", (F.col("at_") >= half).cast("long"))
            for d, ref_n, test_n in table(values(halves, "b_", features), 0, 0, 1).values():
                update(d, ref_n, test_n, start, start, None)

    start, drifted = 0, False
    begin(0)
    out.append((names[0], total, since, None, None, None, None, names[0], None, None, None))
    known, upto, ahead = {}, 0, AHEAD
    for t in range(1, len(names)):
        if drifted:
            start = t - 1
            begin(start)
            known, upto, ahead = {}, start, AHEAD
        if t > upto:
            known = table(vals, start, upto, min(upto + ahead, len(names) - 1))
            upto, ahead = min(upto + ahead, len(names) - 1), 2 * ahead
        drifted = t in known and update(*known[t], start, t, t)
    return spark.createDataFrame(out, RESULT)


def hdddm(df: DataFrame, batch: str, features: Sequence[str], **kwargs) -> DataFrame:
    """Hellinger distance, many features."""
    return hdm(df, batch, features, **{"divergence": "H", **kwargs})


def cdbd(df: DataFrame, batch: str, feature: str, **kwargs) -> DataFrame:
    """Jensen-Shannon distance of one feature, such as a classifier's confidence."""
    if not isinstance(feature, str):
        raise ValueError("one feature only")
    return hdm(df, batch, [feature], **{"divergence": "KL", **kwargs})
