"""Nearest-neighbour density: a k-nearest-neighbour graph over two samples, and how unevenly they share neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.stats import normal_quantile
from driftlake.operators.hdm import batch_numbers
from driftlake.operators.inject import with_index
from driftlake.sources.tables import settled

#: Points for which a task searches: fewer tasks than cores if they would get fewer than BLOCK, and never more than MOST in one (about).
BLOCK, MOST = 1024, 32_768
#: Points of a task that are compared at once with a batch of others.
CHUNK = 256
NONE = 2**63 - 1


def points_of(first: DataFrame, second: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """id (from 0, in the order of the coordinates), x, in_1, in_2 for the distinct points of both samples. Rows with nulls are left out.

    features: columns of numbers, or the name of one column of arrays that are all of one length.
    """
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(f).cast("double") for f in features))
    side = lambda df, one: df.select(x.alias("x"), F.lit(one).alias("in_1"), F.lit(1 - one).alias("in_2")).where(F.forall("x", lambda v: v.isNotNull()))
    distinct = side(first, 1).unionByName(side(second, 0)).groupBy("x").agg(F.max("in_1").alias("in_1"), F.max("in_2").alias("in_2"))
    return settled(with_index(distinct, ["x"], "id"), "points")


class Nearest:
    """The k nearest of points p among all that were met, exactly: by the sum of squares over the components in their order, ties to the smaller id.

    A product of matrices in single precision, around the mean of p, gives every squared distance up to a bound on its error; what may be among the k nearest by it is computed again in
    full. Where single precision does not reach, everything is.
    """

    def __init__(self, ids: np.ndarray, p: np.ndarray, k: int):
        self.ids, self.p, self.k = ids, p, k
        self.square, self.near = np.full((len(p), k), np.nan), np.full((len(p), k), NONE, np.int64)
        with np.errstate(all="ignore"):
            self.centre = p.mean(0)
            x, self.norm, self.top = self._around(p)
            self.rows = np.hstack([-2 * x, (self.norm**2)[:, None], np.ones((len(p), 1))]).astype(np.float32)

    def _around(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """x around the centre, its norms, and the greatest number that took part."""
        y = x - self.centre
        return y, np.sqrt((y**2).sum(1)), float(max(np.abs(x).max(initial=0), np.abs(self.centre).max(initial=0)))

    def meet(self, ids: np.ndarray, q: np.ndarray) -> None:
        if not len(q):
            return
        with np.errstate(all="ignore"):
            y, norm, top = self._around(q)
            columns = np.hstack([y, np.ones((len(q), 1)), (norm**2)[:, None]]).astype(np.float32).T
            d = q.shape[1]
            for i in range(0, len(self.p), CHUNK):
                p, worst = self.p[i : i + CHUNK], self.square[i : i + CHUNK, -1]
                reach = self.norm[i : i + CHUNK] + norm.max()
                if not reach.max() < 1e18:
                    r, c = np.divmod(np.arange(len(p) * len(q)), len(q))
                else:
                    moved = 2 * d**0.5 * 2.0**-52 * max(top, self.top)  # by the shift to the centre
                    slack = (d + 8) * 2.0**-23 * reach**2 + 2 * moved * reach + moved**2 + (d + 8) * 1e-37
                    rough = self.rows[i : i + CHUNK] @ columns
                    limit = np.where(np.isnan(worst), np.inf, worst)
                    if np.isinf(limit).any() and len(q) >= self.k:
                        limit = np.minimum(limit, np.partition(rough, self.k - 1, 1)[:, self.k - 1] + slack)
                    limit = np.nextafter((limit + slack).astype(np.float32), np.float32(np.inf))
                    r, c = np.divmod(np.flatnonzero(rough <= limit[:, None]), len(q))
                if len(r):
                    gap = np.zeros(len(r))
                    for j in range(d):
                        gap += (p[r, j] - q[c, j]) ** 2
                    self._merge(i, r, gap, ids[c])

    def _merge(self, i: int, r: np.ndarray, gap: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(r)
        of, square, near = np.r_[np.repeat(rows, self.k), r], np.r_[self.square[i + rows].ravel(), gap], np.r_[self.near[i + rows].ravel(), ids]
        order = np.lexsort((near, square, of))
        take = order[np.searchsorted(of[order], rows)[:, None] + np.arange(self.k)]
        self.square[i + rows], self.near[i + rows] = square[take], near[take]

    def found(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), 4096):
            near, square = self.near[i : i + 4096], self.square[i : i + 4096]
            on = near.ravel() != NONE
            src, rank = np.repeat(self.ids[i : i + 4096], self.k), np.tile(np.arange(1, self.k + 1, dtype=np.int32), len(near))
            yield pa.RecordBatch.from_arrays([pa.array(v[on]) for v in (src, near.ravel(), rank, square.ravel())], ["src", "dst", "rank", "square"])


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """src, dst, rank (1: nearest), squared distance: exactly the k nearest points (Euclidean) of every point, itself among them; ties to the smaller id.

    points: (id long, x array<double>). Each task holds at most some MOST points and their k nearest so far, and all points pass it once, of equal ones only the k of the smallest ids, which
    are all that can be found. The comparisons are quadratic in the number of points, as exactness asks; the shuffle takes every point once for each task.
    """
    n, cores = points.count(), points.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(cores, -(-n // BLOCK))) if n <= MOST * cores else cores * -(-n // (MOST * cores))
    turn = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    left = points.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("a"), F.lit(0).alias("side"), "id", "x")
    right = points.select("id", "x").withColumn("turn_", turn).where(F.col("turn_") <= k)
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("a"), F.lit(1).alias("side"), "id", "x")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, task = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("a").to_numpy() * 2 + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                a, side = divmod(int(key[lo]), 2)
                if a != at:
                    yield from task.found() if task else ()
                    at, mine, task = a, [], None
                ids, x = part.column("id").to_numpy(), part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                if side == 0:
                    mine.append((ids, x))
                    continue
                if task is None and mine:
                    task = Nearest(np.concatenate([m[0] for m in mine]), np.concatenate([m[1] for m in mine]), k)
                    mine = []
                if task:
                    task.meet(ids, x)
        yield from task.found() if task else ()

    met = left.unionByName(right).repartitionById(blocks, F.col("a")).sortWithinPartitions("a", "side")
    return met.mapInArrow(search, "src long, dst long, rank int, square double")


def shared_density(edges: DataFrame, points: DataFrame) -> DataFrame:
    """dst, a, b: how many points of either sample have dst among their neighbours."""
    labels = points.select(F.col("id").alias("src"), "in_1", "in_2")
    return edges.select("src", "dst").join(labels, "src").groupBy("dst").agg(F.sum("in_1").alias("a"), F.sum("in_2").alias("b"))


def nnps_distance(edges: DataFrame, points: DataFrame) -> float:
    """Mean over the points of |a - b| / (a + b); 0 for equal samples, 1 for samples that share no neighbourhood."""
    gap = F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))
    return float(shared_density(edges, points).agg(F.avg(gap)).first()[0] or 0.0)


def _hash(ids: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """64-bit mix of (seed, rep, id), equal on every machine."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((rep * 0xBF58476D1CE4E5B9 + seed * 0x94D049BB133111EB + 1) % (1 << 64))
        for shift in (30, 27, 31):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def permuted_distances(edges: DataFrame, n: int, ones: int, times: int, seed: int = 0) -> list[float]:
    """Distances after `times` permutations of the labels, `ones` of n points in sample 1, all others in sample 2.

    A permutation takes the `ones` points of the smallest hashes of their ids, 0 to n - 1; the limits come from the ids alone, one task per permutation. Then the edges, dealt by dst, are
    read once for all permutations; each task gives one sum per permutation.
    """
    spark = edges.sparkSession

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_pylist()
            cut = [int(np.partition(_hash(np.arange(n), r, seed), ones - 1)[ones - 1]) if ones else -1 for r in reps]
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([str(c) for c in cut])], ["rep", "cut"])

    cuts = {r["rep"]: int(r["cut"]) for r in spark.range(times).withColumnRenamed("id", "rep").mapInArrow(limits, "rep long, cut string").collect()}  # one row per permutation
    top = [cuts[r] for r in range(times)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, points, tail = np.zeros(times), 0, None
        for batch in batches:
            dst, src = batch.column("dst").to_numpy(), batch.column("src").to_numpy()
            if tail is not None:
                dst, src = np.concatenate([tail[0], dst]), np.concatenate([tail[1], src])
            tail = (dst[dst == dst[-1]], src[dst == dst[-1]]) if len(dst) else tail
            done = dst != dst[-1] if len(dst) else np.zeros(0, bool)
            total, points = _add(total, points, dst[done], src[done])
        if tail is not None:
            total, points = _add(total, points, *tail)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(times)), pa.array(total), pa.array(np.full(times, points))], ["rep", "total", "points"])

    def _add(total, points, dst, src):
        if not len(dst):
            return total, points
        starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        degree = np.diff(np.r_[starts, len(dst)])
        for r in range(times):
            ones_in = np.add.reduceat((_hash(src, r, seed) <= np.uint64(top[r])).astype(np.int64) if top[r] >= 0 else np.zeros(len(src), np.int64), starts)
            total[r] += (np.abs(2 * ones_in - degree) / degree).sum()
        return total, points + len(starts)

    parts = edges.select("dst", "src").repartition("dst").sortWithinPartitions("dst", "src").mapInArrow(sums, "rep long, total double, points long")
    found = parts.groupBy("rep").agg(F.sum("total").alias("t"), F.sum("points").alias("p")).collect()
    return [r["t"] / r["p"] if r["p"] else 0.0 for r in sorted(found, key=lambda r: r["rep"])]


def drift_threshold(distances: Sequence[float], alpha: float) -> float:
    """(1 - alpha)-quantile of the normal distribution with the mean and population deviation of the distances."""
    mean = float(np.mean(distances))
    return normal_quantile(1 - alpha, mean, float(np.std(distances)))


def nndvi(df: DataFrame, batch: str, features: Sequence[str] | str, k_nn: int = 30, sampling_times: int = 500, alpha: float = 0.01, seed: int = 0) -> DataFrame:
    """batch, total, since, distance, threshold, verdict: every batch against the reference, at first the first batch; after drift the drifted one. features as for points_of()."""
    spark = df.sparkSession
    names = batch_numbers(df, batch)
    out, total, since, ref, drifted = [], 0, 0, None, False
    for name in names:
        if ref is None:
            ref = name
            continue
        if drifted:
            since = 0
        total, since = total + 1, since + 1
        points = points_of(df.where(F.col(batch) == ref), df.where(F.col(batch) == name), features)
        n, ones = points.agg(F.count("*"), F.sum("in_1")).first()
        edges = settled(neighbours(points.select("id", "x"), k_nn), "edges")
        distance = nnps_distance(edges, points)
        limit = drift_threshold(permuted_distances(edges, n, int(ones or 0), sampling_times, seed + total), alpha)
        drifted = distance > limit
        out.append((name, total, since, distance, limit, "drift" if drifted else None))
        ref = name if drifted else ref
    return spark.createDataFrame(out, "batch long, total long, since long, distance double, threshold double, verdict string")
