"""kdq-trees: space halved axis by axis into cells, and the divergence of two samples over the cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions.density import kullback_np, smoothed
from driftlake.functions.hashrng import uniform_of
from driftlake.operators.fold import Detector
from driftlake.operators.hdm import batch_numbers
from driftlake.sources.tables import settled

#: Cells of a reference (rows times features) up to which its tree is built on the driver; larger ones are built level by level in Spark.
DRIVER_CELLS = 2_000_000
#: Nodes up to which a tree is compiled to a CASE expression; larger ones are walked in Arrow batches.
CASE_NODES = 150
#: Rows of a node up to which all that is below it is built in one task.
NODE_ROWS = 500_000
NODES = "node_id long, parent_id long, name string, depth int, axis int, midpoint double, is_leaf boolean, leaf int"


class KdqTree:
    """Nodes in pre-order, left (<= midpoint) before right: axis (-1: leaf), mid, left and right (numbers of nodes, -1: none), parent, depth, leaf (number of the leaf, -1: inner), count."""

    def __init__(self):
        self.axis: list[int] = []
        self.mid: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.count: list[int] = []
        self.leaf: list[int] = []

    FIELDS = ("axis", "mid", "left", "right", "parent", "depth", "count", "leaf")

    def add(self, parent: int, depth: int, count: int, side: str | None) -> int:
        me = len(self.axis)
        for name, value in zip(self.FIELDS, (-1, 0.0, -1, -1, parent, depth, count, -1), strict=True):
            getattr(self, name).append(value)
        if side:
            getattr(self, side)[parent] = me
        return me

    def number_leaves(self) -> KdqTree:
        leaf = 0
        for i, a in enumerate(self.axis):
            if a < 0:
                self.leaf[i] = leaf
                leaf += 1
        return self

    @property
    def leaves(self) -> int:
        return sum(a < 0 for a in self.axis)

    def leaf_counts(self) -> np.ndarray:
        return np.array([c for c, a in zip(self.count, self.axis, strict=True) if a < 0], float)

    def state(self) -> dict:
        return {n: list(getattr(self, n)) for n in self.FIELDS}

    @classmethod
    def of(cls, state: dict) -> KdqTree:
        tree = cls()
        for n in cls.FIELDS:
            setattr(tree, n, list(state[n]))
        return tree

    def place(self, x: Sequence[float]) -> int:
        """Leaf of one point."""
        i = 0
        while self.axis[i] >= 0:
            i = self.left[i] if x[self.axis[i]] <= self.mid[i] else self.right[i]
        return self.leaf[i]

    def arrays(self) -> tuple[np.ndarray, ...]:
        """axis, mid, left, right and leaf of the nodes."""
        return tuple(np.array(getattr(self, n)) for n in ("axis", "mid", "left", "right", "leaf"))

    def places(self, points: np.ndarray, arrays: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """Leaves of many points; arrays: arrays(), if known."""
        axis, mid, left, right, leaf = arrays or self.arrays()
        at = np.zeros(len(points), np.int64)
        while len(on := np.flatnonzero(axis[at] >= 0)):
            node = at[on]
            at[on] = np.where(points[on, axis[node]] <= mid[node], left[node], right[node])
        return leaf[at]

    def node_counts(self, leaf_counts: Sequence[float]) -> list[float]:
        """Points under every node."""
        sums = [leaf_counts[n] if n >= 0 else 0 for n in self.leaf]
        for i in range(len(sums) - 1, 0, -1):
            sums[self.parent[i]] += sums[i]
        return sums

    def reset(self, value: int = 0) -> KdqTree:
        """The same cells with that count in every node."""
        out = KdqTree.of(self.state())
        out.count = [value] * len(out.axis)
        return out

    def counting(self, leaf_counts: Sequence[float]) -> KdqTree:
        """The same cells with the points of another sample, by leaf, added to the counts of the nodes above them."""
        out = KdqTree.of(self.state())
        out.count = [int(a + b) for a, b in zip(self.count, self.node_counts(leaf_counts), strict=True)]
        return out

    def labels(self, features: Sequence[str] | None = None) -> list[str]:
        """kdqTree for the root, else the half-space of the parent's split."""
        out = ["kdqTree"]
        for i in range(1, len(self.axis)):
            p = self.parent[i]
            name = features[self.axis[p]] if features else f"ax {self.axis[p]}"
            out.append(f"{name} {'<=' if self.left[p] == i else '>'} {round(self.mid[p], 3)}")
        return out


def least_cells(low: Sequence[float], high: Sequence[float], proportion: float) -> list[int]:
    """Least half-width of a cell per axis, in whole units."""
    return [int(proportion * (h - l)) for l, h in zip(low, high, strict=True)]  # noqa: E741


def build_local(points: np.ndarray, count_ubound: int = 200, cutpoint_proportion_lbound: float = 0.25) -> KdqTree:
    """A node is a leaf if it has count_ubound points or distinct numbers at most, or if half its width along the axis of its depth is too small."""
    if not points.size:
        return KdqTree()
    return _grown(points, count_ubound, least_cells(points.min(0), points.max(0), cutpoint_proportion_lbound)).number_leaves()


def _grown(points: np.ndarray, count_ubound: int, least: Sequence[int], top: int = 0) -> KdqTree:
    """The nodes of a tree, or of what hangs on a node of depth top."""
    tree, todo = KdqTree(), [(points, -1, top, None)]
    while todo:
        part, parent, depth, side = todo.pop()
        me = tree.add(parent, depth, len(part), side)
        a = depth % part.shape[1]
        low = part[:, a].min()
        half = (part[:, a].max() - low) / 2
        few = lambda x: np.unique(x).size <= count_ubound
        if len(part) <= count_ubound or half <= least[a] or (few(part[: 2 * count_ubound]) and few(part)):
            continue
        tree.axis[me], tree.mid[me] = a, float(low + half)
        under = part[:, a] <= tree.mid[me]
        todo += [(part[~under], me, depth + 1, "right"), (part[under], me, depth + 1, "left")]
    return tree


def build_distributed(df: DataFrame, features: Sequence[str], count_ubound: int = 200, cutpoint_proportion_lbound: float = 0.25) -> KdqTree:
    """The same tree. Rows are written once. Nodes of more than NODE_ROWS are split level by level, by one aggregation per depth; what hangs on smaller ones is built in one more pass, a task
    for a node. The driver holds one entry per node."""
    rows = settled(df.select(F.array(*(F.col(f).cast("double") for f in features)).alias("x")), "points")
    at = lambda i: F.get("x", F.lit(i))
    low_high = rows.agg(F.count("*"), *(f(at(i)) for f in (F.min, F.max) for i in range(len(features)))).first()
    d = len(features)
    if not low_high[0]:
        return KdqTree()
    least = least_cells(low_high[1 : d + 1], low_high[d + 1 :], cutpoint_proportion_lbound)
    found: dict[str, dict] = {}
    open_paths, splits, depth, small = [""], {}, 0, {""} if low_high[0] <= NODE_ROWS else set()
    while open_paths and not small.issuperset(open_paths):
        here = _with_path(rows, splits).where((F.length("path") == depth) & ~F.col("path").isin(*small))
        a = depth % d
        stats = here.groupBy("path").agg(F.count("*").alias("n"), F.min(at(a)).alias("low"), F.max(at(a)).alias("high"))
        level = {r["path"]: r for r in stats.collect()}  # nodes of one level
        tiny = {p for p, r in level.items() if r["n"] <= NODE_ROWS}
        small |= tiny
        wide = [p for p, r in level.items() if p not in tiny and r["n"] > count_ubound and (r["high"] - r["low"]) / 2 > least[a]]
        kinds = {}
        if wide:
            numbers = here.select("path", F.explode("x").alias("v")).distinct().groupBy("path").agg(F.count("*").alias("k"))
            kinds = {r["path"]: r["k"] for r in numbers.collect()}
        open_paths = []
        for p, r in level.items():
            found[p] = {"n": r["n"]}
            if p in wide and kinds[p] > count_ubound:
                splits[p] = (a, r["low"] + (r["high"] - r["low"]) / 2)
                open_paths.append(p)
        depth += 1

    def below(key: tuple, part: pa.Table) -> pa.Table:
        points = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        top = key[0].as_py()
        grown, paths = _grown(points, count_ubound, least, len(top)), [top]
        for i in range(1, len(grown.axis)):
            paths.append(paths[grown.parent[i]] + ("0" if grown.left[grown.parent[i]] == i else "1"))
        return pa.table({"path": paths, "n": pa.array(grown.count, pa.int64()), "axis": pa.array(grown.axis, pa.int32()), "mid": grown.mid})

    if small:
        rest = _with_path(rows, splits).where(F.col("path").isin(*small)).groupBy("path").applyInArrow(below, "path string, n long, axis int, mid double")
        for r in rest.collect():  # one row per node
            found[r["path"]] = {"n": r["n"]}
            if r["axis"] >= 0:
                splits[r["path"]] = (r["axis"], r["mid"])
    tree, todo = KdqTree(), [("", -1, None)]
    while todo:
        path, parent, side = todo.pop()
        me = tree.add(parent, len(path), found[path]["n"], side)
        if path in splits:
            tree.axis[me], tree.mid[me] = splits[path]
            todo += [(path + "1", me, "right"), (path + "0", me, "left")]
    return tree.number_leaves()


def _with_path(rows: DataFrame, splits: dict[str, tuple[int, float]]) -> DataFrame:
    """rows with path: 0 for each step to the left, 1 for each to the right. The splits travel to the tasks once, as a broadcast of one entry per inner node."""

    known = rows.sparkSession.sparkContext.broadcast(splits)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            points = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            paths = np.full(batch.num_rows, "", object)
            todo = [("", np.arange(batch.num_rows))]
            while todo:
                path, on = todo.pop()
                if path not in known.value or not len(on):
                    paths[on] = path
                    continue
                a, mid = known.value[path]
                under = points[on, a] <= mid
                todo += [(path + "0", on[under]), (path + "1", on[~under])]
            yield pa.RecordBatch.from_arrays([column, pa.array(paths, pa.string())], ["x", "path"])

    return rows.mapInArrow(walk, "x array<double>, path string")


def build(df: DataFrame, features: Sequence[str], count_ubound: int = 200, cutpoint_proportion_lbound: float = 0.25) -> KdqTree:
    """The tree of the rows of df; those with nulls are left out. Small tables are built on the driver, large ones level by level; the tree is the same."""
    slim = df.select(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features))).na.drop()
    names = slim.columns
    if slim.count() * len(features) > DRIVER_CELLS:
        return build_distributed(slim, names, count_ubound, cutpoint_proportion_lbound)
    table = slim.toArrow()
    points = np.column_stack([table.column(n).to_numpy() for n in names]) if table.num_rows else np.zeros((0, len(features)))
    return build_local(points, count_ubound, cutpoint_proportion_lbound)


def leaf_of(tree: KdqTree, features: Sequence[str]) -> Column:
    """The leaf in which a row lies."""
    cols = [F.col(f).cast("double") for f in features]
    if len(tree.axis) <= CASE_NODES:
        made: list[Column] = [F.lit(None).cast("int")] * len(tree.axis)
        for i in range(len(tree.axis) - 1, -1, -1):
            made[i] = F.lit(tree.leaf[i]) if tree.axis[i] < 0 else F.when(cols[tree.axis[i]] <= tree.mid[i], made[tree.left[i]]).otherwise(made[tree.right[i]])
        return made[0] if made else F.lit(None).cast("int")

    known, empty = SparkSession.active().sparkContext.broadcast(tree.arrays()), KdqTree()

    @F.arrow_udf("int")
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            points = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            yield pa.array(empty.places(points, known.value), pa.int32())

    return walk(F.array(*cols))


def fill(df: DataFrame, tree: KdqTree, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, leaf, n: points of every cell that has any. Counts of several tables add up; replacing them is a matter of choosing rows."""
    rows = df.where(~F.greatest(*(F.col(f).isNull().cast("int") for f in features), F.lit(0)).cast("boolean"))
    return rows.groupBy(*by, leaf_of(tree, features).alias("leaf")).agg(F.count("*").alias("n"))


def divergence(counts_1: np.ndarray, counts_2: np.ndarray) -> float:
    """Kullback-Leibler divergence of the smoothed shares of two samples over the cells."""
    return float(kullback_np(smoothed(counts_1), smoothed(counts_2)))


def critical_value(counts: np.ndarray, sample_size: int, alpha: float, bootstrap_samples: int, seed: int) -> float:
    """The nearest (1 - alpha)-quantile of the divergence between pairs of samples drawn from the smoothed reference; a sample is its counts, drawn at once."""
    rng = np.random.default_rng(int(uniform_of(seed, sample_size, len(counts)) * (1 << 52)))
    p = smoothed(counts)
    p = p / p.sum()
    block = max(1, 4_000_000 // max(1, len(counts)))
    found = []
    for i in range(0, bootstrap_samples, block):
        n = min(block, bootstrap_samples - i)
        a, b = (rng.multinomial(sample_size, p, size=n) for _ in range(2))
        found.append(kullback_np(smoothed(a), smoothed(b)))
    return float(np.quantile(np.concatenate(found), 1 - alpha, method="nearest"))


def node_table(df_or_spark, tree: KdqTree, features: Sequence[str] | None = None, test_counts: Sequence[float] | None = None, max_depth: int | None = None) -> DataFrame:
    """The tree as rows: node_id, parent_id, name, depth, axis, midpoint, is_leaf, leaf, cell_count and, with counts of a second sample, count_diff and kss.

    kss: divergence between both samples over two cells, the node and all the rest. max_depth 0 or None: all nodes.
    """
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    test = tree.node_counts(test_counts) if test_counts is not None else None
    labels = tree.labels(features)
    rows, keep = [], [i for i, d in enumerate(tree.depth) if not max_depth or d <= max_depth]
    ref_all = max((tree.count[i] for i in keep), default=0)
    test_all = max((test[i] for i in keep), default=0) if test else 0
    for i in keep:
        row = [i, tree.parent[i] if i else None, labels[i], tree.depth[i], tree.axis[i] if tree.axis[i] >= 0 else None, tree.mid[i] if tree.axis[i] >= 0 else None, tree.axis[i] < 0, tree.leaf[i] if tree.leaf[i] >= 0 else None, tree.count[i]]
        if test is not None:
            row += [int(test[i]) - tree.count[i], divergence(np.array([tree.count[i], ref_all - tree.count[i]]), np.array([test[i], test_all - test[i]]))]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, NODES + ", cell_count long" + (", count_diff long, kss double" if test is not None else ""))


def as_text(tree: KdqTree, counts: Sequence[float] | None = None) -> str:
    """One line per node, indented by depth."""
    numbers = tree.count if counts is None else tree.node_counts(counts)
    return "\n".join(f"{'  ' * d}{label}: {int(n)}" for d, label, n in zip(tree.depth, tree.labels(), numbers, strict=True))


def kdq_batches(df: DataFrame, batch: str, features: Sequence[str], alpha: float = 0.01, bootstrap_samples: int = 500, count_ubound: int = 100, cutpoint_proportion_lbound: float = 2e-10, seed: int = 0) -> DataFrame:
    """batch, total, since, distance, critical, verdict: every batch against the tree of the reference, at first the first batch; after drift the drifted one.

    Each epoch counts all later batches in one job over (batch, cell); the driver holds one number per batch and cell.
    """
    spark = df.sparkSession
    names = batch_numbers(df, batch)
    out, tree, known, critical, drifted, total, since = [], None, {}, None, False, 0, 0

    def start(at: int) -> None:
        nonlocal tree, known, critical, since
        tree = build(df.where(F.col(batch) == at), features, count_ubound, cutpoint_proportion_lbound)
        since, known = 0, {}
        counts = tree.leaf_counts()
        critical = critical_value(counts, int(counts.sum()), alpha, bootstrap_samples, seed + at) if len(counts) else None
        if tree.axis:
            for r in fill(df.where(F.col(batch) > at).withColumn("b_", F.col(batch).cast("long")), tree, features, ["b_"]).collect():
                known.setdefault(r["b_"], np.zeros(tree.leaves))[r["leaf"]] = r["n"]

    for i, name in enumerate(names):
        if i == 0:
            start(name)
            out.append((name, 0, 0, None, critical, None))
            continue
        if drifted:
            start(names[i - 1])
        total, since = total + 1, since + 1
        distance = divergence(tree.leaf_counts(), known[name]) if name in known else None
        drifted = distance is not None and critical is not None and distance > critical
        out.append((name, total, since, distance, critical, "drift" if drifted else None))
    return spark.createDataFrame(out, "batch long, total long, since long, distance double, critical double, verdict string")


class KdqStream(Detector):
    """A tree of the first window_size rows of an epoch; the rows after them are counted in its cells, and from window_size of them on each row is a test.

    Drift if the divergence was critical more than persistence * window_size times (consecutive=True: in a row). since counts from the end of the reference.
    """

    inputs = ("x",)
    extra = "distance double, critical double, exceeded long"

    def __init__(self, window_size: int, persistence: float = 0.05, alpha: float = 0.01, bootstrap_samples: int = 500, count_ubound: int = 100, cutpoint_proportion_lbound: float = 2e-10, consecutive: bool = False, seed: int = 0):
        if not isinstance(window_size, int) or window_size < 1:
            raise ValueError("window_size must be a positive whole number")
        self.w, self.persistence, self.alpha, self.samples = window_size, persistence, alpha, bootstrap_samples
        self.ub, self.proportion, self.consecutive, self.seed = count_ubound, cutpoint_proportion_lbound, consecutive, seed

    def epoch(self):
        return {"rows": [], "tree": None, "ref": None, "test": None, "seen": 0, "over": 0, "critical": None, "distance": None}

    def observe(self, s, x):
        if s["tree"] is None:
            s["rows"].append([float(v) for v in x])
            if len(s["rows"]) == self.w:
                tree = build_local(np.array(s["rows"]), self.ub, self.proportion)
                counts = tree.leaf_counts()
                s.update(rows=[], tree=tree.state(), ref=counts.tolist(), test=[0.0] * len(counts), since=0)
                s["critical"] = critical_value(counts, self.w, self.alpha, self.samples, self.seed)
            return
        t = s["tree"]
        i = 0
        while t["axis"][i] >= 0:
            i = t["left"][i] if x[t["axis"][i]] <= t["mid"][i] else t["right"][i]
        s["test"][t["leaf"][i]] += 1
        s["seen"] += 1
        if s["seen"] >= self.w:
            s["distance"] = divergence(np.array(s["ref"]), np.array(s["test"]))
            if s["distance"] > s["critical"]:
                s["over"] += 1
                if s["over"] > self.persistence * self.w:
                    s["verdict"] = "drift"
            elif self.consecutive:
                s["over"] = 0

    def report(self, s):
        return s["distance"], s["critical"], s["over"]
