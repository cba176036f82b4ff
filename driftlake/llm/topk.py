"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.llm.shared import written

NONE = -(2**63 - 1)
LEAF, FANOUT = 128, 16
#: Nodes of the top of the tree at most, and the rows (those of the smallest hashes) that their centres are chosen from; every row is assigned to a node.
TOP, SAMPLE = 1024, 2048


class CoverTree:
    """Points in nested balls. A node's children are centred on points of the node found farthest first, its own centre among them: centres of one
    node are at least as far apart as the radius that covers the rest. Nodes of LEAF points, or of equal points, are leaves."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        centre, radius = [], []
        todo = [(np.arange(len(points)), 0, -1)] if len(points) else []
        while todo:
            idx, c, parent = todo.pop()
            dist = self._from(idx, c)
            me, far = len(centre), float(dist.max())
            centre.append(c)
            radius.append(far)
            self.members.append(idx)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if len(idx) <= LEAF or far == 0:
                continue
            owner, centres = np.zeros(len(idx), np.int64), [c]
            while len(centres) < FANOUT and dist.max() > 0:
                new = int(idx[dist.argmax()])
                d = self._from(idx, new)
                nearer = d < dist
                owner[nearer], dist = len(centres), np.minimum(dist, d)
                centres.append(new)
            todo += [(idx[owner == i], x, me) for i, x in enumerate(centres)]
        self.centres = points[centre] if centre else points
        self.radius = np.array(radius)
        self.norm = np.sqrt((self.centres**2).sum(1))

    def _from(self, idx: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(((self.points[idx] - self.points[c]) ** 2).sum(1))


def dual_tree(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries x k) of the best candidates, ids other than the query's own; NONE where there are fewer.

    Pairs of nodes are visited, the most promising first, and left out if no pair of their points can reach the worst kth score in the
    query node: <a, b> <= <A, B> + |A| r_B + |B| r_A + r_A r_B. floor: for each query a kth score that it is known to have elsewhere; candidates below it need
    not be found. Scores are exact integers, held within the range of a long.
    """
    small = len(q) and len(p) and np.sqrt((q.astype(float) ** 2).sum(1).max()) * np.sqrt((p.astype(float) ** 2).sum(1).max()) < 2**52
    qf, pf = (q.astype(float), p.astype(float))
    exact = (lambda a, b: (qf[a] @ pf[b].T).astype(np.int64)) if small else (lambda a, b: np.clip(q[a].astype(object) @ p[b].astype(object).T, NONE + 1, -NONE).astype(np.int64))
    score, ids = np.full((len(q), k), NONE, np.int64), np.full((len(q), k), 2**63 - 1, np.int64)
    floor = np.full(len(q), NONE, np.int64) if floor is None else floor
    if not (len(q) and len(p)):
        return score, ids
    a, b = CoverTree(qf), CoverTree(pf)

    def bounds(x, y):
        top = b.centres[y] @ a.centres[x] + a.norm[x] * b.radius[y] + b.norm[y] * a.radius[x] + a.radius[x] * b.radius[y]
        return top + 1e-9 * (a.norm[x] + a.radius[x]) * (b.norm[y] + b.radius[y]) + 1e-9

    todo = [(float(bounds(0, np.array([0]))[0]), 0, 0)]
    while todo:
        top, x, y = todo.pop()
        mine = a.members[x]
        if top < np.maximum(score[mine, -1], floor[mine]).min():
            continue
        if not a.children[x] and not b.children[y]:
            for part in np.array_split(b.members[y], -(-len(b.members[y]) // 4096)):
                s = exact(mine, part)
                s[q_ids[mine][:, None] == p_ids[part][None, :]] = NONE
                use = (s >= np.maximum(score[mine, -1], floor[mine])[:, None]).any(0)
                if use.any():
                    s, i = np.hstack([score[mine], s[:, use]]), np.hstack([ids[mine], np.broadcast_to(p_ids[part][use], (len(mine), use.sum()))])
                    i = np.where(s == NONE, 2**63 - 1, i)
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    score[mine], ids[mine] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        elif b.children[y] and (not a.children[x] or b.radius[y] >= a.radius[x]):
            kids = np.array(b.children[y])
            top = bounds(x, kids)
            todo += [(float(top[j]), x, int(kids[j])) for j in top.argsort()]
        else:
            todo += sorted((float(bounds(c, np.array([y]))[0]), c, y) for c in a.children[x])
    return score, ids


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("q").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """id, q (floor(scale * x), x as double; beyond a long the nearest long). Null vectors and ids and those holding null or non-finite components are left out; repeated rows stay."""
    x = F.col(vec_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    good = df.where(F.col(id_col).isNotNull() & x.isNotNull()).where(F.forall(x, finite))
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).cast("array<bigint>").alias("q"))


def centres_of(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """For each number of components that the sample holds, at most `most` of its vectors, each the one farthest from those before it."""
    drawn = vectors.select("q").orderBy(F.xxhash64("q", "id"), "id").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in drawn:
        by_size.setdefault(len(r.q), []).append(r.q)
    out = {}
    for size, rows in by_size.items():
        x = np.array(rows, float).reshape(len(rows), size)
        chosen, dist = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < most and dist.max() > 0:
            chosen.append(int(dist.argmax()))
            dist = np.minimum(dist, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[size] = x[chosen]
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row of x, and the distance."""
    at = np.zeros(len(x), np.int32)
    squares = (centres**2).sum(1)
    for i in range(0, len(x), 1024):
        at[i : i + 1024] = (squares[None, :] - 2 * (x[i : i + 1024] @ centres.T)).argmin(1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(1))


def assigned(vectors: DataFrame, centres: dict[int, np.ndarray], groups: int) -> DataFrame:
    """id, q, dim, node and far (number of its centre and distance from it), grp and off (the same among the first `groups` centres). Where the sample had no vector of a size, node 0 around zero."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q")
            sizes = pa.compute.list_value_length(q).to_numpy(zero_copy_only=False).astype(np.int32)
            node, grp = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
            far, off = np.zeros(len(sizes)), np.zeros(len(sizes))
            for size in np.unique(sizes):
                on = np.flatnonzero(sizes == size)
                x = q.take(pa.array(on)).flatten().to_numpy(zero_copy_only=False).reshape(len(on), size).astype(float)
                c = centres.get(int(size), np.zeros((1, size)))
                node[on], far[on] = _nearest(x, c)
                grp[on], off[on] = _nearest(x, c[:groups])
            yield pa.RecordBatch.from_arrays([batch.column("id"), q, *map(pa.array, (sizes, node, far, grp, off))], ["id", "q", "dim", "node", "far", "grp", "off"])

    return vectors.select("id", "q").mapInArrow(assign, "id long, q array<bigint>, dim int, node int, far double, grp int, off double")


def _search(asked: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: at most k candidates of each query in each pair of a group of queries and a node, both in blocks if they are large. pairs has TOP * TOP rows at most."""
    side = F.broadcast(pairs)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(side, ["dim", "grp"]).withColumn("qb", F.pmod("row", "q_blocks").cast("int")).withColumn("db", every("d_blocks"))
    right = data.select("id", "q", "dim", "node", "row").join(side, ["dim", "node"]).withColumn("db", F.pmod("row", "d_blocks").cast("int")).withColumn("qb", every("q_blocks"))
    keys = ["dim", "grp", "node", "qb", "db"]

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        q_ids, p_ids = (t.column("id").to_numpy() for t in (a, b))
        found = (np.zeros((0, k), np.int64),) * 2
        if a.num_rows and b.num_rows:
            found = dual_tree(_matrix(a), q_ids, _matrix(b), p_ids, k, a.column("floor").to_numpy())
        score, ids = found
        real = score != NONE
        return pa.table({"query_id": np.repeat(q_ids[: len(score)], real.sum(1)).astype(np.int64), "vec_id": ids[real], "score": score[real]})

    return left.select(*keys, "id", "q", "floor").groupBy(*keys).cogroup(right.select(*keys, "id", "q").toDF(*keys, "id", "q").groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")


def node_pairs(asked: DataFrame, data: DataFrame, centres: dict[int, np.ndarray], data_block: int, query_block: int) -> DataFrame:
    """dim, grp, node, q_blocks, d_blocks, top (no pair of their points scores more) and turn (1: the node that promises a group most) for all groups and nodes: TOP * TOP rows of a size at most."""
    spark = data.sparkSession
    rows = [(size, i, [float(v) for v in c]) for size, cs in centres.items() for i, c in enumerate(cs)]
    at = spark.createDataFrame(rows, "dim int, at int, centre array<double>")
    centre = F.coalesce("centre", F.array_repeat(F.lit(0.0), F.col("dim")))
    named = lambda df, by: df.join(F.broadcast(at.withColumnRenamed("at", by)), ["dim", by], "left").withColumn("centre", centre)
    blocks = lambda size: F.ceil(F.count("*") / size).cast("int")
    groups = named(asked.groupBy("dim", "grp").agg(F.max("off").alias("rq"), blocks(query_block).alias("q_blocks")), "grp").withColumnRenamed("centre", "a")
    nodes = named(data.groupBy("dim", "node").agg(F.max("far").alias("rd"), blocks(data_block).alias("d_blocks")), "node").withColumnRenamed("centre", "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    met = groups.join(nodes, "dim").withColumns({"ab": dot("a", "b"), "na": F.sqrt(dot("a", "a")), "nb": F.sqrt(dot("b", "b"))})
    slack = F.lit(1e-9) * (F.col("na") + F.col("rq")) * (F.col("nb") + F.col("rd")) + 1e-9
    top = F.col("ab") + F.col("na") * F.col("rd") + F.col("nb") * F.col("rq") + F.col("rq") * F.col("rd") + slack
    turn = F.row_number().over(Window.partitionBy("dim", "grp").orderBy(F.desc("ab"), "node"))
    return met.select("dim", "grp", "node", "q_blocks", "d_blocks", top.alias("top"), turn.alias("turn"))


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, data_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k candidates of the highest integer inner product, ties to the smaller id.

    vectors: as quantised() gives them; is_query: condition on id. Candidates are all rows but those with the query's own id, of the same
    number of components (others have no score); repeated rows are several candidates. An id with several vectors is several queries in one: its
    best k of all; repeated queries are one.

    The top of the data's tree has a node around each of a few centres, chosen far apart from a sample, and every row in the node of its nearest one;
    queries lie in groups likewise. Each group first searches the node of the highest inner product of centres. Its worst kth score then rules out, before
    anything is sent, all nodes that cannot hold better ones; the kth scores travel with the queries into the rest. Inside a task, which holds no more
    than data_block + query_block vectors (about), cover trees of both sides are searched together.
    """
    n, m = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    nodes = min(TOP, max(1, -(-4 * n // data_block)))
    groups = min(nodes, max(1, -(-m // query_block)))
    centres = centres_of(vectors, nodes)
    data, _ = written(assigned(vectors, centres, groups).withColumn("row", F.monotonically_increasing_id()), "nodes")
    asked = data.where(is_query).groupBy("dim", "grp", "id", "q").agg(F.max("off").alias("off"), F.min("row").alias("row"))
    pairs, _ = written(node_pairs(asked, data, centres, data_block, query_block), "pairs")
    first, _ = written(_search(asked.withColumn("floor", F.lit(NONE).cast("long")), data, pairs.where("turn = 1"), k), "first")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    kth = best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).drop("n")
    told, _ = written(asked.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE).cast("long"))), "asked")
    worst = told.groupBy("dim", "grp").agg(F.min("floor").alias("worst"))
    rest = pairs.where("turn > 1").join(F.broadcast(worst), ["dim", "grp"]).where(F.col("top") >= F.col("worst")).drop("worst")  # a row a group
    near = first.union(_search(told, data, rest, k))
    return near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
