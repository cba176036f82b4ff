"""Batch detectors, partitioners, injectors and ensembles on small tables of known result."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.functions import density, hashrng
from driftlake.operators import change, concept, ensemble, hdm, inject, kdq, md3, nn
from driftlake.operators.fold import run_fold
from driftlake.plans import batches as batch_queries
from driftlake.plans import schema, streams
from driftlake.sources import datasets


def batches(spark, *parts):
    rows = [(b, i, *(float(v) for v in row)) for b, part in enumerate(parts) for i, row in enumerate(part)]
    d = len(parts[0][0])
    return spark.createDataFrame(rows, "batch long, row_idx long, " + ", ".join(f"f{i} double" for i in range(d))), [f"f{i}" for i in range(d)]


REF = np.ones((100, 3))
TEST = np.random.default_rng(1).integers(2, 10, (150, 3))


@pytest.mark.parametrize("detect, repeats, drift_at, counters", [(1, 1, 1, (4, 2)), (2, 2, 2, (3, 1)), (3, 3, 3, (4, 1))])
def test_hdm_counters(spark, detect, repeats, drift_at, counters):
    df, features = batches(spark, *([REF] * repeats), TEST, TEST)
    out = hdm.hdddm(df, "batch", features, detect_batch=detect, order=["row_idx"]).orderBy("batch").collect()
    assert [r.batch for r in out if r.verdict] == [drift_at]
    assert (out[-1].total, out[-1].since) == counters and out[-1].reference_from == drift_at and out[-1].verdict is None


def test_cdbd(spark):
    rng = np.random.default_rng(2)
    df, _ = batches(spark, rng.random((100, 1)), 3 + rng.random((100, 1)))
    assert [r.verdict for r in hdm.cdbd(df, "batch", "f0", order=["row_idx"]).orderBy("batch").collect()] == [None, "drift"]
    with pytest.raises(ValueError):
        hdm.cdbd(df, "batch", ["f0"])
    with pytest.raises(ValueError):
        hdm.hdm(df, "batch", ["f0"], detect_batch=4)


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(90, 2)), rng.normal(1, 2, (60, 2)), rng.normal(0, 1, (40, 2))
    df, features = batches(spark, a, b, c)
    for kind in ("H", "KL", "intersection"):
        found = {(r.start, r.batch, r.f): r.distance for r in hdm.distance_table(df, "batch", features, kind).collect()}
        for (s, t), (ref, test) in {(0, 1): (a, b), (0, 2): (np.vstack([a, b]), c), (1, 2): (b, c)}.items():
            for f in (0, 1):
                both = np.r_[ref[:, f], test[:, f]]
                p, q = (np.histogram(x[:, f], int(np.sqrt(len(ref))), (both.min(), both.max()))[0].astype(float) for x in (ref, test))
                want = {"H": density.hellinger_np, "KL": density.jensen_shannon_np, "intersection": lambda p, q: 1 - np.minimum(p / p.sum(), q / q.sum()).sum()}[kind](p, q)
                assert abs(found[s, t, f] - want) < 1e-9


def test_hdm_compares_ahead_as_far_as_it_likes(spark, monkeypatch):
    """Results do not depend on how many batches a job looks ahead."""
    rng = np.random.default_rng(5)
    df, cols = batches(spark, *(rng.normal(3 * (i >= 4) + 6 * (i >= 7), 1, (60, 2)).round(2) for i in range(11)))
    run = lambda: [tuple(r) for r in hdm.hdddm(df, "batch", cols, detect_batch=3, statistic="stdev", significance=0.5).collect()]
    want = run()
    assert [r[6] for r in want].count("drift") >= 2
    monkeypatch.setattr(hdm, "AHEAD", 1)
    assert str(run()) == str(want)


def test_hdm_edges(spark):
    empty = spark.createDataFrame([], "batch long, row_idx long, f0 double")
    assert hdm.hdddm(empty, "batch", ["f0"], detect_batch=3).count() == 0
    one, _ = batches(spark, REF[:5, :1])
    assert hdm.hdddm(one, "batch", ["f0"], detect_batch=3).count() == 1


POINTS = np.array([(i, i + 1) for i in range(1, 7)], float)


def test_kdq_tree():
    tree = kdq.build_local(POINTS, 2, 0.1)
    assert tree.leaf_counts().tolist() == [2, 1, 2, 1]
    assert kdq.divergence(tree.leaf_counts(), tree.leaf_counts()) == 0
    more = np.array([(1, 9), (2, 8), (3, 7), (4, 6), (5, 5)], float)
    assert np.bincount(tree.places(more), minlength=4).tolist() == [0, 3, 2, 0]
    assert [tree.place(p) for p in more] == tree.places(more).tolist()
    other = kdq.build_local(np.array([(1, 2, 3)] * 3 + [(4, 5, 6)] * 3 + [(7, 8, 9)], float), 2, 0.2)
    assert other.leaf_counts().tolist() == [3, 3, 1]
    assert kdq.as_text(tree).count("\n") + 1 == len(tree.axis)


def test_kdq_in_spark(spark):
    rng = np.random.default_rng(5)
    df, features = batches(spark, np.round(rng.normal(size=(400, 3)), 2))
    one = kdq.build(df, features, 20, 2e-10)
    two = kdq.build_distributed(df, features, 20, 2e-10)
    assert one.state() == two.state()
    counts = {r.leaf: r.n for r in kdq.fill(df, one, features).collect()}
    assert [counts[i] for i in range(one.leaves)] == one.leaf_counts().tolist()
    big = kdq.build(df, features, 1, 2e-10)
    assert len(big.axis) > kdq.CASE_NODES
    assert {r.leaf: r.n for r in kdq.fill(df, big, features).collect()} == dict(enumerate(big.leaf_counts().astype(int).tolist()))
    table = kdq.node_table(spark, one, features, one.leaf_counts())
    assert table.where("count_diff <> 0 OR kss <> 0").count() == 0
    assert kdq.node_table(spark, one, max_depth=1).count() == 3


def test_kdq_batches(spark):
    x = np.random.default_rng(6).random((10, 3))
    df, features = batches(spark, x, x, x * 50, x * 50)
    out = kdq.kdq_batches(df, "batch", features, count_ubound=1, bootstrap_samples=10).orderBy("batch").collect()
    assert [r.verdict for r in out] == [None, None, "drift", None] and out[3].since == 1


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK", 30)
    x = np.random.default_rng(7).integers(0, 6, (100, 2)).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>")
    found = {}
    for r in nn.neighbours(df, 4).collect():
        found.setdefault(r.src, {})[r["rank"]] = r.dst
    for i, p in enumerate(x):
        want = sorted(range(100), key=lambda j: (((x[j] - p) ** 2).sum(), j))[:4]
        assert [found[i][k] for k in range(1, 5)] == want


def test_nndvi(spark):
    rng = np.random.default_rng(8)
    df, features = batches(spark, rng.integers(0, 5, (10, 10)), rng.integers(0, 5, (10, 10)), rng.integers(10, 40, (10, 10)))
    out = nn.nndvi(df, "batch", features, k_nn=5, sampling_times=10).orderBy("batch").collect()
    assert out[-1].verdict == "drift" and out[-1].distance == 1.0
    same, _ = batches(spark, REF[:4], REF[:4])
    points = nn.points_of(same, same, ["f0", "f1"])
    assert nn.nnps_distance(nn.neighbours(points.select("id", "x"), 2), points) == 0


def test_permutations_keep_the_sizes(spark):
    edges = spark.createDataFrame([(i, i) for i in range(20)], "src long, dst long")
    assert nn.permuted_distances(edges, 20, 7, 5) == [1.0] * 5
    full = spark.createDataFrame([(i, j) for i in range(20) for j in range(20)], "src long, dst long")
    assert np.allclose(nn.permuted_distances(full, 20, 7, 5), [6 / 20] * 5)


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame([(0, 0.0, 0.0, 0), (1, 1.0, 8.0, 0), (2, 2.0, 9.0, 1), (3, 3.0, 3.0, 1)], "row_idx long, a double, b double, y int")


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("row_idx").collect()]


def test_injectors(spark, numbers):
    assert column(inject.feature_swap(numbers, "row_idx", 1, 3, "a", "b"), "a", "b") == [(0, 0), (8, 1), (9, 2), (3, 3)]
    shifted = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 3.0)], "row_idx long, x double")
    assert np.allclose(column(inject.feature_shift(shifted, "row_idx", 0, 3, "x", 0.5, 0.001), "x"), [0.5005, 0.5005, 3.5005])
    assert column(inject.label_join(numbers, "row_idx", 1, 3, "y", 0, 1, 2), "y") == [0, 2, 2, 1]
    assert column(inject.label_swap(numbers, "row_idx", 0, 4, "y", 0, 1), "y") == [1, 1, 0, 0]
    cover = spark.createDataFrame([(i, i // 3, 2 + i // 3) for i in range(6)], "id int, c int, v int")
    assert sorted(r.v for r in inject.feature_cover(cover, "c", 2, ["id"]).collect()) == [2, 3]
    with pytest.raises(ValueError):
        inject.label_swap(numbers, "row_idx", 0, 4, "nope", 0, 1)


def test_label_probability(spark):
    weights = inject.class_weights({i: 1 for i in range(10)}, range(10), {i: 0.075 for i in range(2, 10)})
    assert np.allclose([weights[i] for i in range(10)], [0.2, 0.2] + [0.075] * 8)
    for bad in ({0: 0.7, 1: 0.5}, {99: 0.1}):
        with pytest.raises(ValueError):
            inject.class_weights({0: 1, 1: 1}, [0, 1], bad)
    df = spark.createDataFrame([(i, i % 2) for i in range(400)], "row_idx long, y int")
    out = inject.label_probability(df, "row_idx", 0, 300, "y", {0: 0.9}, seed=1)
    assert out.count() == 400 and abs(out.where("row_idx < 300 AND y = 0").count() / 300 - 0.9) < 0.06
    assert [tuple(r) for r in out.where("row_idx >= 300").orderBy("row_idx").collect()] == [(i, i % 2) for i in range(300, 400)]
    assert inject.label_dirichlet(df, "row_idx", 0, 300, "y", {0: 1.0, 1: 2.0}).count() == 400


def test_brownian_noise(spark, numbers):
    out = column(inject.brownian_noise(spark.range(8).select(F.col("id").alias("row_idx"), F.lit(0.0).alias("x")), "row_idx", 1, 6, "x", 2.0), "x")
    assert out[0] == out[6] == out[7] == 0 and out[1] == 2
    assert np.allclose(np.abs(np.diff(out[1:6])), 1 / np.sqrt(5))


def test_with_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [tuple(r) for r in inject.with_index(df, ["k"]).orderBy("k").collect()] == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("election, votes, want", [(ensemble.majority(), ["drift", "drift", None], "drift"), (ensemble.majority(), [None, None, "drift"], None), (ensemble.minimum(2), ["drift", "drift", None], "drift"), (ensemble.minimum(2), [None, None, "drift"], None), (ensemble.ordered(1, 1), ["drift", "drift", None], "drift"), (ensemble.ordered(2, 1), [None, None, None], None), (ensemble.majority(), ["warning", "warning", "warning"], None)])
def test_elections(spark, election, votes, want):
    df = spark.createDataFrame([(votes,)], "verdicts array<string>")
    assert ensemble.elect(df, election).first().verdict == want


def test_members(spark):
    a = spark.createDataFrame([(1, "drift", 0, 1), (2, None, None, None)], "batch long, verdict string, rec_first long, rec_last long")
    b = spark.createDataFrame([(1, "warning")], "batch long, verdict string")
    rows = ensemble.members_of({"a": a, "b": b}, ["batch"]).orderBy("batch").collect()
    assert rows[0].drift_states == {"a": "drift", "b": "warning"} and list(rows[0].retraining_recs) == ["a"] and rows[1].verdicts == [None, None]


def test_whole_vectors_against_brute_force(spark):
    """sf0.001; with the first three components alone the neighbours and the distance are other ones."""
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, labels, x = np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    nearest = lambda x, k: ((x[:, None] - x[None]) ** 2).sum(2).argsort(1, kind="stable")[:, :k]
    near = nearest(x, 5)
    got = {(r.src, r["rank"]): r.dst for r in batch_queries.QUERIES["knn_edges"](spark, d).collect()}
    assert got == {(ids[i], j + 1): ids[near[i, j]] for i in range(len(x)) for j in range(5)}
    dense = {r.dst: (r.a, r.b) for r in batch_queries.QUERIES["nnps_density"](spark, d).collect()}
    assert dense == {ids[j]: tuple(int((labels[(near == j).any(1)] % 2 == odd).sum()) for odd in (0, 1)) for j in set(near.ravel())}
    first = batch_queries.QUERIES["nndvi"](spark, d).orderBy("total").first()
    both = labels % 3 <= 1
    points, where = np.unique(x[both], axis=0, return_inverse=True)
    ones, twos = (np.isin(np.arange(len(points)), where.ravel()[labels[both] % 3 == b]) for b in (0, 1))
    near = nearest(points, 30)
    a, b = (np.bincount(near[side].ravel(), minlength=len(points)) for side in (ones, twos))
    assert abs(first.distance - np.mean((np.abs(a - b) / np.maximum(a + b, 1))[a + b > 0])) < 1e-9


def test_queries_draw_as_often_as_the_defaults(spark, monkeypatch):
    """kdq_batch, ensemble_batch and nndvi take the draws and neighbours of the operators' defaults, 500 and 30."""
    draws, near = [], []
    critical, permuted, neighbours = kdq.critical_value, nn.permuted_distances, nn.neighbours
    monkeypatch.setattr(kdq, "critical_value", lambda counts, size, alpha, samples, seed: draws.append(samples) or critical(counts, size, alpha, samples, seed))
    monkeypatch.setattr(nn, "permuted_distances", lambda edges, n, ones, times, seed: draws.append(times) or permuted(edges, n, ones, times, seed))
    monkeypatch.setattr(nn, "neighbours", lambda points, k: near.append(k) or neighbours(points, k))
    for name in ("kdq_batch", "ensemble_batch", "nndvi"):
        draws.clear()
        batch_queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert set(draws) == {500}, name
    assert set(near) == {30}


def test_md3(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 1.0, 0), (5.0, 6.0, 1), (6.0, 7.0, 1), (3.0, 4.0, 1)], "var1 double, var2 double, y int")
    far = md3.Linear((10.0, 10.0), -45.0)
    got = md3.reference_statistics(rows, ["var1", "var2"], "y", k=2, fit=lambda _: far)
    assert got == {"length": 5, "md": 0, "md_std": 0, "acc": 1, "acc_std": 0}
    learnt = md3.fit_linear(rows, ["var1", "var2"], "y", regParam=0.01)
    assert rows.where(md3.predicted(learnt, ["var1", "var2"]) == F.col("y")).count() == 5
    assert rows.select(md3.inside_margin(md3.Linear((1.0, 2.0), -6.0), ["var1", "var2"], "scaled").alias("m")).where("m = 1").count() == 1
    with pytest.raises(ValueError):
        md3.reference_statistics(rows, ["var1", "var2"], "y", k=6)


def test_md3_margins(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (3.0, 1.0), (0.2, 0.2)], "a double, b double")
    model = md3.Linear((1.0, 2.0), -6.0)
    for mode in ("scaled", "functional"):
        got = [(r.m, r.p) for r in rows.select(md3.inside_margin(model, ["a", "b"], mode).alias("m"), md3.predicted(model, ["a", "b"]).alias("p")).collect()]
        assert got == [md3.scorer(model, mode)(tuple(r)) for r in rows.collect()]
    own = md3.inside_margin(model, ["a", "b"], lambda m, f: F.col(f[0]) > 1)
    assert [r[0] for r in rows.select(own).collect()] == [0, 1, 0]
    with pytest.raises(ValueError):
        md3.inside_margin(md3.Linear((1.0,), 0.0), ["a"])


def test_fit_local():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 2))
    y = (x[:, 0] - 2 * x[:, 1] > 0.3).astype(int)
    model = md3.fit_local(x, y)
    assert np.mean([md3.scorer(model)(r)[1] == t for r, t in zip(x, y, strict=True)]) > 0.97
    assert md3.fit_local([[1.0, 2.0]], [1]) == md3.Linear((0.0, 0.0), 1.0)


def test_md3_watched_against_plain_replay(spark):
    """The rows of the learnt query are those of the protocol run over plain lists, with a model learnt from the earlier rows."""
    data = "/root/testdata/sf0.001"
    known, later = streams.md3_tables(spark, data)
    model, ref = streams.md3_fit(known), {"md": 0.3, "md_std": 0.02, "acc": 0.95, "acc_std": 0.02, "length": 500}
    score = md3.scorer(model, "functional")
    seen = [(score((r.f0, r.f1))[1] == r.y) for r in known.collect()]
    assert sum(seen) > 0.9 * len(seen) and len(seen) + later.count() == spark.read.parquet(f"{data}/events.parquet").count()
    refit = lambda rows: md3.refit_statistics(rows, lambda xs, ys: md3.scorer(md3.fit_local(xs, ys), "functional"), 10)
    step = concept.MarginDensity(**{**ref, "length": 20}, oracle_length=5, strict=False, restate=refit, carry=("x", "y"))
    states, want = {}, []
    for r in sorted(later.collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        inside, label = score((r.f0, r.f1))
        out = step.step(states.setdefault(r.user_id, step.start()), "oracle" if r.event_id % 3 == 0 else "sample", inside, int(label == r.y), [r.f0, r.f1], r.y)
        want.append((r.user_id, r.event_id, out[0], out[1], out[2], out[6], out[7], out[5]))
    got = sorted((r.user_id, r.event_id, r.verdict, r.total, r.since, r.waiting, r.labelled, r.margin_density) for r in streams.md3_watched(later, model, ref).collect())
    assert [r[:-1] for r in got] == [r[:-1] for r in sorted(want)]
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in sorted(want)], abs=1e-6)
    assert any(r[2] == "drift" for r in got)


def test_kdq_counts_are_reset_and_add_up():
    tree = kdq.build_local(np.random.default_rng(2).random((300, 2)) * 9, 20, 2e-10)
    empty = tree.reset()
    assert set(empty.count) == {0} and empty.axis == tree.axis and tree.count[0] == 300 and set(tree.reset(7).count) == {7}
    assert empty.counting(tree.leaf_counts()).count == tree.count
    assert tree.counting(tree.leaf_counts()).count == [2 * c for c in tree.count]


def test_datasets(spark, tmp_path):
    df = datasets.example_batches(spark, 200)
    assert df.count() == 3000 and set(df.columns) >= {"year", *"abcdefghij", "cat", "confidence", "drift"}
    s = {r.year: r for r in df.groupBy("year").agg(F.avg("b").alias("b"), F.corr("e", "f").alias("ef"), F.avg("h").alias("h"), F.avg("j").alias("j"), F.max("confidence").alias("c"), F.max("cat").alias("cat")).collect()}
    assert abs(s[2009].b - 500) < 5 and abs(s[2010].b - 200) < 5 and abs(s[2015].ef - 0.5) < 0.2 and s[2020].h < 2000 < s[2010].h and s[2021].j < 200 and s[2018].c < 0.6 < s[2019].c
    (tmp_path / "c.csv").write_text("1,2,0,9\n3,4,1,9\n")
    assert [tuple(r) for r in datasets.circle(spark, str(tmp_path / "c.csv")).collect()] == [(1, 2, 0), (3, 4, 1)]
    (tmp_path / "r.csv").write_text(",".join("abcdefghij") + "\n" + ",".join(map(str, range(10))) + "\n")
    assert tuple(datasets.rainfall(spark, str(tmp_path / "r.csv")).first()) == tuple(range(1, 10))


def test_schema(spark, numbers):
    assert schema.validate(numbers, ["a", "b"]) is numbers
    for bad in (["nope"], ["s"]):
        with pytest.raises(ValueError):
            schema.validate(numbers.withColumn("s", F.lit("x")), bad)
    with pytest.raises(ValueError):
        schema.validate(numbers, ["a"], numbers.drop("b"))
    with pytest.raises(ValueError):
        schema.check_batches(numbers, "row_idx")
    with pytest.raises(Exception, match="no verdict"):
        schema.check_verdicts(spark.createDataFrame([("odd",)], "verdict string")).collect()


def test_hash_numbers(spark):
    df = spark.range(2000).select("id", hashrng.uniform(5, F.col("id")).alias("u"), hashrng.normal(5, F.col("id")).alias("z"), hashrng.gamma(5, 4, F.col("id")).alias("g"))
    rows = df.collect()
    assert all(r.u == hashrng.uniform_of(5, r.id) for r in rows[:50])
    mean = lambda v: sum(v) / len(v)
    assert abs(mean([r.u for r in rows]) - 0.5) < 0.03 and abs(mean([r.z for r in rows])) < 0.1 and abs(mean([r.g for r in rows]) - 4) < 0.3


def test_ensemble_in_one_fold(spark):
    """The members of one fold say what each says alone; nulls are passed over by those that read them."""
    rows = [(k, i, None if i % 9 == 4 else float((i * 37 + k * 11) % 100 + (60 if i > 40 else 0)), None if i % 6 == 1 else i % 2) for k in range(3) for i in range(80)]
    df = spark.createDataFrame([*rows, (None, 0, 3.0, 1), (0, 99, None, None)], "k int, i int, v double, bit int")
    detectors = {"ph": change.PageHinkley(threshold=1, burn_in=10), "ddm": concept.Ddm(n_threshold=5, warning_scale=1.1, drift_scale=1.5)}
    inputs = {"ph": {"x": "v"}, "ddm": {"y_true": F.lit(1), "y_pred": F.col("bit")}}
    together = ensemble.stream_members(df, detectors, ["k"], ["i"], inputs)
    traces = {n: run_fold(df, d, ["k"], ["i"], inputs[n]).select("k", "i", "verdict", "rec_first", "rec_last") for n, d in detectors.items()}
    apart = ensemble.members_of(traces, ["k", "i"])
    assert together.columns == apart.columns
    seen = lambda t: sorted(map(str, t.collect()))
    assert seen(together) == seen(apart) and any("drift" in r for r in seen(together))
    assert ensemble.stream_ensemble(df.limit(0), detectors, ["k"], ["i"], inputs).count() == 0


def _bin_rows(spark, bins):
    """One key with counts in every third bin, and the shares of reference and test in all bins."""
    cells = [("k", i, 1 + i % 5, 2 + i % 3) for i in range(0, bins, 3)]
    r, t = np.zeros(bins), np.zeros(bins)
    for _, i, a, b in cells:
        r[i], t[i] = a, b
    rows = spark.createDataFrame(cells, "key string, bin int, r long, t long")
    return rows.selectExpr("*", f"{int(r.sum())}L AS ref_n", f"{int(t.sum())}L AS test_n", f"{bins} AS bins"), r / r.sum(), t / t.sum()


def test_intersection_of_many_bins_is_a_sum_over_bins(spark):
    rows, r, t = _bin_rows(spark, 3000)
    began = time.monotonic()
    found = hdm._distance(rows, ["key"], "intersection").first()["distance"]
    assert abs(found - (1 - np.minimum(r, t).sum())) < 1e-9
    assert time.monotonic() - began < 60


def test_custom_divergence_sees_every_bin_once(spark):
    rows, r, t = _bin_rows(spark, 3000)
    began = time.monotonic()
    found = hdm._distance(rows, ["key"], density.hellinger).first()["distance"]
    assert abs(found - np.sqrt(((np.sqrt(t) - np.sqrt(r)) ** 2).sum())) < 1e-9
    firsts = hdm._distance(rows, ["key"], lambda a, b: F.size(a) * 1000 + F.element_at(a, 4) * 10 + F.element_at(b, -3)).first()["distance"]
    assert firsts == 3000 * 1000 + 4 * 10 + 2
    assert time.monotonic() - began < 60


def _brute(x, k):
    gap = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        gap += (x[:, c, None] - x[None, :, c]) ** 2
    return gap.argsort(1, kind="stable")[:, :k]


@pytest.mark.parametrize("kind", ["plain", "ties", "offset", "tiny", "huge", "nan"])
def test_nearest_is_exact(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8))
    x = {"plain": x, "ties": np.round(x[:, :2]), "offset": x + 1e7, "tiny": x * 1e-25, "huge": x * 1e150, "nan": np.where(rng.random(x.shape) < 0.001, np.nan, x)}[kind]
    task = nn.Nearest(np.arange(700), x, 5)
    for part in np.array_split(rng.permutation(700), 9):
        task.meet(part, x[part])
    assert (task.near == _brute(x, 5)).all()


def test_nearest_computes_few_pairs_in_full(monkeypatch):
    seen = []
    merge = nn.Nearest._merge
    monkeypatch.setattr(nn.Nearest, "_merge", lambda self, i, r, gap, ids: (seen.append(len(r)), merge(self, i, r, gap, ids))[1])
    x = np.random.default_rng(4).normal(size=(4000, 32))
    task = nn.Nearest(np.arange(4000), x, 5)
    for part in np.array_split(np.arange(4000), 8):
        task.meet(part, x[part])
    assert (task.near == _brute(x, 5)).all() and sum(seen) < 4000 * 5 * 4


def test_neighbours_of_copies_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK", 50)
    x = np.repeat(np.random.default_rng(5).integers(0, 3, (60, 3)).astype(float), 5, axis=0)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    found = nn.neighbours(points, 4).orderBy("src", "rank").collect()
    assert [r["dst"] for r in found] == _brute(x, 4).ravel().tolist() and [r["rank"] for r in found] == [1, 2, 3, 4] * 300


@pytest.mark.parametrize("node_rows", [100, 700, 10_000])
def test_kdq_tree_in_few_passes_is_the_same(spark, monkeypatch, node_rows):
    monkeypatch.setattr(kdq, "NODE_ROWS", node_rows)
    passes = []
    walk = kdq._with_path
    monkeypatch.setattr(kdq, "_with_path", lambda rows, splits: (passes.append(1), walk(rows, splits))[1])
    x = np.random.default_rng(6).normal(size=(3000, 3)).round(2)
    df = spark.createDataFrame([tuple(v) for v in x.tolist()], "a double, b double, c double")
    assert kdq.build_distributed(df, ["a", "b", "c"], 20, 2e-10).state() == kdq.build_local(x, 20, 2e-10).state()
    assert len(passes) <= {100: 12, 700: 5, 10_000: 1}[node_rows]
