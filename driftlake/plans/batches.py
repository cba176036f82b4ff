"""Queries of the batch detectors, partitioners, injectors and tables: line items by year of shipping, embeddings, customers, parts."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions import density
from driftlake.functions.hashrng import uniform_sql
from driftlake.operators import ensemble, hdm, inject, kdq, nn
from driftlake.plans import schema
from driftlake.sources import datasets

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
#: Rows of a batch by which its halves and draws are told apart.
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.year("l_shipdate").cast("long").alias("year"), *dict.fromkeys([*FEATURES, *ROW]))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select(F.year("o_orderdate").cast("long").alias("year"), "o_orderkey", "o_totalprice")


def _pairs(divergence):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = hdm.distance_table(lines(spark, sf_dir), "year", FEATURES, divergence)
        return found.select("start", "batch", F.col("f").cast("long").alias("f"), F.round("distance", 9).alias("distance"))

    return query


def hist_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of 20 bins between the least and greatest quantity of all, by year."""
    t = lines(spark, sf_dir).select("year", F.col("l_quantity").alias("x"))
    ends = t.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return t.crossJoin(F.broadcast(ends)).groupBy("year", density.bin_index(F.col("x"), F.col("lo"), F.col("hi"), F.lit(20)).cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


def _hdddm(**kwargs):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = hdm.hdddm(lines(spark, sf_dir), "year", FEATURES, **kwargs)
        return found.select("batch", "total", "since", F.round("distance", 9).alias("distance"), F.round("epsilon", 9).alias("epsilon"), F.round("threshold", 9).alias("threshold"), "verdict", "reference_from", "drift_feature")

    return query


def cdbd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hdm.cdbd(orders(spark, sf_dir), "year", "o_totalprice", order=["o_orderkey"])
    return found.select("batch", "total", "since", *(F.round(c, 9).alias(c) for c in ("distance", "epsilon", "threshold")), "verdict")


def hdm_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation as a divergence of one's own."""

    def variation(ref, test):
        share = lambda x: density.bound(F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b), lambda n: F.transform(x, lambda v: v / n))
        return F.aggregate(F.zip_with(share(ref), share(test), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / 2

    found = hdm.hdm(orders(spark, sf_dir), "year", ["o_totalprice"], variation, detect_batch=3, statistic="stdev")
    return found.select("batch", "total", "since", *(F.round(c, 9).alias(c) for c in ("distance", "epsilon", "threshold")), "verdict")


def _first_year_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, kdq.KdqTree]:
    t = lines(spark, sf_dir)
    first = t.agg(F.min("year")).first()[0]
    here = t.where(F.col("year") == first)
    return t, first, kdq.build(here, FEATURES, max(100, here.count() // 20), 2e-10)


def kdq_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the first year, with the counts of the second and the scan statistic."""
    t, first, tree = _first_year_tree(spark, sf_dir)
    counts = [0] * tree.leaves
    for r in kdq.fill(t.where(F.col("year") == first + 1), tree, FEATURES).collect():  # one row per cell
        counts[r["leaf"]] = r["n"]
    return kdq.node_table(spark, tree, FEATURES, counts).withColumn("kss", F.round("kss", 9))


def kdq_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the first year, emptied, then filled with the second and with the third."""
    t, first, tree = _first_year_tree(spark, sf_dir)
    tree = tree.reset()
    for year in (first + 1, first + 2):
        counts = [0] * tree.leaves
        for r in kdq.fill(t.where(F.col("year") == year), tree, FEATURES).collect():  # one row per cell
            counts[r["leaf"]] = r["n"]
        tree = tree.counting(counts)
    return kdq.node_table(spark, tree, FEATURES).select("node_id", "cell_count")


def kdq_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _, tree = _first_year_tree(spark, sf_dir)
    return kdq.fill(t, tree, FEATURES, ["year"])


def kdq_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of every later year from the first over the cells of its tree."""
    t, first, tree = _first_year_tree(spark, sf_dir)
    counts = {}
    for r in kdq.fill(t.where(F.col("year") > first), tree, FEATURES, ["year"]).collect():  # a row per year and cell
        counts.setdefault(r["year"], np.zeros(tree.leaves))[r["leaf"]] = r["n"]
    rows = [(y, round(kdq.divergence(tree.leaf_counts(), c), 9)) for y, c in sorted(counts.items())]
    return spark.createDataFrame(rows, "year long, distance double")


def kdq_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdq.kdq_batches(lines(spark, sf_dir), "year", FEATURES, count_ubound=200)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: the whole vector."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector."""
    points = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "x")
    return nn.neighbours(points, 5).select("src", "dst", F.col("rank").cast("long").alias("rank"))


def _by_parity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges to the 5 nearest of every vector, and the vectors in two samples, by even and odd labels."""
    even = (F.col("label") % 2 == 0).cast("long")
    points = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", even.alias("in_1"), (1 - even).alias("in_2"))
    return nn.neighbours(points.select("id", "x"), 5), points


def nnps_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector, how many of the even and of the odd labels have it among their 5 nearest."""
    return nn.shared_density(*_by_parity(spark, sf_dir))


def nnps_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unevenly even and odd labels share neighbourhoods."""
    return spark.createDataFrame([(round(nn.nnps_distance(*_by_parity(spark, sf_dir)), 9),)], "distance double")


def nndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole vectors, in batches by label."""
    t = _embeddings(spark, sf_dir).withColumn("batch", F.pmod("label", F.lit(3)))
    return nn.nndvi(t, "batch", "x")


def ensemble_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    d3 = hdm.hdddm(t, "year", FEATURES, detect_batch=3).select("batch", "verdict")
    tree = kdq.kdq_batches(t, "year", FEATURES, count_ubound=200).select("batch", "verdict")
    return ensemble.batch_ensemble({"hdddm": d3, "kdq": tree}, "batch", ensemble.minimum(1)).select("batch", "verdict")


def ensemble_batch_hdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two divergences, one of which is enough."""
    t = lines(spark, sf_dir)
    member = lambda kind: hdm.hdm(t, "year", FEATURES, kind, detect_batch=3, statistic="stdev", significance=0.5).select("batch", "verdict")
    return ensemble.batch_ensemble({"hellinger": member("H"), "js": member("KL")}, "batch", ensemble.minimum(1)).select("batch", "verdict")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.with_index(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), ["c_custkey"])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.with_index(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_type"), ["p_partkey"])


def inject_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.feature_shift(_parts(spark, sf_dir), "row_idx", 10, 110, "p_size", 0.5).select("row_idx", "p_partkey", F.round("p_size", 6).alias("p_size"))


def inject_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.feature_swap(_parts(spark, sf_dir), "row_idx", 10, 110, "p_size", "p_retailprice").select("row_idx", "p_size", "p_retailprice")


def inject_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.feature_cover(_customers(spark, sf_dir), "c_mktsegment", 50, ["c_custkey"], seed=1).select("c_custkey", "c_nationkey")


def label_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.label_swap(_customers(spark, sf_dir), "row_idx", 20, 100, "c_mktsegment", "BUILDING", "MACHINERY").select("row_idx", "c_mktsegment")


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.label_join(_customers(spark, sf_dir), "row_idx", 20, 100, "c_mktsegment", "BUILDING", "MACHINERY", "BOTH").select("row_idx", "c_mktsegment")


def label_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.label_probability(_customers(spark, sf_dir), "row_idx", 0, 120, "c_mktsegment", {"BUILDING": 0.6}, seed=7).select("row_idx", "c_custkey", "c_mktsegment")


def label_dirichlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.label_dirichlet(_customers(spark, sf_dir), "row_idx", 0, 120, "c_mktsegment", {"BUILDING": 5.0, "MACHINERY": 1.0}, seed=7).select("row_idx", "c_custkey", "c_mktsegment")


def brownian_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.brownian_noise(_parts(spark, sf_dir), "row_idx", 5, 105, "p_size", 1.0, seed=3).select("row_idx", F.round("p_size", 6).alias("p_size"))


def example_batch_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated table, whose size does not depend on sf_dir; its numbers to three digits, confidence to nine."""
    t = datasets.example_batches(spark)
    places = {**dict.fromkeys("abcdefghij", 3), "confidence": 9}
    return t.select(*(F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in t.columns))


def validate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.batch_sizes(schema.validate(lines(spark, sf_dir), FEATURES), "year")


QUERIES = {
    "hist_density": hist_density,
    "hellinger_pairs": _pairs("H"),
    "js_pairs": _pairs("KL"),
    "intersection_pairs": _pairs("intersection"),
    "hdddm_d3": _hdddm(detect_batch=3, statistic="stdev", significance=0.5),
    "hdddm_d2": _hdddm(detect_batch=2),
    "hdddm_d1": _hdddm(detect_batch=1, order=ROW),
    "cdbd": cdbd,
    "hdm_custom_divergence": hdm_custom,
    "kdq_nodes": kdq_nodes,
    "kdq_reset": kdq_reset,
    "kdq_fill": kdq_fill,
    "kdq_batch": kdq_batch,
    "kdq_kl": kdq_kl,
    "knn_edges": knn_edges,
    "nnps_density": nnps_density,
    "nnps_distance": nnps_distance,
    "nndvi": nndvi,
    "ensemble_batch": ensemble_batch,
    "ensemble_batch_hdm": ensemble_batch_hdm,
    "inject_shift": inject_shift,
    "inject_swap": inject_swap,
    "inject_cover": inject_cover,
    "label_swap": label_swap,
    "label_join": label_join,
    "label_probability": label_probability,
    "label_dirichlet": label_dirichlet,
    "brownian_noise": brownian_noise,
    "example_batch_data": example_batch_data,
    "validate_schema": validate_schema,
}

_LINES = "SELECT year(l_shipdate) AS b, unnest([0, 1, 2]) AS f, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem"
_ORDERS = "SELECT year(o_orderdate) AS b, 0 AS f, o_totalprice AS v FROM orders"


def _bins(source: str) -> str:
    """h: shares r and t of reference and test in every bin, for all starts and batches."""
    return f"""
    l AS ({source}),
    y AS (SELECT DISTINCT b FROM l), p AS (SELECT s.b AS start, t.b AS batch FROM y s JOIN y t ON s.b < t.b),
    st AS (SELECT b, f, min(v) AS lo, max(v) AS hi, count(*) AS n FROM l GROUP BY ALL),
    ed AS (SELECT start, batch, f, min(lo) AS lo, max(hi) AS hi, sum(CASE WHEN b < batch THEN n ELSE 0 END) AS rn, sum(CASE WHEN b = batch THEN n ELSE 0 END) AS tn,
      CAST(floor(sqrt(sum(CASE WHEN b < batch THEN n ELSE 0 END))) AS BIGINT) AS k FROM p JOIN st ON b BETWEEN start AND batch GROUP BY start, batch, f),
    h AS (SELECT start, batch, ed.f, rn, tn, least(CAST(floor((v - lo) / (hi - lo) * k) AS BIGINT), k - 1) AS bin, sum((b < batch)::INT) / rn::DOUBLE AS r, sum((b = batch)::INT) / tn::DOUBLE AS t
      FROM ed JOIN l ON l.f = ed.f AND b BETWEEN start AND batch GROUP BY start, batch, ed.f, rn, tn, bin),"""


_HALF = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * ln({a} * 2 / ({a} + {b})) ELSE 0 END"
_DISTANCES = {
    "H": lambda r, t: f"sqrt(sum(pow(sqrt({t}) - sqrt({r}), 2)))",
    "KL": lambda r, t: f"sqrt(greatest(0, sum(({_HALF(r, t)} + {_HALF(t, r)}) / 2)))",
    "intersection": lambda r, t: f"1 - sum(least({r}, {t}))",
    "variation": lambda r, t: f"sum(abs({r} - {t})) / 2",
}


def _pairs_sql(kind: str) -> str:
    return f"WITH {_bins(_LINES)} d AS (SELECT start, batch, f, {_DISTANCES[kind]("r", "t")} AS distance FROM h GROUP BY start, batch, f) SELECT start, batch, CAST(f AS BIGINT) AS f, round(distance, 9) AS distance FROM d"


def _drawn_sql(rows: str, kind: str, refs: int, subsets: int = 5) -> str:
    """e0: for every start s0 the bootstrapped first epsilon, of refs batches as reference, from distances between subsets drawn by hashes of the key.

    rows: SQL of (b, key, vs). A draw also depends on total0, the distances so far: one for each batch after the first and, where the first batch of an epoch is halved
    (refs = 1), one for each epoch, of which there may have been any number up to that of the batches.
    """
    limits, p, total = [], math.exp(1 / subsets - 1), 0.0
    for i in range(12):
        total += p
        limits.append(total)
        p *= (1 - 1 / subsets) / (i + 1)
    u = lambda s: f"CAST(('0x' || substr(md5(CAST(total AS VARCHAR) || ':{s}:' || key), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
    times = lambda s: "+".join(f"(u{s} >= {x!r}::DOUBLE)::INT" for x in limits)
    of = lambda name: ", ".join(name(s) for s in range(subsets))
    pairs = [(i, j) for i in range(subsets) for j in range(i + 1, subsets)]
    gaps = " + ".join(f"abs(d{a} - d{b})" for a in range(len(pairs)) for b in range(a + 1, len(pairs)))
    share = lambda s: f"(c{s}::DOUBLE / n{s})"
    distances = ", ".join(f"{_DISTANCES[kind](share(i), share(j))} AS d{a}" for a, (i, j) in enumerate(pairs))
    epochs = "unnest(range(1, start - b0 + 2))" if refs == 1 else "0"
    return f"""
    sr AS ({rows}),
    ss AS (SELECT start, b0, start + {refs} - b0 + {epochs} AS total FROM (SELECT b AS start, min(b) OVER () AS b0 FROM y)),
    du AS (SELECT start, total, vs, {of(lambda s: f"{u(s)} AS u{s}")} FROM sr JOIN ss ON b BETWEEN start AND start + {refs - 1}),
    dw AS (SELECT start, total, unnest(range(len(vs))) AS f, unnest(vs) AS v, {of(lambda s: f"{times(s)} AS c{s}")} FROM du),
    db AS (SELECT dw.start, total, dw.f, least(CAST(floor((v - lo) / (hi - lo) * k) AS BIGINT), k - 1) AS bin, {of(lambda s: f"sum(c{s}) AS c{s}")}
      FROM dw JOIN ed ON ed.start = dw.start AND ed.batch = dw.start + {refs} AND ed.f = dw.f GROUP BY 1, 2, 3, 4),
    dn AS (SELECT start, total, f, {of(lambda s: f"sum(c{s}) AS n{s}")} FROM db GROUP BY start, total, f),
    df AS (SELECT start, total, f, {distances} FROM db JOIN dn USING (start, total, f) GROUP BY start, total, f),
    e0 AS (SELECT start AS s0, total AS total0, ({gaps}) / {subsets} AS e0
      FROM (SELECT start, total, {", ".join(f"sum(d{a}) AS d{a}" for a in range(len(pairs)))} FROM df GROUP BY start, total)),"""


def _halves_sql(kind: str, order: str) -> str:
    """hd: the distances hfs between both halves of every batch hb, in that order of the rows sr."""
    return f"""
    hr AS (SELECT b, vs, row_number() OVER (PARTITION BY b ORDER BY {order}) > count(*) OVER (PARTITION BY b) // 2 AS test FROM sr),
    hl AS (SELECT b, test, unnest(range(len(vs))) AS f, unnest(vs) AS v FROM hr),
    he AS (SELECT b, f, min(v) AS lo, max(v) AS hi, sum((NOT test)::INT) AS rn, sum(test::INT) AS tn, CAST(floor(sqrt(sum((NOT test)::INT))) AS BIGINT) AS k FROM hl GROUP BY b, f),
    hs AS (SELECT hl.b, hl.f, least(CAST(floor((v - lo) / (hi - lo) * k) AS BIGINT), k - 1) AS bin, sum((NOT test)::INT) / rn::DOUBLE AS r, sum(test::INT) / tn::DOUBLE AS t
      FROM hl JOIN he ON he.b = hl.b AND he.f = hl.f GROUP BY hl.b, hl.f, bin, rn, tn),
    hd AS (SELECT b AS hb, list(distance ORDER BY f) AS hfs FROM (SELECT b, f, {_DISTANCES[kind]("r", "t")} AS distance FROM hs GROUP BY b, f) GROUP BY b),"""


def _student_sql(df: str) -> str:
    """The 0.975 quantile of Student's distribution for many degrees of freedom, as a series around the normal one."""
    z = NormalDist().inv_cdf(0.975)
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return "(" + " + ".join(f"{v!r}::DOUBLE / pow({df}, {i})" for i, v in enumerate(terms)) + ")"


def _hdm_sql(source: str, kind: str, names: list[str], significance: float | None, out: str, rows: str = "", order: str = "") -> str:
    """Batches from the third of an epoch on are tested by mean and deviation, with a number for significance.

    Without, they are tested from the second distance on by Student's distribution and a bootstrap from rows (b, key, vs). With an order of these, the first batch of every epoch is
    halved and gives a first distance.
    """
    n, boot, halved = len(names), significance is None, bool(order)
    mean = lambda fs: f"({' + '.join(f'{fs}[{i}]' for i in range(1, n + 1))}) / {n}"
    on, epoch = "g.verdict IS NULL", 1 if halved else 0
    gap = "abs(distance - prev)"
    eps = f"CASE WHEN since >= 2 THEN list_append(eps0, {gap}) ELSE eps0 END"
    es = "es0 + CASE WHEN since >= 3 THEN eps[-2] ELSE 0 END"
    scale = "(total - lam - 1)"
    if boot:
        eps = f"CASE WHEN since = 2 THEN [e0, {gap}] WHEN since = 3 THEN [eps0[-1], {gap}] WHEN since > 3 THEN list_append(eps0, {gap}) ELSE eps0 END"
        es = "CASE WHEN since = 2 THEN e0 WHEN since = 3 THEN eps[-2] WHEN since > 3 THEN es0 + eps[-2] ELSE es0 END"
        scale = "(CASE WHEN since = 2 THEN 1 ELSE total - lam - 1 END)"
    sd = f"sqrt(list_sum(list_transform(eps[:-2], lambda e: pow(e - es / {scale}, 2))) / {scale})"
    threshold = f"CASE WHEN since >= 3 THEN es / {scale} + {significance}::DOUBLE * {sd} END"
    if boot:
        threshold = f"CASE WHEN since >= 2 THEN es / {scale} + {_student_sql('(rn + tn - 2)')} * {sd} / sqrt({scale}) END"
    named = ", ".join(f"'{c}'" for c in names)
    feature = f"CASE WHEN verdict IS NOT NULL THEN [{named}][list_position(gap, list_max(gap))] END" if n > 1 else "NULL"
    tables = _drawn_sql(rows, kind, 1 if halved else 2) if boot else ""
    tables += _halves_sql(kind, order) if halved else ""
    first = f"{mean('hfs')} AS prev, hfs AS prev_f" if halved else f"0.0::DOUBLE AS prev, CAST([{', '.join('0' * n)}] AS DOUBLE[]) AS prev_f"
    before = f"CASE WHEN {on} THEN g.prev ELSE {mean('hfs')} END AS prev, CASE WHEN {on} THEN g.prev_f ELSE hfs END AS prev_f" if halved else "g.prev, g.prev_f"
    total = f"g.total + CASE WHEN {on} THEN 1 ELSE {epoch + 1} END"
    return f"""
        WITH RECURSIVE {_bins(source)} {tables} d AS (SELECT start, batch, f, max(rn) AS rn, max(tn) AS tn, {_DISTANCES[kind]("r", "t")} AS distance FROM h GROUP BY start, batch, f),
        fe AS (SELECT start, batch, max(rn) AS rn, max(tn) AS tn, list(distance ORDER BY f) AS fs FROM d GROUP BY start, batch),
        z AS (SELECT min(b) AS b0, max(b) AS b1 FROM y),
        g AS (SELECT b0 AS batch, CAST({epoch} AS BIGINT) AS total, CAST({epoch} AS BIGINT) AS since, CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS epsilon, CAST(NULL AS DOUBLE) AS threshold,
            CAST(NULL AS VARCHAR) AS verdict, b0 AS start, CAST(0 AS BIGINT) AS lam, {first}, CAST([] AS DOUBLE[]) AS eps, 0.0::DOUBLE AS es, CAST(NULL AS VARCHAR) AS feature
          FROM z {"JOIN hd ON hb = b0" if halved else ""}
          UNION ALL
          SELECT batch, total, since, distance, epsilon, threshold, verdict, start, CASE WHEN verdict IS NULL THEN lam ELSE total END, CASE WHEN verdict IS NULL THEN distance ELSE prev END,
            CASE WHEN verdict IS NULL THEN fs ELSE prev_f END, eps, es, {feature} FROM (
          SELECT *, CASE WHEN epsilon > threshold THEN 'drift' END AS verdict, [{", ".join(f"fs[{i}] - prev_f[{i}]" for i in range(1, n + 1))}] AS gap FROM (
          SELECT *, {threshold} AS threshold FROM (
          SELECT *, {es} AS es FROM (
          SELECT *, {eps} AS eps, CASE WHEN since >= 2 THEN {gap} END AS epsilon FROM (
          SELECT fe.batch, {total} AS total, CASE WHEN {on} THEN g.since ELSE {epoch} END + 1 AS since, {mean("fs")} AS distance, fs, fe.start, fe.rn, fe.tn, g.lam, {before},
            CASE WHEN {on} THEN g.eps ELSE [] END AS eps0, CASE WHEN {on} THEN g.es ELSE 0 END AS es0 {", e0" if boot else ""}
          FROM g JOIN fe ON fe.batch = g.batch + 1 AND fe.start = CASE WHEN {on} THEN g.start ELSE g.batch END {"JOIN hd ON hb = fe.start" if halved else ""}
            {f"LEFT JOIN e0 ON s0 = fe.start AND (NOT {halved} OR total0 = {total})" if boot else ""}))))))
        SELECT {out} FROM g"""


_KEY_SQL = lambda columns: " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


def _rows_sql(table: str, day: str, features: list[str], key: list[str]) -> str:
    """(b, key, vs) and all columns of a table."""
    return f"SELECT *, year({day}) AS b, {_KEY_SQL(key)} AS key, [{', '.join(f'{c}::DOUBLE' for c in features)}] AS vs FROM {table}"


_ROUNDED = "round(distance, 9) AS distance, round(epsilon, 9) AS epsilon, round(threshold, 9) AS threshold, verdict"
_HDDDM_OUT = f"batch, total, since, {_ROUNDED}, start AS reference_from, feature AS drift_feature"
_KDQ = f"""WITH RECURSIVE a AS (SELECT row_number() OVER () AS id, year(l_shipdate) AS y, [{", ".join(f"{c}::DOUBLE" for c in FEATURES)}] AS x FROM lineitem),
    z AS (SELECT min(y) AS y0 FROM a), u AS (SELECT greatest(100, count(*) // 20) AS ub FROM a, z WHERE y = y0),
    t AS (SELECT id, x, x[f] AS v, '' AS path, 0 AS depth FROM a, z, (SELECT unnest([1, 2, 3]) AS f) WHERE y = y0
      UNION ALL SELECT id, x, v, path || CASE WHEN x[depth % 3 + 1] <= lo + (hi - lo) / 2 THEN '0' ELSE '1' END, depth + 1 FROM (
        SELECT *, max(dr) OVER (PARTITION BY path) AS kinds FROM (
        SELECT *, min(x[depth % 3 + 1]) OVER (PARTITION BY path) AS lo, max(x[depth % 3 + 1]) OVER (PARTITION BY path) AS hi, count(*) OVER (PARTITION BY path) // 3 AS n, dense_rank() OVER (PARTITION BY path ORDER BY v) AS dr FROM t)), u
        WHERE n > ub AND hi > lo AND kinds > ub),
    k AS (SELECT path, depth, count(*) // 3 AS n, min(x[depth % 3 + 1]) AS lo, max(x[depth % 3 + 1]) AS hi, count(DISTINCT v) AS kinds FROM t GROUP BY path, depth),
    nd AS (SELECT *, n > ub AND hi > lo AND kinds > ub AS split, lo + (hi - lo) / 2 AS mid, row_number() OVER (ORDER BY path) - 1 AS node_id FROM k, u),
    lf AS (SELECT *, CASE WHEN NOT split THEN CAST(sum((NOT split)::INT) OVER (ORDER BY path) - 1 AS INTEGER) END AS leaf FROM nd),
    w AS (SELECT id, y, x, '' AS path FROM a UNION ALL SELECT w.id, y, x, w.path || CASE WHEN x[depth % 3 + 1] <= mid THEN '0' ELSE '1' END FROM w JOIN lf ON lf.path = w.path WHERE split)"""
_TWO_CELLS = lambda c, d: f"(({c} + 0.5::DOUBLE) / ({c} + {d} + 1))"


def _labels_sql(share: str) -> str:
    return f"""
        WITH c AS {_CUSTOMERS}, r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY row_idx) - 1 AS place FROM c WHERE row_idx < 120),
        s AS (SELECT class, n, {share} AS share FROM (SELECT c_mktsegment AS class, count(*) AS n FROM r GROUP BY 1)),
        w AS (SELECT *, coalesce(sum(share) OVER (ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, row_number() OVER (ORDER BY class DESC) = 1 AS last FROM s),
        p AS (SELECT row_idx, class AS taken, CAST(least(greatest(floor((u - low) / nullif(share / n, 0)), 0), n - 1) AS BIGINT) AS at_place FROM (SELECT row_idx, {uniform_sql(7, "row_idx")} AS u FROM r) JOIN w ON u >= low AND (u < low + share OR last))
        SELECT row_idx, c_custkey, c_mktsegment FROM c WHERE row_idx >= 120 UNION ALL SELECT p.row_idx, r.c_custkey, r.c_mktsegment FROM p JOIN r ON r.c_mktsegment = taken AND r.place = at_place"""


def _gamma_sql(seed: int, shape: int, *key: str) -> str:
    return "(-(" + " + ".join(f"ln(1 - {uniform_sql(seed, *key, str(i))})" for i in range(shape)) + "))"


def _example_sql() -> str:
    g = lambda name, shape: _gamma_sql(123, shape, f"'{name}'", "row_idx")
    u = lambda *key: uniform_sql(123, *(f"'{k}'" if k != "row_idx" else k for k in key))
    z = lambda name: f"(sqrt(-2 * ln(1 - {u(name, 'row_idx', 'u')})) * cos({u(name, 'row_idx', 'v')} * 6.283185307179586::DOUBLE))"
    columns = {
        "a": f"{g('a', 8)} * 1000",
        "b": f"CASE WHEN year = 2009 THEN 500 ELSE 200 END + 10 * {z('b')}",
        "c": f"CASE WHEN year = 2012 AND row_idx % 10 = 0 THEN 7000 + 10 * {z('c')} ELSE {g('c', 7)} * 1000 END",
        "d": f"CASE WHEN year = 2012 AND row_idx % 2 = 0 THEN 100000 + 10 * {z('d')} ELSE {g('d', 10)} * 10000 END",
        "e": f"{z('e')} * sqrt(2.0::DOUBLE)",
        "f": f"CASE WHEN year = 2015 THEN {z('e')} * sqrt(0.5::DOUBLE) + {z('f')} * sqrt(1.5::DOUBLE) ELSE {z('f')} * sqrt(2.0::DOUBLE) END",
        "g": f"{g('g', 11)} * 10000",
        "h": f"CASE WHEN year > 2018 THEN {g('h', 1)} ELSE {g('h', 12)} END * 1000",
        "i": f"{g('i', 9)} * 1000",
        "j": f"{g('j', 10)} * CASE WHEN year = 2021 THEN 10 ELSE 100 END",
    }
    cat = " + ".join(f"({u('cat', 'row_idx')} >= {x}::DOUBLE)::INT" for x in (0.3, 0.6, 0.8, 0.9, 0.95, 0.99))
    numbers = ", ".join(f"round({sql}, 3) + 0.0 AS {name}" for name, sql in columns.items())
    return f"""SELECT row_idx, year, {numbers}, {cat} AS cat, round(CASE WHEN year > 2018 THEN 0.4::DOUBLE ELSE 0 END + 0.6::DOUBLE * {u('confidence', 'row_idx')}, 9) AS confidence, year IN (2009, 2012, 2015, 2018, 2021) AS drift
        FROM (SELECT range AS row_idx, 2007 + range // 20000 AS year FROM range(300000))"""


_INDEX = lambda t, k: f"(SELECT *, row_number() OVER (ORDER BY {k}) - 1 AS row_idx FROM {t})"
_CUSTOMERS, _PARTS = _INDEX("customer", "c_custkey"), _INDEX("part", "p_partkey")
_KNN = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    k AS (SELECT x.vec_id AS src, y.vec_id AS dst, x.label AS label, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.e, y.e), y.vec_id) AS rank FROM v x CROSS JOIN v y),
    n AS (SELECT dst, CAST(sum((label % 2 = 0)::INT) AS BIGINT) AS a, CAST(sum((label % 2 <> 0)::INT) AS BIGINT) AS b FROM k WHERE rank <= 5 GROUP BY dst)"""

_DIRICHLET = [_gamma_sql(7, shape, "'dirichlet'", f"'{c}'") for c, shape in (("BUILDING", 5), ("MACHINERY", 1))]

ORACLE_SQL = {
    "hist_density": """
        WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
        SELECT year(l_shipdate) AS year, least(CAST(floor((l_quantity - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2""",
    "hellinger_pairs": _pairs_sql("H"),
    "js_pairs": _pairs_sql("KL"),
    "intersection_pairs": _pairs_sql("intersection"),
    "hdddm_d3": _hdm_sql(_LINES, "H", FEATURES, 0.5, _HDDDM_OUT),
    "hdddm_d2": _hdm_sql(_LINES, "H", FEATURES, None, _HDDDM_OUT, _rows_sql("lineitem", "l_shipdate", FEATURES, FEATURES)),
    "hdddm_d1": _hdm_sql(_LINES, "H", FEATURES, None, _HDDDM_OUT, _rows_sql("lineitem", "l_shipdate", FEATURES, ROW), ", ".join(ROW)),
    "cdbd": _hdm_sql(_ORDERS, "KL", ["o_totalprice"], None, f"batch, total, since, {_ROUNDED}", _rows_sql("orders", "o_orderdate", ["o_totalprice"], ["o_orderkey"]), "o_orderkey"),
    "hdm_custom_divergence": _hdm_sql(_ORDERS, "variation", ["o_totalprice"], 0.05, f"batch, total, since, {_ROUNDED}"),
    "ensemble_batch_hdm": f"""
        SELECT batch, CASE WHEN a.verdict = 'drift' OR b.verdict = 'drift' THEN 'drift' END AS verdict FROM ({_hdm_sql(_LINES, "H", FEATURES, 0.5, "batch, verdict")}) a JOIN ({_hdm_sql(_LINES, "KL", FEATURES, 0.5, "batch, verdict")}) b USING (batch)""",
    "kdq_nodes": f"""{_KDQ}, c AS (SELECT path, count(*) AS m FROM w, z WHERE y = y0 + 1 GROUP BY path),
        q AS (SELECT lf.*, coalesce(m, 0) AS m, max(n) OVER () AS n0, max(coalesce(m, 0)) OVER () AS m0 FROM lf LEFT JOIN c USING (path))
        SELECT q.node_id, p.node_id AS parent_id, CASE WHEN p.path IS NULL THEN 'kdqTree' ELSE ['l_quantity', 'l_extendedprice', 'l_discount'][p.depth % 3 + 1] || CASE WHEN q.path[-1] = '0' THEN ' <= ' ELSE ' > ' END || CAST(round(p.mid, 3) AS VARCHAR) END AS name,
          q.depth, CASE WHEN q.split THEN q.depth % 3 END AS axis, CASE WHEN q.split THEN q.mid END AS midpoint, NOT q.split AS is_leaf, q.leaf, q.n AS cell_count, m - q.n AS count_diff,
          round({_TWO_CELLS("q.n", "(n0 - q.n)")} * ln({_TWO_CELLS("q.n", "(n0 - q.n)")} / {_TWO_CELLS("m", "(m0 - m)")}) + {_TWO_CELLS("(n0 - q.n)", "q.n")} * ln({_TWO_CELLS("(n0 - q.n)", "q.n")} / {_TWO_CELLS("(m0 - m)", "m")}), 9) AS kss
        FROM q LEFT JOIN nd p ON q.path <> '' AND p.path = left(q.path, length(q.path) - 1)""",
    "kdq_reset": f"""{_KDQ}, c AS (SELECT path, count(*) AS m FROM w, z WHERE y IN (y0 + 1, y0 + 2) GROUP BY path)
        SELECT node_id, coalesce(m, 0) AS cell_count FROM lf LEFT JOIN c USING (path)""",
    "kdq_fill": f"{_KDQ} SELECT y AS year, leaf, count(*) AS n FROM w JOIN lf USING (path) WHERE NOT split GROUP BY y, leaf",
    "kdq_kl": f"""{_KDQ}, c AS (SELECT y, leaf, count(*) AS m FROM w JOIN lf USING (path) WHERE NOT split GROUP BY y, leaf),
        q AS (SELECT v.y, (n + 0.5::DOUBLE) / (sum(n) OVER (PARTITION BY v.y) + count(*) OVER (PARTITION BY v.y) / 2.0::DOUBLE) AS p, (coalesce(m, 0) + 0.5::DOUBLE) / (sum(coalesce(m, 0)) OVER (PARTITION BY v.y) + count(*) OVER (PARTITION BY v.y) / 2.0::DOUBLE) AS q
          FROM lf CROSS JOIN (SELECT DISTINCT y FROM a, z WHERE y > y0) v LEFT JOIN c ON c.y = v.y AND c.leaf = lf.leaf WHERE NOT split)
        SELECT y AS year, round(sum(p * ln(p / q)), 9) AS distance FROM q GROUP BY y""",
    "knn_edges": f"{_KNN} SELECT src, dst, rank FROM k WHERE rank <= 5",
    "nnps_density": f"{_KNN} SELECT * FROM n",
    "nnps_distance": f"{_KNN} SELECT round(avg(abs(a - b) / (a + b)), 9) AS distance FROM n",
    "label_probability": _labels_sql("CASE class WHEN 'BUILDING' THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END"),
    "label_dirichlet": _labels_sql(f"CASE class WHEN 'BUILDING' THEN {_DIRICHLET[0]} / ({_DIRICHLET[0]} + {_DIRICHLET[1]}) WHEN 'MACHINERY' THEN {_DIRICHLET[1]} / ({_DIRICHLET[0]} + {_DIRICHLET[1]}) ELSE 0 END"),
    "example_batch_data": _example_sql(),
    "inject_shift": f"""
        WITH p AS {_PARTS}, m AS (SELECT 0.5::DOUBLE * (0.001::DOUBLE + avg(p_size)) AS d FROM p WHERE row_idx BETWEEN 10 AND 109)
        SELECT row_idx, p_partkey, round(CASE WHEN row_idx BETWEEN 10 AND 109 THEN p_size + d ELSE p_size END, 6) AS p_size FROM p, m""",
    "inject_swap": f"""SELECT row_idx, CASE WHEN row_idx BETWEEN 10 AND 109 THEN p_retailprice ELSE p_size::DOUBLE END AS p_size, CASE WHEN row_idx BETWEEN 10 AND 109 THEN p_size::DOUBLE ELSE p_retailprice END AS p_retailprice FROM {_PARTS}""",
    "inject_cover": f"""
        WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {uniform_sql(1, 'c_custkey')}, c_custkey) AS n FROM customer)
        SELECT c_custkey, c_nationkey FROM r WHERE n <= 50 // (SELECT count(DISTINCT c_mktsegment) FROM customer)""",
    "label_swap": f"SELECT row_idx, CASE WHEN row_idx BETWEEN 20 AND 99 AND c_mktsegment = 'BUILDING' THEN 'MACHINERY' WHEN row_idx BETWEEN 20 AND 99 AND c_mktsegment = 'MACHINERY' THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment FROM {_CUSTOMERS}",
    "label_join": f"SELECT row_idx, CASE WHEN row_idx BETWEEN 20 AND 99 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'BOTH' ELSE c_mktsegment END AS c_mktsegment FROM {_CUSTOMERS}",
    "brownian_noise": f"""
        WITH p AS {_PARTS}, w AS (SELECT row_idx, p_size, CASE WHEN row_idx BETWEEN 5 AND 104 THEN sum(CASE WHEN row_idx <= 5 OR row_idx > 104 THEN 0 WHEN {uniform_sql(3, 'row_idx')} < 0.5 THEN -1 ELSE 1 END) OVER (ORDER BY row_idx) END AS walk FROM p)
        SELECT row_idx, round(CASE WHEN walk IS NULL THEN p_size ELSE p_size + 1.0::DOUBLE + walk * 0.1::DOUBLE END, 6) AS p_size FROM w""",
    "validate_schema": "SELECT year(l_shipdate) AS batch, count(*) AS n, count(*) > 1 AS valid FROM lineitem GROUP BY 1",
}
