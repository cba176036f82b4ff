"""Folds in Spark: batch and stream agree with the plain state machine; queries agree with their SQL."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from driftlake import catalogue
from driftlake.operators import change, concept
from driftlake.operators.fold import run_fold
from driftlake.streaming.stateful import run_stream

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def stream_rows(keys=3, n=120):
    return [(k, i, float((i * 37 + k * 11) % 100) + (60 if i > 70 else 0)) for k in range(keys) for i in range(n)]


def plain(step, rows):
    out, states = [], {}
    for k, i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.append((k, i, *step.step(states.setdefault(k, step.start()), x)))
    return out


STEPS = [change.PageHinkley(threshold=1, burn_in=10), change.Cusum(burn_in=10, threshold=4), change.Adwin(delta=0.5, new_sample_thresh=4)]


@pytest.mark.parametrize("step", STEPS, ids=lambda s: type(s).__name__)
def test_batch_fold(spark, step):
    rows = [*stream_rows(), (None, 1, 5.0), (None, 0, 3.0)]
    df = spark.createDataFrame([*rows, (0, 500, None)], "k int, i int, x double").repartition(5)
    got = [tuple(r) for r in run_fold(df, step, ["k"], ["i"]).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=order) == plain(step, rows)


def test_fold_edges(spark):
    empty = spark.createDataFrame([], "k int, i int, x double, verdict string")
    got = run_fold(empty.withColumnRenamed("verdict", "seen"), STEPS[0], ["k"], ["i"], keep=["seen"])
    assert got.count() == 0 and "seen" in got.columns
    one = spark.createDataFrame([(i, 1.0) for i in range(5)], "i int, x double")
    assert run_fold(one, STEPS[0], [], ["i"]).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    rows, step = stream_rows(2, 90), STEPS[0]
    source = tmp_path / "in"
    for part in range(3):  # one file a micro-batch, rows in no order
        mine = [r for r in rows if r[1] // 30 == part]
        spark.createDataFrame(mine[::-1], "k int, i long, x double").coalesce(1).write.mode("append").parquet(str(source))
        if part == 2:
            spark.createDataFrame([(0, 3, 1.0)], "k int, i long, x double").coalesce(1).write.mode("append").parquet(str(source))
    df = spark.readStream.schema("k int, i long, x double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = run_stream(df, step, ["k"], "i").writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("folded").collect()
    assert [(r.k, r.i) for r in got if r.late] == [(0, 3)]
    assert sorted(tuple(r)[:-1] for r in got if not r.late) == plain(step, rows)


def test_recommendations_of_a_drift_without_warning():
    step = concept.Ddm(n_threshold=2)
    s = step.start()
    step.step(s, 1, 1)
    assert step.step(s, 1, 1)[3:5] == (1, 1)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def table(rows, columns):
    same = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else str(v)
    return sorted(tuple(str(same(v)) for v in r) for r in pd.DataFrame(rows, columns=columns).sort_index(axis=1).astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {"example_batch_data"}))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_the_rest_works_without_optional_parts(tmp_path):
    for f in ROOT.rglob("*.py"):
        name = f.relative_to(ROOT)
        if "llm" not in name.parts and name.name != "corpus_pipeline.py" and ".git" not in name.parts:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_bytes(f.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ph_trace' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_optional_parts():
    for f in (ROOT / "driftlake").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"driftlake\.llm|corpus_pipeline", f.read_text()), f
