"""What several operators of this subpackage need: a folder that all machines see, written tables, distributed prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlake.sources.tables import shared_dir

#: Words are maximal runs of anything but ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path made by new_path() that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, kind: str = "table") -> tuple[DataFrame, str]:
    """df, computed once, written to the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fresh(df: DataFrame | Sequence[str], *names: str) -> list[str]:
    """names, each lengthened until no column of df (whatever its case) has it."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of one byte a character take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, order: Sequence[str], values: dict[str, str], group: str | None = None) -> tuple[DataFrame, str]:
    """For each row the exclusive sum of every value over the rows before it (in its group): values maps the value to the new column.

    Rows are range-partitioned by (group, order) and written once with the number of their partition, so that the totals and the rows
    see the same cut. Totals per partition (and group) are summed up over the few partitions before; inside a partition a running window adds
    its own. No task sees more than one range. order must split hot groups: only rows equal in all of it share a range for sure.
    Values must not be null. Returns the rows and the path of the written table.
    """
    pid, base = fresh(df, "pid", "base")
    keys = [F.col(c).asc_nulls_last() for c in ([group] if group else []) + list(order)]
    cut, path = written(df.repartitionByRange(*keys).withColumn(pid, F.spark_partition_id()), "ranges")
    bases = {v: f"{base}_{i}" for i, v in enumerate(values)}
    by = [pid] + ([group] if group else [])
    totals = cut.groupBy(*by).agg(*(F.sum(v).alias(b) for v, b in bases.items()))
    before = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    g = f"{base}_g"
    offsets = totals.select(F.col(pid).alias(f"{base}_p"), *([F.col(group).alias(g)] if group else []), *(F.coalesce(F.sum(b).over(before), F.lit(0)).alias(b) for b in bases.values()))
    on = F.col(pid) == F.col(f"{base}_p")
    if group:
        on = on & F.col(group).eqNullSafe(F.col(g))
    inside = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({out: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, out in values.items()})
    joined = local.join(offsets, on)
    return joined.select(*df.columns, *((F.col(out) + F.col(bases[v])).alias(out) for v, out in values.items())), path


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside other lambdas (the optimizer would copy it there)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(df: DataFrame, row: str) -> DataFrame:
    """df with a column row that tells its rows apart and stays the same however often it is computed.

    Where df comes straight from files, file and place in it; otherwise df is written once, with a running number.
    """
    if "_metadata" in df._jdf.queryExecution().analyzed().metadataOutput().mkString(","):
        return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(row))
    return written(df.withColumn(row, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered")[0]
