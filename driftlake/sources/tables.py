"""Tables written to the shared folder and read back, and small sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines see. Only where that is unset and there is but one machine, a local one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not known and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} it must name a folder that all machines share")
    return (known or f"file://{tempfile.gettempdir()}/driftlake-shared").rstrip("/")


def settled(df: DataFrame, kind: str = "table") -> DataFrame:
    """df, computed once and written to the shared folder: every later read sees the same rows, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_trace(df: DataFrame, path: str, *by: str) -> None:
    """A detector's rows as Parquet, partitioned by the given columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
