"""Example tables: two CSV files, if at hand, and a generated one with planted drifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions.hashrng import gamma, normal, uniform

#: Fixed names of the columns of the rainfall file, as far as they are used.
RAINFALL = ("temperature", "dew_point", "sea_level_pressure", "visibility", "average_wind_speed", "max_sustained_wind_speed", "minimum_temperature", "maximum_temperature", "rain")
FIRST_YEAR, YEARS = 2007, 15


def circle(spark: SparkSession, path: str) -> DataFrame:
    """var1, var2, y: the first three columns of a file without header."""
    return spark.read.schema("var1 double, var2 double, y double").csv(path)


def rainfall(spark: SparkSession, path: str) -> DataFrame:
    """The second to tenth column of a file with header, as numbers under the names in RAINFALL."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(n) for c, n in zip(raw.columns[1:10], RAINFALL, strict=True)))


def example_batches(spark: SparkSession, rows_per_year: int = 20_000, seed: int = 123) -> DataFrame:
    """row_idx, year, a to j, cat, confidence, drift: fifteen years; every value is a function of seed and row number.

    Planted: the mean of b in 2009; the variance of c and d in 2012 (every tenth, every second row near the mean); the correlation of e and f in 2015; h
    and confidence from 2019 on; j in 2021. drift marks 2009, 2012, 2015, 2018 and 2021.
    """
    at = F.col("row_idx")
    year = (F.lit(FIRST_YEAR) + F.floor(at / rows_per_year)).cast("long")
    base = spark.range(rows_per_year * YEARS).withColumnRenamed("id", "row_idx").withColumn("year", year)
    z = lambda name: normal(seed, F.lit(name), at)
    g = lambda name, shape: gamma(seed, shape, F.lit(name), at)
    u = lambda name: uniform(seed, F.lit(name), at)
    limits = (0.3, 0.6, 0.8, 0.9, 0.95, 0.99)
    cat = sum(((u("cat") >= x).cast("int") for x in limits), F.lit(0))
    is_year = lambda y: F.col("year") == y
    late = F.col("year") > 2018
    every = lambda n: is_year(2012) & (at % n == 0)
    e, f = z("e"), z("f")
    return base.select(
        "row_idx",
        "year",
        (g("a", 8) * 1000).alias("a"),
        F.when(is_year(2009), 500 + 10 * z("b")).otherwise(200 + 10 * z("b")).alias("b"),
        F.when(every(10), 7000 + 10 * z("c")).otherwise(g("c", 7) * 1000).alias("c"),
        F.when(every(2), 100_000 + 10 * z("d")).otherwise(g("d", 10) * 10_000).alias("d"),
        (e * 2**0.5).alias("e"),
        F.when(is_year(2015), e * 0.5**0.5 + f * 1.5**0.5).otherwise(f * 2**0.5).alias("f"),
        (g("g", 11) * 10_000).alias("g"),
        F.when(late, g("h", 1) * 1000).otherwise(g("h", 12) * 1000).alias("h"),
        (g("i", 9) * 1000).alias("i"),
        F.when(is_year(2021), g("j", 10) * 10).otherwise(g("j", 10) * 100).alias("j"),
        cat.cast("int").alias("cat"),
        F.when(late, 0.4 + 0.6 * u("confidence")).otherwise(0.6 * u("confidence")).alias("confidence"),
        F.col("year").isin(2009, 2012, 2015, 2018, 2021).alias("drift"),
    )
