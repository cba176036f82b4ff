"""Lines that stand on many sites: HyperLogLog sketches for all, exact counts near the threshold. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.llm.shared import fresh, let, numbered, written

#: White space at the ends of a line, which does not count.
BLANK = " \t\r\x0b\x0c"
#: Lines with a boilerplate decision up to which their table (16 bytes a row) is broadcast.
BROADCAST_ROWS = 1_000_000


def _lines(df: DataFrame, text_col: str, least_chars: int, *others) -> DataFrame:
    """others, at, a, b for every line that counts; (a, b) is a hash of 128 bits of the line without white space at its ends."""
    cut = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    inside = df.select(*others, F.posexplode(cut).alias("at", "line")).withColumn("line", F.btrim("line", F.lit(BLANK)))
    return inside.where(F.char_length("line") >= least_chars).withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line")}).drop("line")


def spread_lines(df: DataFrame, site_col: str = "source", text_col: str = "text", least_sites: int = 5, least_chars: int = 1, margin: float = 0.25, log_k: int = 12) -> DataFrame:
    """(a, b), hashes of the lines that stand on at least least_sites distinct sites; rows without a site count for none.

    One sketch of sites per line merges by aggregation, first in every partition. An estimate within margin of the threshold is not trusted:
    those lines, and only those, are counted exactly by distinct (line, site).
    """
    lines = _lines(df, text_col, least_chars, F.xxhash64(F.col(site_col)).alias("site"), F.col(site_col).isNotNull().alias("named")).where("named")
    sketches = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(log_k)).alias("sketch"))
    estimates = sketches.select("a", "b", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= least_sites * (1 - margin))
    some, _ = written(estimates, "spread")
    near = some.where(F.col("n") <= least_sites * (1 + margin)).select("a", "b")
    side = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    exact = lines.join(side, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
    sure = some.where(F.col("n") > least_sites * (1 + margin))
    return sure.select("a", "b").union(exact.where(F.col("n") >= least_sites).select("a", "b"))


def _left(lines: Column, gone: Column) -> Column:
    """lines, joined, but for those at the places gone: the gaps between sorted places, so long texts take linear time."""

    def gaps(g):
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(g, i - 1) + 1)
        end = lambda i, n: F.coalesce(F.get(g, i), n)
        between = lambda x: F.transform(F.sequence(F.lit(0), F.size(g)), lambda i: F.slice(x, start(i) + 1, end(i, F.size(x)) - start(i)))
        return let(lines, lambda x: F.array_join(F.flatten(between(x)), "\n"))

    return let(F.array_sort(gone), gaps)


def without_spread_lines(df: DataFrame, site_col: str = "source", text_col: str = "text", least_sites: int = 5, least_chars: int = 1, **kwargs) -> tuple[DataFrame, str, str]:
    """df, all columns, with the text that is left and the numbers of lines before and removed; and the names of these two columns.

    Lines end at line feeds; a line of fewer than least_chars characters (white space at its ends aside) always stays. The other lines keep their order.
    Null texts stay null and have no lines. Only places of removed lines are gathered per document, and they are no more than its lines.
    """
    row, number, gone, n, removed = fresh(df, "row", "number", "gone", "n_lines", "n_removed")
    marked = numbered(df, row)
    bad, _ = written(spread_lines(df, site_col, text_col, least_sites, least_chars, **kwargs), "boilerplate")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    hit = _lines(marked, text_col, least_chars, F.col(row).alias("row")).join(side, ["a", "b"])
    places = hit.groupBy("row").agg(F.collect_set("at").alias(gone)).withColumnRenamed("row", number)
    joined = marked.join(places, F.col(row) == F.col(number), "left")
    cut = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_left(cut, F.col(gone)))
    counted = joined.withColumns({n: F.coalesce(F.size(F.when(F.col(text_col).isNotNull(), cut)), F.lit(0)).cast("long"), removed: F.coalesce(F.size(gone), F.lit(0)).cast("long"), text_col: kept})
    return counted.select(*df.columns, n, removed), n, removed
