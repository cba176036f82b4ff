"""Contiguous shards of equal bytes from global prefix sums. Column expressions and joins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.shared import any_of, fresh, numbered, prefix_sums


def shards(df: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.02, keep: Sequence[str] = ()) -> DataFrame:
    """id, size, crc, shard (0 to n - 1), slot (gapless from 0 in each shard) and keep, for every row.

    Size is the bytes of the text in UTF-8 (null: none) and 1. Rows are put in the order of (hash of the text, id), so that equal texts stand
    together; prefix sums of size are cut at n equal targets, so every shard is one stretch of the order, and its bytes are within one
    text of the target. A group of equal texts across a cut goes to the shard in which it begins if it has no more than slack of a target;
    larger ones are split. Per-partition totals carry the sums over; only the total and the groups at the n - 1 cuts come to the driver.
    Repeated rows keep their copies; which of two equal rows has which slot is open.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.md5(text.cast("binary")).alias("group"), F.lit(1).cast("long").alias("one"), *keep)
    split = F.xxhash64(F.lit(1), "id", *keep).alias("salt")  # rows that are equal in all the rest can still be told apart by keep
    placed, _ = prefix_sums(slim.select("*", split), ["group", "id", "salt"], {"size": "start", "one": "nth"})
    total = slim.sparkSession.read.parquet(_).agg(F.sum("size")).first()[0] or 0
    own = F.least(F.floor(F.col("start") * n / F.lit(max(1, total))).cast("int"), F.lit(n - 1))
    end = F.col("start") + F.col("size")
    cuts = sorted({j * total // n for j in range(1, n)})
    shard = own
    if cuts:
        at = placed.where(any_of([(F.col("start") <= c) & (end >= c) for c in cuts])).select("group").distinct()
        groups = placed.join(F.broadcast(at), "group", "left_semi").groupBy("group").agg(F.min("start").alias("first"), F.sum("size").alias("all"))
        for g in groups.where(F.col("all") <= slack * total / n).collect():  # two for each cut at most
            shard = F.when(F.col("group") == g["group"], F.lit(min(g["first"] * n // total, n - 1))).otherwise(shard)
    dealt = placed.withColumn("shard", shard)
    first = dealt.groupBy("shard").agg(F.min("nth").alias("before"))
    return dealt.join(F.broadcast(first), "shard").select("id", "size", "crc", "shard", (F.col("nth") - F.col("before")).alias("slot"), *keep)


def with_shards(df: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """df, all columns, with shard and slot (longer names where it has these)."""
    row, number, shard, slot = fresh(df, "row", "number", "shard", "slot")
    marked = numbered(df, row)
    dealt = shards(marked, n, id_col, text_col, keep=[row], **kwargs).select(F.col(row).alias(number), F.col("shard").alias(shard), F.col("slot").alias(slot))
    return marked.join(dealt, F.col(row) == F.col(number)).select(*df.columns, shard, slot)
