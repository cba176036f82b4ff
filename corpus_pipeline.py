"""From raw documents to shards: five stages, each written as Parquet and read again by the next.

Toxic documents go; of near-duplicates one stays; documents with passages of the benchmark go; the sources are mixed to their weights
along the curriculum; the rest is cut into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm import decontaminate, mixing, queries, sharding, simhash, toxicity
from driftlake.llm.shared import fresh, new_path

N_SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labelled documents in sf_dir, gives a score under 0.5."""
    (score,) = fresh(docs, "score")
    model = queries.toxicity_model(spark, sf_dir)
    return docs.withColumn(score, toxicity.toxicity(F.col("text"), model)).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by fingerprints of five-word shingles that agree in 0.8 of their bits."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"), least_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the sources' targets ask."""
    return mixing.curriculum(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard each is in and its slot there."""
    return sharding.with_shards(docs, N_SHARDS)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", cut_shards)]

#: The first two stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
