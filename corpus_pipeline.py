"""A corpus in five stages: quality, near copies, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All but the last return
the columns they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import op1_jaccard, op3_mix, op6_shard, op8_quality, op9_decontaminate
from pixelweave.session import checkpoint_folder

ORACLE_SQL = None      # the quality ranking is a trained model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    return op8_quality.good_only(docs, op8_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return op1_jaccard.one_of_each(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return op9_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return op3_mix.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return op6_shard.shard(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", decontaminated), ("mixing sources", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/corpus/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
