"""From raw documents to training shards: five stages, each written as Parquet before the next reads it.

Each stage takes all documents that its predecessor kept and returns the columns of documents; the last adds
size, shard and slot. A document can leave the mix twice, when its source is asked for more than it has.
SQL can't express the first, the fourth and the fifth stage, so the pipeline is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairline.llm import decontaminate, mixing, near_dup, sharding, toxicity
from pairline.llm.common import cut, drop, table, temporary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not hold for toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir.

    What a stage wrote on its way is deleted once its result is written, and that once the next stage's is.
    """
    source = docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            after = cut(stage(spark, docs, sf_dir), name, lasting=True)
        if docs is not source:
            drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
