"""A training corpus from raw documents: quality, exact and near copies, benchmark leaks, and the mix of sources.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm.common import materialize
from quirelake.llm.decontaminate import drop_leaks
from quirelake.llm.exact_dedup import drop_copies
from quirelake.llm.jaccard_join import drop_near_copies
from quirelake.llm.mixing import mix_sources
from quirelake.llm.quality import drop_rejected, learn_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the field finds good enough."""
    return drop_rejected(docs, learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity connects."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's template."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often."""
    return mix_sources(docs).where("copies > 0")


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL can't express the trained field, the randomised join and the subset sums; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
