"""Tables and the document model on top of them.

A document is a row of ``documents``; its lines are its pages (page numbers from 1, blank pages keep theirs), its source
is its file name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text): null texts have one empty page."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.select("doc_id", F.posexplode(lines).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


def manifest_of(docs: DataFrame) -> DataFrame:
    """A manifest entry for each document: hash, sizes, index fields and times as functions of its row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.sha2(text, 256).alias("doc_hash"),
        F.col("source").alias("file_name"),
        F.size(F.split(text, "\n", -1)).alias("page_count"),
        F.when(F.col("doc_id") % 7 != 0, F.when(F.col("doc_id") % 5 == 0, "other").otherwise("base")).alias("embed_model"),
        F.when(F.col("doc_id") % 7 != 0, F.when(F.col("doc_id") % 11 == 0, 32).otherwise(64)).alias("embed_dim"),
        F.when(F.col("doc_id") % 7 != 0, F.ceil(F.length(text) / 2000)).otherwise(0).cast("long").alias("chunk_count"),
        F.length(text).cast("long").alias("byte_size"),
        (F.col("doc_id") * 37 % 1009).alias("last_accessed"),
    )


def summaries_of(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, content): the first line of every other document as its summary."""
    return docs.where("doc_id % 2 = 0").select("doc_id", F.lit("full").alias("kind"), F.split(F.coalesce("text", F.lit("")), "\n", -1)[0].alias("content"))
