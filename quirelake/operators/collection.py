"""Questions to a collection: which members are searched, what they hold, and whether the answer lacks some."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import top_each

# Members searched at a time, hits of a member and of a collection, the least score.
MOST_MEMBERS, PER_MEMBER, PER_COLLECTION, LEAST = 20, 5, 8, 0.3


def effective_members(members: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """members (id, pos, doc_hash, status, active) -> the ready ones that are searched, with truncated: whether others are ready too.

    The active document always counts; the others follow in order up to the limit.
    """
    ready = members.where("status = 'ready'")
    w = Window.partitionBy("id")
    rank = F.row_number().over(w.orderBy(F.desc(F.coalesce("active", F.lit(False))), "pos"))
    out = ready.withColumns({"rank": rank, "truncated": F.count("*").over(w) > most})
    return out.where(F.col("rank") <= most).drop("rank")


def collection_hits(members: DataFrame, index: DataFrame, questions: DataFrame, *, least: float = LEAST, per_member: int = PER_MEMBER, most: int = PER_COLLECTION) -> DataFrame:
    """members (of ``effective_members``, with file_name), index (doc_hash, chunk, text, page_start, embedding), questions (id, q) -> each collection's best chunks, with rank.

    The best of each member meet, and the best of these stay; ties go by document, then chunk. Vectors of another length
    than the question's find nothing.
    """
    from ..functions import vector as V

    found = index.join(members.select("id", "doc_hash", "file_name"), "doc_hash").join(questions.select("id", "q"), "id")
    found = found.where(F.size("embedding") == F.size("q")).withColumn("score", V.dot(F.col("embedding"), F.col("q")))
    found = found.where((F.col("score") >= least) & ~F.isnan("score")).drop("q", "embedding").withColumn("member", F.struct("id", "doc_hash"))
    best = top_each(found, "member", per_member, "chunk").drop("rank", "member")
    return top_each(best, "id", most, "doc_hash", "chunk")


def collection_state(members: DataFrame, index: DataFrame) -> DataFrame:
    """Per collection, over its searched members: size (vectors), dim (the first member's that has one), loaded (members with vectors), and degraded.

    An answer is degraded if fewer than two members, or fewer than are ready, have vectors, or if members were left out.
    """
    held = index.where(F.size("embedding") > 0).groupBy("doc_hash").agg(F.count("*").alias("n"), F.min_by(F.size("embedding"), "chunk").alias("d"))
    rows = members.join(held, "doc_hash", "left")
    out = rows.groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.min_by("d", F.when(F.col("d").isNotNull(), F.col("pos"))).alias("dim"), F.count("n").alias("loaded"), F.count("*").alias("expected"), F.max("truncated").alias("truncated"))
    return out.withColumn("degraded", (F.col("loaded") < 2) | (F.col("loaded") < F.col("expected")) | F.col("truncated"))
