"""Restoring sessions and collections, provider answers, images, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: codes of connections that never came to be.
CONNECT_CODES = ("ECONNREFUSED", "ENOTFOUND", "EAI_AGAIN", "EHOSTUNREACH", "ENETUNREACH", "ETIMEDOUT")


def restore_messages(messages: DataFrame) -> DataFrame:
    """Messages of known roles that have content."""
    return messages.where(F.col("role").isin("user", "assistant") & F.col("content").isNotNull())


def restore_summaries(summaries: DataFrame, templates: DataFrame) -> DataFrame:
    """All summaries but those of templates (kind ``custom:id``) that no longer exist."""
    own = templates.where(T.trim(F.col("id")) != "").select(F.concat(F.lit("custom:"), "id").alias("kind")).distinct()
    custom = F.col("kind").startswith("custom:")
    return summaries.where(~custom).unionByName(summaries.where(custom).join(own, "kind", "left_semi"))


def restore_index(sessions: DataFrame, model: str, dim: int, version: int = 1) -> DataFrame:
    """with_index: whether a session's stored vectors can be used as they are."""
    ok = (F.col("schema_version") == version) & (F.col("embed_model") == model) & (F.col("embed_dim") == dim) & (F.col("n_vectors") == F.col("chunk_count")) & (F.col("chunk_count") > 0)
    return sessions.withColumn("with_index", F.coalesce(ok, F.lit(False)))


def open_collection(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per collection: members, those that can be opened, and whether only a part can."""
    known = manifest.select("doc_hash").distinct().withColumn("known", F.lit(1))
    got = members.join(known, "doc_hash", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("known").alias("n_open"))
    return got.withColumn("partial", (F.col("n_open") > 0) & (F.col("n_open") < F.col("n")))


def union_members(active: DataFrame, members: DataFrame) -> DataFrame:
    """The active document first, then the members, each once, in order (id, pos, doc_hash)."""
    first = active.select("id", F.lit(-1).cast("long").alias("pos"), "doc_hash")
    rows = first.unionByName(members.select("id", F.col("pos").cast("long").alias("pos"), "doc_hash")).groupBy("id", "doc_hash").agg(F.min("pos").alias("pos"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("pos", "doc_hash")) - 1)


def restore_order(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Vectors of an answer (request, index, vector) to the texts of its request (request, texts), by position; a missing one stays null."""
    asked = requests.select("request", F.posexplode("texts").alias("index", "text"))
    got = answers.groupBy("request", "index").agg(F.first("vector").alias("vector"))
    return asked.join(got, ["request", "index"], "left")


def accept_images(images: DataFrame, *, accepted: int = 50, examined: int = 400, per_page: int = 10, edge: int = 50, pixels: int = 4_000_000) -> DataFrame:
    """Images (doc_id, page, pos, width, height) that are examined and large (but not too large) enough, up to the limits per page and document."""
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    rows = images.withColumn("seen", F.row_number().over(order)).where(F.col("seen") <= examined)
    rows = rows.where((F.least("width", "height") >= edge) & (F.col("width") * F.col("height") <= pixels))
    rows = rows.withColumn("on_page", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos"))).where(F.col("on_page") <= per_page)
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= accepted).drop("seen", "on_page", "n")


def scaled(width: Column, height: Column, most: int = 1024) -> Column:
    """Size with the long edge at most most."""
    ratio = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.round(width * ratio).cast("int").alias("width"), F.round(height * ratio).cast("int").alias("height"))


def batch_of(position: Column, size: int = 50) -> Column:
    return F.floor(position / size)


def eta_ms(elapsed: Column, done: Column, total: Column) -> Column:
    """Time that the rest takes at the pace so far; null before anything is done."""
    return F.when(done > 0, F.round(elapsed / done * (total - done)))


def transport_error(code: Column) -> Column:
    """Whether a server couldn't be reached, or a stream broke off (any other code, or none)."""
    return F.when(code.isin(*CONNECT_CODES), "streamConnectFailed").otherwise("streamDisconnected")


def unsaved(rows: DataFrame) -> DataFrame:
    """unsaved: work that closing would lose."""
    return rows.withColumn("unsaved", F.col("generating") | F.col("indexing") | (F.col("has_summary") & ~F.col("saved")))
