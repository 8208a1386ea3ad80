"""The session and collection store as tables: upserts, patches, merges, members and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH = "^[a-f0-9]{64}$"


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows replace old ones of their key; the first creation time stays."""
    first = old.select(key, F.col("created_at").alias("__first"))
    fresh = new.join(first, key, "left").withColumn("created_at", F.coalesce("__first", "created_at")).drop("__first")
    return old.join(new.select(key), key, "left_anti").unionByName(fresh)


def keep_index(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Index fields only where vectors are stored (or come with the row)."""
    have = stored.select(key).distinct().withColumn("__have", F.lit(True))
    rows = new.join(have, key, "left").withColumn("__ok", F.coalesce("__have", F.lit(False)) | F.coalesce("has_blob", F.lit(False)))
    none = lambda c: F.when(F.col("__ok"), F.col(c))
    return rows.withColumns({"embed_model": none("embed_model"), "embed_dim": none("embed_dim"), "chunk_count": F.coalesce(none("chunk_count"), F.lit(0))}).drop("__have", "__ok")


def merge_summaries(sessions: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """One kind of summary replaced, the others kept; blank contents and overlong kinds are refused (``merged`` tells)."""
    rows = sessions.join(delta.select(key, "kind", "content"), key, "left")
    ok = F.col("kind").isNotNull() & (F.length(F.trim(F.coalesce("content", F.lit("")))) > 0) & (F.length("kind") <= 71)
    others = F.map_filter("summaries", lambda k, v: k != F.col("kind"))
    return rows.withColumn("summaries", F.when(ok, F.map_concat(others, F.create_map("kind", "content"))).otherwise(F.col("summaries"))).withColumn("merged", F.coalesce(ok, F.lit(False))).drop("kind", "content")


def patch(sessions: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Patched sessions, and for each patch whether its session was there."""
    p = patches.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    rows = sessions.join(p, key, "left")
    done = rows.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])
    ok = patches.select(key).join(sessions.select(key).distinct().withColumn("ok", F.lit(True)), key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return done, ok


def touch(rows: DataFrame, match: Column, now: Column) -> DataFrame:
    return rows.withColumn("last_accessed", F.when(match, now).otherwise(F.col("last_accessed")))


def remove(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def normalize_entries(raw: DataFrame) -> DataFrame:
    """Manifest entries as read: wrong hashes go, texts are capped, bad numbers are 0, bad times the epoch."""
    number = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).try_cast("double")) & (F.abs(F.col(c).try_cast("double")) < float("inf")), F.col(c).try_cast("double")), F.lit(0.0)).cast("long")
    time = lambda c: F.coalesce(F.when(F.col(c).try_cast("timestamp").isNotNull(), F.col(c)), F.lit("1970-01-01T00:00:00.000Z"))
    rows = raw.where(F.col("doc_hash").rlike(HASH))
    return rows.select("doc_hash", F.substring("file_name", 1, 512).alias("file_name"), F.substring("file_path", 1, 4096).alias("file_path"), number("page_count").alias("page_count"), F.substring("embed_model", 1, 128).alias("embed_model"), number("byte_size").alias("byte_size"), time("created_at").alias("created_at"))


def unique_members(members: DataFrame, most: int = 50) -> DataFrame:
    """Members (id, pos, doc_hash) of collections: valid hashes, first of each, at most most."""
    first = members.where(F.col("doc_hash").rlike(HASH)).groupBy("id", "doc_hash").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return first.withColumn("pos", rank - 1).where(F.col("pos") < most)


def resolve_members(members: DataFrame, manifest: DataFrame, tabs: DataFrame, model: str, dim: int) -> DataFrame:
    """status and name of each member: from an open tab or the manifest, by its index."""
    open_ = tabs.groupBy("doc_hash").agg(F.min("file_name").alias("tab_name"))
    m = manifest.groupBy("doc_hash").agg(F.min(F.struct("doc_id", "file_name", "embed_model", "embed_dim", "chunk_count")).alias("m"))
    rows = members.join(m, "doc_hash", "left").join(open_, "doc_hash", "left")
    status = (
        F.when(F.col("m").isNull(), F.when(F.col("tab_name").isNotNull(), "no-index").otherwise("missing"))
        .when(F.coalesce("m.chunk_count", F.lit(0)) == 0, "no-index")
        .when((F.col("m.embed_model") != model) | (F.col("m.embed_dim") != dim), "model-mismatch")
        .otherwise("ready")
    )
    return rows.select(*[c for c in members.columns], F.coalesce("tab_name", "m.file_name", "doc_hash").alias("name"), F.when(F.col("tab_name").isNotNull(), "memory").otherwise("session").alias("source"), status.alias("status"))


def reconcile(manifest: DataFrame, folders: DataFrame) -> DataFrame:
    """What to do with each folder and entry: none, repair, leave, remove or register."""
    f = folders.where(F.col("doc_hash").rlike(HASH)).select("doc_hash", "readable", "body_hash", "has_blob")
    m = manifest.select("doc_hash", F.col("chunk_count").alias("claims"), F.lit(True).alias("known"))
    rows = m.join(f.withColumn("there", F.lit(True)), "doc_hash", "full")
    action = (
        F.when(F.col("there").isNull(), "none")
        .when(F.col("known").isNotNull(), F.when((F.col("claims") > 0) & ~F.col("has_blob"), "repair").otherwise("none"))
        .when(~F.col("readable"), "leave")
        .when(~F.col("body_hash").eqNullSafe(F.col("doc_hash")), "remove")
        .otherwise("register")
    )
    return rows.select("doc_hash", action.alias("action"))


def merge_tabs(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert of open tabs, field by field: a new null keeps the old value."""
    rest = [c for c in old.columns if c != key]
    rows = old.join(new.select(key, *[F.col(c).alias(f"__{c}") for c in rest]), key, "full")
    return rows.select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])


def persist_plan(rows: DataFrame) -> DataFrame:
    """How to save a session: skip, patch or full, and whether the stored index stays."""
    busy = ~F.col("flushing") & F.col("busy")
    mode = F.when(~F.col("enabled") | F.col("restoring") | busy, "skip").when(~F.col("index_changed") & F.col("summary_done"), "patch").otherwise("full")
    return rows.withColumns({"mode": mode, "keep_index": F.col("indexing") | F.col("failed") | (F.col("chunks") == 0)})


def cap_index(sessions: DataFrame, most: int = 64 << 20) -> DataFrame:
    """sessions (blob_bytes, embed_model, embed_dim, chunk_count, ..): an index larger than most bytes isn't stored, and nothing tells of one."""
    over = F.coalesce(F.col("blob_bytes") > most, F.lit(False))
    out = {c: F.when(~over, F.col(c)) for c in ("blob_bytes", "embed_model", "embed_dim")}
    return sessions.withColumns(out | {"chunk_count": F.when(over, 0).otherwise(F.col("chunk_count"))})


def stored_bytes(body: Column, blob_bytes: Column, meta: Column) -> Column:
    """What a session takes: its text, its vectors and their texts, in UTF-8."""
    return F.coalesce(F.octet_length(body), F.lit(0)) + F.coalesce(blob_bytes, F.lit(0)) + F.coalesce(F.octet_length(meta), F.lit(0))


def with_chunks(sessions: DataFrame, sidecars: DataFrame) -> DataFrame:
    """sessions (doc_hash, chunk_meta, ..) with the chunks of their sidecar (doc_hash, chunk_meta) where there is one, else their own (older files)."""
    side = sidecars.groupBy("doc_hash").agg(F.max("chunk_meta").alias("__side"))
    return sessions.join(side, "doc_hash", "left").withColumn("chunk_meta", F.coalesce("__side", "chunk_meta")).drop("__side")
