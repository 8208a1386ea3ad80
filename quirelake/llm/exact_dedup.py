"""Exact dedup by a Golomb-coded fingerprint exchange.

Senders (groups of input rows) sort the fingerprints of their normalised texts and send each owner of a hash range
its part, Rice-coded. The owner decodes all lists and answers each sender with a bitmap of those that others sent too.
Only rows with a marked fingerprint (suspects) have their texts shuffled, where they are compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, keep_rows, materialize, small_enough, text_of


def rice_encode(values: np.ndarray) -> bytes:
    """Ascending, distinct uint64 values as a Rice code: parameter, count, unary quotients, then remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(math.log2(max(1, int(values[-1]) // n))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([k, n, len(unary)], np.int64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    k, n, bits = (int(x) for x in np.frombuffer(data, np.int64, 3))
    cut = 24 + (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data[24:cut], np.uint8), count=bits))
    high = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(data[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    low = (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def _split(fps: np.ndarray, owners: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ascending fingerprints, how often each occurs, and where each owner's part begins (one more at the end)."""
    distinct, counts = np.unique(fps.astype(np.uint64), return_counts=True)
    width = (1 << bits) // owners + 1
    return distinct, counts, np.searchsorted(distinct, np.arange(owners + 1, dtype=np.uint64) * np.uint64(width))


def mark_suspects(fps: DataFrame, owners: int, bits: int) -> DataFrame:
    """fps (sender, fp) -> the distinct fp that occur in two rows or more (and none else)."""

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        distinct, _, cuts = _split(pdf.fp.to_numpy(), owners, bits)
        own = np.flatnonzero(np.diff(cuts))
        width = np.uint64((1 << bits) // owners + 1)
        return pd.DataFrame({"sender": pdf.sender.iloc[0], "owner": own, "codes": [rice_encode(distinct[cuts[o] : cuts[o + 1]] - np.uint64(o) * width) for o in own]})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [rice_decode(x) for x in pdf.codes]
        distinct, counts = np.unique(np.concatenate(lists), return_counts=True)
        shared = distinct[counts > 1]
        hits = []
        for x in lists:
            at = np.searchsorted(shared, x)
            hit = np.zeros(len(x), bool)
            inside = at < len(shared)
            hit[inside] = shared[at[inside]] == x[inside]
            hits.append(np.packbits(hit).tobytes())
        return pd.DataFrame({"sender": pdf.sender, "owner": pdf.owner, "bitmap": hits})

    def receive(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        distinct, counts, cuts = _split(rows.fp.to_numpy(), owners, bits)
        hit = counts > 1
        for o, bitmap in zip(answers.owner, answers.bitmap, strict=True):
            n = cuts[o + 1] - cuts[o]
            hit[cuts[o] : cuts[o + 1]] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
        return pd.DataFrame({"fp": distinct[hit].astype(np.int64)})

    codes = fps.groupBy("sender").applyInPandas(send, "sender long, owner int, codes binary")
    bitmaps = codes.groupBy("owner").applyInPandas(answer, "sender long, owner int, bitmap binary")
    marked = fps.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(receive, "fp long")
    return marked.distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fp_bits: int = 48, unit: int = 500_000, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once ASCII blanks are deleted; a null text is empty, and empty texts form a group.
    Of a group the row with the most code points in its original text stays, then the smallest id (a null id comes
    last); of repeated rows with that id exactly one has kept = true. Other columns are ignored. An empty table gives none.

    fp_bits: bits of a fingerprint (more false suspects if fewer; results are the same). unit: rows for a sender or an
    owner of a hash range, which bounds memory. broadcast_bytes: the suspects' fingerprints are broadcast up to that
    size, beyond it the join is shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    norm, fp = F.regexp_replace("t", BLANKS, ""), F.shiftrightunsigned(F.xxhash64("norm"), 64 - fp_bits)
    light = rows.select("doc_id", F.length("t").alias("n_cp"), norm.alias("norm")).select(
        "doc_id", "n_cp", fp.alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("rid")
    )
    light = materialize(light, "dedup-rows")
    parts = max(8, math.ceil(light.count() / unit))
    fps = light.select(F.pmod(F.xxhash64(F.shiftright("rid", 13)), F.lit(parts)).alias("sender"), "fp")
    marked = materialize(mark_suspects(fps, parts, fp_bits), "dedup-marked")
    marked = small_enough(marked, 32, broadcast_bytes)
    texts = rows.select(norm.alias("norm")).withColumn("fp", fp).join(marked, "fp", "left_semi")
    equal = texts.groupBy("norm").agg(F.count("*").alias("n")).where("n > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
    equal = materialize(equal, "dedup-equal")  # written, so that joins with it are plain ones, whose large keys Spark splits
    best = F.min(F.struct((-F.col("n_cp")).alias("c"), F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("id"), "rid"))
    stays = light.join(small_enough(equal, 48, broadcast_bytes), "sha", "left_semi").groupBy("sha").agg(best.alias("best"))
    groups = materialize(equal.join(stays, "sha").select("sha", "n", "best"), "dedup-groups")
    out = light.join(small_enough(groups, 96, broadcast_bytes), "sha", "left")
    single = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("best.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that ``exact_dedup`` doesn't keep; all columns stay. Of repeated rows (same id, equal text) one stays."""
    found = exact_dedup(docs, id_col, text_col).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("mark"), "kept")
    return keep_rows(docs, materialize(found, "dedup-found"), id_col, F.unhex(F.sha2(F.regexp_replace(text_of(text_col), BLANKS, ""), 256)), 32)
