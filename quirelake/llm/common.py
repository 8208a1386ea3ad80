"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 pattern of the ASCII blanks that separate words.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Only where the setting is missing and the master is local (tests) a temporary folder stands in.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(scratch, "local", None) or tempfile.mkdtemp(prefix="quirelake-")
        scratch.local = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again: lineage ends here."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, row_bytes: int, limit: int) -> DataFrame:
    """df (a written table), marked for broadcast if its counted rows take at most limit bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str, mark: Column, mark_bytes: int, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """docs without the rows that found (id, mark, kept: a row each, written) doesn't keep; all columns stay.

    A row is told by its id and mark, a hash of its text. Of rows that agree in both as many as are kept stay or, if only
    some are kept, one, whichever. Ids that go are broadcast up to broadcast_bytes, beyond it the join is shuffled.
    """
    keys = found.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.max("kept").alias("kept"), F.min("kept").alias("all"))
    size = 40 + mark_bytes
    gone = small_enough(materialize(keys.where("not kept").select("__id", "__mark"), "gone"), size, broadcast_bytes)
    some = materialize(keys.where("kept and not all").select("__id", "__mark"), "some")
    same = F.col("__mark").eqNullSafe(mark) & F.col("__id").eqNullSafe(F.col(id_col))
    left = docs.join(gone, same, "left_anti")
    if some.isEmpty():
        return left
    some = small_enough(some, size, broadcast_bytes)
    one = left.join(some, same, "left_semi").withColumn("__mark", mark).dropDuplicates([id_col, "__mark"]).drop("__mark")
    return left.join(some, same, "left_anti").unionByName(one)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def bucket_of(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered; forgets all when it holds too many."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of uint64 values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values of h; empty if there are fewer."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


_B, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    up, down = (np.full(1 << bits, x, np.uint64) for x in (_B, _INVERSE))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values of h, which are hashes themselves, at a cost that doesn't grow with n."""
    if len(h) < n:
        return h[:0]
    up, down = _powers(max(10, (len(h)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
