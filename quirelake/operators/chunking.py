"""Chunking: greedy packing of paragraphs is a sequential fold, so each document is folded by an Arrow-batched function."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: characters that a tail may begin after.
BOUNDARY = frozenset(" \n\t.!?,。，！？、：；:")
GAP = re.compile(r"\n\n+")


def tail(text: str, size: int) -> str:
    """The last size characters, from a boundary in their second half if there is one before the very last."""
    if size <= 0 or not text:
        return ""
    if len(text) <= size:
        return text
    begin = len(text) - size
    for i in range(begin + size // 2, len(text) - 1):
        if text[i] in BOUNDARY:
            return text[i + 1 :]
    return text[begin:]


def whole_chunks(text: str, most: int) -> list[str]:
    """Paragraphs packed up to most characters, longer ones cut."""
    if len(text) <= most:
        return [text] if text.strip() else []
    out, now = [], ""
    for p in GAP.split(text):
        if now and len(now) + 2 + len(p) > most:
            out.append(now)
            now = p
        else:
            now = f"{now}\n\n{p}" if now else p
    packed = [c.strip() for c in [*out, now] if c.strip()]
    return [c[i : i + most] for c in packed for i in range(0, len(c), most)]


def packed(text: str, limit: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """(what is carried over, begin, end) of runs of paragraphs: each run takes all that fit limit, one at least.

    The paragraphs' ends ascend, so a run's last paragraph is found by bisection.
    """
    gaps = [g.span() for g in GAP.finditer(text)]
    begins, ends = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)]
    i, carried = 0, ""
    while i < len(begins):
        room = limit - (len(carried) + 2 if carried else 0)
        j = max(i + 1, bisect_right(ends, begins[i] + room))
        yield carried, begins[i], ends[j - 1]
        carried, i = tail(text[begins[i] : ends[j - 1]], overlap), j


def overlap_chunks(text: str, most: int, overlap: int) -> list[tuple[str, int, int]]:
    """(text, body begin, body end): chunks of most characters and a tail of the one before.

    A run longer than most and overlap together is cut into pieces; each gets its share of the run's span.
    """
    if len(text) <= most:
        return [(text, 0, len(text))] if text.strip() else []
    limit, out = most + overlap, []
    for carried, begin, end in packed(text, limit, overlap):
        full = "\n\n".join(x for x in (carried, text[begin:end]) if x or not carried).strip()
        n = -(-len(full) // limit)
        cut = [full[k * limit : (k + 1) * limit] for k in range(n)]
        at = [begin + k * (end - begin) // n for k in range(n)] + [end]
        out += [(tail(cut[k - 1], overlap) + cut[k] if k else cut[k], at[k], max(at[k + 1], at[k] + 1) if n > 1 else end) for k in range(n)]
    return out


def _budget(size: float, per_token: float, least: int) -> int:
    return max(least, math.floor(size * per_token))


# Types of a fold's columns in Spark and in Arrow.
COLUMNS = {"doc_id": ("long", pa.int64()), "chunk": ("int", pa.int32()), "text": ("string", pa.string()), "body_start": ("long", pa.int64()), "body_end": ("long", pa.int64()), "page_start": ("int", pa.int32()), "page_end": ("int", pa.int32())}


def _folded(docs: DataFrame, columns: tuple[str, ...], rows_of: Callable[..., Iterator[tuple]], most: int = 1 << 20) -> DataFrame:
    """docs (doc_id, text, ..), document by document -> columns, whose rows rows_of (of a document's values) gives.

    Only one document's text is a Python object at a time, and a batch is sent on when it has most characters: a task's
    memory doesn't grow with the number of documents.
    """
    schema = pa.schema([(c, COLUMNS[c][1]) for c in columns])
    at = columns.index("text")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                for row in rows_of(*(c[i].as_py() for c in batch.columns)):
                    rows.append(row)
                    size += len(row[at]) + 64
                    if size > most:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return docs.mapInArrow(fold, ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty), characters per token."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), T.chars_per_token(text).alias("cpt"), *more)


def chunk_documents(docs: DataFrame, size: int = 4000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, chunk, text: whole-document chunks of about size tokens."""

    def rows_of(doc: int, text: str, cpt: float) -> Iterator[tuple]:
        return ((doc, i, c) for i, c in enumerate(whole_chunks(text, _budget(size, cpt, 100))))

    return _folded(_measured(docs), ("doc_id", "chunk", "text"), rows_of)


def chunk_with_overlap(docs: DataFrame, size: int = 500, ratio: float = 0.1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, chunk, text, body_start, body_end."""

    def rows_of(doc: int, text: str, cpt: float) -> Iterator[tuple]:
        most = _budget(size, cpt, 200)
        return ((doc, i, *c) for i, c in enumerate(overlap_chunks(text, most, int(most * ratio))))

    return _folded(_measured(docs), ("doc_id", "chunk", "text", "body_start", "body_end"), rows_of)


def chunk_pages(pages: DataFrame, size: int = 500, ratio: float = 0.1) -> DataFrame:
    """pages (doc_id, page, text) -> chunks with page_start and page_end, by where their bodies lie.

    A document's page numbers and lengths go with its joined text, so that its fold finds the pages by bisection.
    """
    got = F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "text")))
    docs = pages.groupBy("doc_id").agg(got.alias("got"))
    docs = docs.select("doc_id", F.array_join(F.transform("got", lambda x: x["text"]), "\n\n").alias("text"), F.col("got.page").alias("pages"), F.transform("got", lambda x: F.coalesce(F.length(x["text"]) + 2, F.lit(0))).alias("lengths"))

    def rows_of(doc: int, text: str, cpt: float, numbers: list[int], lengths: list[int]) -> Iterator[tuple]:
        most = _budget(size, cpt, 200)
        begins = [0, *accumulate(lengths)][:-1]
        page = lambda at: numbers[bisect_right(begins, at) - 1]
        for i, (chunk, begin, end) in enumerate(overlap_chunks(text, most, int(most * ratio))):
            first = page(begin)
            yield doc, i, chunk, first, max(first, page(max(begin, end - 1)))

    return _folded(_measured(docs, "pages", "lengths"), ("doc_id", "chunk", "text", "page_start", "page_end"), rows_of)


def hash_embedding(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """A deterministic stand-in for an embedding model: signed hashed word counts, scaled to unit length."""

    def vectors(hashes: pa.Array) -> pa.Array:
        each = np.diff(hashes.offsets.to_numpy()) if not hashes.null_count else hashes.value_lengths().fill_null(0).to_numpy()
        h = hashes.flatten().to_numpy()
        rows = np.repeat(np.arange(len(hashes)), each)
        sign = np.where(h >> 62 & 1 == 0, 1.0, -1.0)
        v = np.bincount(rows * dim + h % dim, sign, len(hashes) * dim).astype(np.float64).reshape(-1, dim)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        unit = np.divide(v, n, out=np.zeros_like(v), where=n > 0).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dim, dtype=np.int32), unit.ravel())

    words = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != "")
    # not to be repeated where a filter names the vector
    return chunks.withColumn("embedding", F.arrow_udf(vectors, "array<float>").asNondeterministic()(F.transform(words, lambda w: F.xxhash64(w))))
