"""Vector and keyword search: similarity, thresholds, two-phase top-k, document scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V


def similar(chunks: DataFrame, query: DataFrame, *, vec: str = "embedding", least: float = 0.3) -> DataFrame:
    """chunks with their score against a query of one row (column q); other dimensions and non-finite scores drop out.

    query holds one vector, so it is broadcast; the scan of chunks stays narrow.
    """
    one = F.broadcast(query.select("q").limit(1))
    scored = chunks.join(one, F.size(vec) == F.size("q")).withColumn("score", V.dot(F.col(vec), F.col("q"))).drop("q")
    return scored.where((F.col("score") >= least) & ~F.isnan("score"))


def top_each(scored: DataFrame, by: str, k: int, *tie: str) -> DataFrame:
    """The k best rows of each group; Spark keeps k per task before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(scored: DataFrame, k: int, *tie: str | Column) -> DataFrame:
    return scored.orderBy(F.desc("score"), *tie).limit(k)


def best(scored: DataFrame, key: str) -> DataFrame:
    """The single best row's key and score; ties by key."""
    order = F.struct("score", -F.col(key))
    return scored.agg(F.max_by(key, order).alias(key), F.max("score").alias("score"))


def index_state(manifest: DataFrame, model: str, dim: int) -> DataFrame:
    """state of each document's index: missing, mismatch (counted as excluded) or ready."""
    none = F.col("embed_model").isNull() | (F.coalesce("chunk_count", F.lit(0)) == 0)
    same = (F.col("embed_model") == model) & (F.col("embed_dim") == dim)
    return manifest.withColumn("state", F.when(none, "missing").when(same, "ready").otherwise("mismatch"))


def keyword_scores(pages: DataFrame, docs: DataFrame, summaries: DataFrame, query: str, *, snippets: int = 3, radius: int = 50) -> DataFrame:
    """Keyword score of each document that has one: 5 for its name, its pages' occurrences, 2 for each summary.

    pages (doc_id, page, text), docs (doc_id, file_name), summaries (doc_id, kind, content). snippets: (page, text) of the
    first matching pages, or of the first matching summary as page 0. A query under two characters finds nothing.
    """
    q = query.strip().lower()
    if len(q) < 2:
        q = "\0"
    needle, low = F.lit(q), F.lower("text")
    at = lambda c: F.instr(F.lower(c), q) - 1
    hits = pages.withColumn("occ", T.occurrences(low, needle)).where("occ > 0")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    made = F.when(F.col("r") <= snippets, F.struct("page", T.snippet(F.col("text"), at(F.col("text")), F.lit(len(q)), radius).alias("text")))
    by_page = hits.withColumn("r", rank).groupBy("doc_id").agg(F.sum("occ").alias("occ"), F.array_sort(F.collect_list(made)).alias("found"))
    told = summaries.where(F.instr(F.lower("content"), q) > 0)
    first = F.min(F.struct("kind", T.snippet(F.col("content"), at(F.col("content")), F.lit(len(q)), radius).alias("s")))
    by_summary = told.groupBy("doc_id").agg(F.count("*").alias("told"), first.alias("first"))
    out = docs.join(by_page, "doc_id", "left").join(by_summary, "doc_id", "left")
    score = 5 * F.when(F.instr(F.lower("file_name"), q) > 0, 1).otherwise(0) + F.coalesce("occ", F.lit(0)) + 2 * F.coalesce("told", F.lit(0))
    page0 = F.when(F.col("told").isNotNull(), F.array(F.struct(F.lit(0).alias("page"), F.col("first.s").alias("text"))))
    out = out.withColumns({"score": score.cast("long"), "in_summary": F.col("told").isNotNull(), "snippets": F.coalesce("found", page0)})
    return out.where("score > 0").select("doc_id", "file_name", "score", "in_summary", "snippets")


def chunk_keyword_scores(chunks: DataFrame, words: Column, text: str = "text") -> DataFrame:
    """score: occurrences of all keywords (an array; a repeated one counts again) in the chunk without its citations.

    ASCII keywords are whole words: one pattern finds all of them in one pass. Other keywords are counted one by one, if
    they occur at all. The score stands in a generator, below which Spark moves no filter: there it would be computed again.
    """
    ascii_ = "^[a-z0-9]+$"
    whole, parts = (lambda w: F.filter(w, lambda x: x.rlike(ascii_))), (lambda w: F.filter(w, lambda x: ~x.rlike(ascii_)))
    pattern = lambda w: F.concat(F.lit("(?<![a-z0-9_])(?:"), F.array_join(F.array_distinct(w), "|"), F.lit(")(?![a-z0-9_])"))
    kinds = T.once(T.once(words, lambda w: F.struct(whole(w).alias("whole"), parts(w).alias("parts"))), lambda k: F.struct(k["whole"], k["parts"], pattern(k["whole"]).alias("pattern")))
    zero = F.lit(0).cast("long")

    def count(s: Column) -> Column:
        low, k = s["low"], s["kinds"]
        found = F.when(F.size(k["whole"]) > 0, F.regexp_extract_all(low, k["pattern"], F.lit(0)))
        hits = F.aggregate(F.coalesce(found, F.array().cast("array<string>")), zero, lambda a, t: a + F.size(F.filter(k["whole"], lambda w: w == t)))
        return hits + F.aggregate(k["parts"], zero, lambda a, w: a + F.when(F.contains(low, w), T.occurrences(low, w)).otherwise(zero))

    score = T.once(F.struct(F.lower(T.strip_citations(F.col(text))).alias("low"), kinds.alias("kinds")), count)
    return chunks.drop("score").select("*", F.explode(F.array(score)).alias("score"))


def best_scores(queries: pa.Table, chunks: pa.Table, rows: int = 2048) -> np.ndarray:
    """The best score of each query (column vec) over chunks (column vec); -inf where none has its dimension.

    Vectors of each dimension meet as matrix products, rows by rows. Products of single precision rule out the slices that
    can't hold a query's best, by a bound of their error; the rest is computed in double precision. A product with a null
    or a value that is no number counts as 1, as in ``vector.dot``.
    """
    best = np.full(queries.num_rows, -np.inf)
    (qd, q), (cd, c) = _by_dimension(queries["vec"]), _by_dimension(chunks["vec"])
    for dim in sorted(set(qd) & set(cd)):
        qs, cs = q(dim), c(dim)
        parts = [cs[j : j + rows] for j in range(0, len(cs), rows)]
        with np.errstate(invalid="ignore", over="ignore"):
            qn, cn = _norms(qs), [_norms(b).max() for b in parts]
            single = qs.dtype == cs.dtype == np.float32 and dim * qn.max() * np.max(cn) < 1e3  # false for a value that is no number
        for i in range(0, len(qs), rows):
            at, a = qd[dim][i : i + rows], qs[i : i + rows]
            if single:
                wrong = [(dim + 2) * 2.0**-23 * qn[i : i + rows] * n + 1e-30 for n in cn]
                tops = [(a @ b.T).max(axis=1) for b in parts]
                least = np.max([t - w for t, w in zip(tops, wrong, strict=True)], axis=0)
                open_ = [np.flatnonzero(t + w >= least) for t, w in zip(tops, wrong, strict=True)]
            else:
                open_ = [np.arange(len(a))] * len(parts)
            for b, o in zip(parts, open_, strict=True):
                with np.errstate(invalid="ignore", over="ignore"):
                    s = a[o].astype(np.float64) @ b.astype(np.float64).T
                top = s.max(axis=1)  # not a number if one product is none
                if np.isnan(top).any():
                    top = np.where(np.isnan(s), 1.0, s).max(axis=1)
                best[at[o]] = np.maximum(best[at[o]], np.clip(top, -1.0, 1.0))
    return best


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))


def _by_dimension(vectors: pa.ChunkedArray) -> tuple[dict[int, np.ndarray], Callable[[int], np.ndarray]]:
    """The places of the vectors of each dimension, and a function that gives these as a matrix."""
    v = vectors.combine_chunks()
    v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
    size = v.value_lengths().fill_null(-1).to_numpy()
    places = {int(d): np.flatnonzero(size == d) for d in np.unique(size) if d >= 0}
    return places, lambda d: v.take(pa.array(places[d])).flatten().to_numpy(zero_copy_only=False).reshape(len(places[d]), d)


def verify(sentences: DataFrame, chunks: DataFrame, *, keys: tuple[str, ...], most: int = 32_768) -> DataFrame:
    """support of each sentence (keys, embedding): its best score over all chunks (embedding), 0 at least.

    Every pair is compared, exactly. Both sides are dealt, by hashes of all their columns, into blocks of about most rows;
    each block of sentences meets each block of chunks as matrix products in slices, and partial maxima meet after it. The
    pairs of blocks are dealt to as many tasks, which adaptive execution doesn't merge, as their work is not in their bytes.
    A task's memory is that of two blocks; the number of tasks grows as the pairs do.
    """
    s = sentences.select(*keys, F.col("embedding").alias("vec"))
    n_s, n_c = (max(1, math.ceil(n / most)) for n in (s.count(), chunks.count()))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = s.withColumn("sb", F.pmod(F.xxhash64(*keys), F.lit(n_s)).cast("int")).select("*", each(n_c).alias("cb"))
    right = chunks.select(F.pmod(F.xxhash64(*chunks.columns), F.lit(n_c)).cast("int").alias("cb"), F.col("embedding").alias("vec")).select("*", each(n_s).alias("sb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = best_scores(a, b) if a.num_rows and b.num_rows else np.full(a.num_rows, -np.inf)
        return a.select(list(keys)).append_column("m", pa.array(found, pa.float64()))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema if f.name in keys)
    dealt = lambda x: x.repartition(n_s * n_c, "sb", "cb").groupBy("sb", "cb")
    met = dealt(left).cogroup(dealt(right)).applyInArrow(meet, f"{types}, m double")
    best = met.groupBy(*keys).agg(F.max("m").alias("m"))
    return sentences.select(*keys).join(best, list(keys), "left").select(*keys, F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0))).alias("support"))


def verdict(support: DataFrame, by: str, *, weak: float = 0.5, mean: float = 0.65) -> DataFrame:
    """Per answer: sentences, weak ones, average support and whether to refine."""
    out = support.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("support") < weak, 1).otherwise(0)).alias("n_weak"), F.avg("support").alias("average"))
    return out.withColumn("refine", (F.col("n_weak") >= 2) | (F.col("n_weak") / F.col("n") > 0.2) | (F.col("average") < mean))
