"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .learn import held_out, training_rows

UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1-, 2- and 3-grams of letters of the lower-cased text, packed 21 bits a code point, and their counts.

    Everything but letters separates words; a boundary is code point 0 in 2- and 3-grams.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    codes = np.concatenate((np.zeros(1, np.uint64), codes, np.zeros(1, np.uint64)))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pairs = codes[:-1] << np.uint64(21) | codes[1:]
    triples = (pairs[:-1] << np.uint64(21) | codes[2:])[codes[1:-1] != 0]
    return np.unique(np.concatenate((codes[codes != 0], pairs, triples)), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent keys, ties by key."""
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    """Ranks of the profile n-grams of each language."""

    def __init__(self, grams: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(grams), size
        self.keys = np.unique(np.array([g for x in grams.values() for g in x], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.keys)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, np.array(grams[lang], np.uint64))] = np.arange(len(grams[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language (ties: first by name) and how much nearer it is than the next: 0.5 if no nearer, 1 if it matches exactly or is alone."""
        top = ranked(*gram_counts(text), self.size)
        if not len(top) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        ranks = np.where(self.keys[at] == top, self.ranks[:, at], -1)
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(away, kind="stable")
        first, second = (int(away[order[0]]), int(away[order[1]])) if len(order) > 1 else (0, 1)
        return self.langs[order[0]], second / (first + second) if first + second else 0.5


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 5, per_language: int = 1500, size: int = 300, seed: int = 11) -> Profiles:
    """Profiles from at most per_language documents of each language outside the held-out fold (whole texts)."""
    rows = training_rows(docs, None, id_col, text_col, lang_col, folds=folds, most=per_language, seed=seed, per_label=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of: dict[str, list] = {}
            for text, lang in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
                of.setdefault(lang, []).append(gram_counts(text))
            for lang, found in of.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(sums)], ["y", "gram", "n"])

    sums = rows.select("t", "y").mapInArrow(count, "y string, gram long, n long").groupBy("y", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    grams: dict[str, list[int]] = {}
    for r in best.orderBy("y", "rank").collect():  # size rows a language
        grams.setdefault(r.y, []).append(r.gram)
    return Profiles(grams, size)


def predict_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; ``und`` with score 0 if the text is null or has no letter (or nothing was learned).

    Only the text decides. Very long texts are read whole; repeated rows give repeated results; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.value.predict(t or "") for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
