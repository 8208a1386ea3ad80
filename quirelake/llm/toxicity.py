"""Toxicity by a factorisation machine over hashed terms.

Terms are lower-cased words and their beginnings, hashed. Terms in a few documents of the training sample get a weight and
a vector of factors; the products of the factors score pairs of terms, which a sum of single weights can't. Terms whose
presence doesn't differ between toxic and other documents learn in smaller steps, but they learn: a pair may tell what
neither of its terms does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices
from .learn import held_out, training_rows

#: Stripped from both ends of a word.
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_~`"
PREFIXES = (4, 5, 6)
#: Multiplier of the hash: a sum over bytes of (byte + 1) times its powers.
BASE = 0x9E3779B97F4A7C15
LOW = (1 << 32) - 1


class Terms:
    """The hashed terms of texts; with keep, those of keep alone, by their place in it."""

    def __init__(self, bits: int, keep: np.ndarray | None = None):
        self.bits, self.place = bits, None
        if keep is not None:
            self.place = np.full(1 << bits, -1)
            self.place[keep] = np.arange(len(keep))

    def of(self, texts: pa.Array, most: int = 1 << 20) -> list[np.ndarray]:
        """The distinct terms of each text, ascending; null has none. About most bytes of text are spread out at a time."""
        texts, at, out = texts.fill_null(""), 0, []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
            out += self._of_part(texts.slice(at, to - at))
            at = to
        return out

    def _of_part(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        pairs = distinct(text << 32 | words.indices.to_numpy())  # a text's words, then its terms
        terms = self.of_words(words.dictionary)[pairs & LOW]
        pairs = distinct((pairs[:, None] >> 32 << 32 | terms)[terms >= 0])
        return np.split(pairs & LOW, np.searchsorted(pairs, np.arange(1, len(texts)) << 32))

    def of_words(self, words: pa.Array) -> np.ndarray:
        """A row for each word: its own term and its beginnings', -1 where there is none."""
        bare = pc.ascii_lower(pc.ascii_trim(words, characters=EDGES))
        bare = bare.cast(pa.large_binary())
        begins = np.frombuffer(bare.buffers()[1], np.int64)[: len(bare) + 1]
        lens, begins, data = np.diff(begins), begins[:-1], np.frombuffer(bare.buffers()[2] or b"", np.uint8)[: begins[-1]]
        powers = np.cumprod(np.full(lens.max(initial=0), BASE, np.uint64), dtype=np.uint64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(begins, lens)], out=sums[1:])
        out = np.full((len(bare), 1 + len(PREFIXES)), -1)
        for i, n in enumerate((0, *PREFIXES)):
            has = lens > n
            begin, size = begins[has], n or lens[has]
            out[has, i] = mix(mix(sums[begin + size] - sums[begin]) + np.uint64(n)) >> np.uint64(64 - self.bits)
        return out if self.place is None else np.where(out < 0, -1, self.place[out])


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in ascending order, each once."""
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) != 0]


class FactorMachine:
    """bias + sum of weights + sum over pairs of <factors, factors>, through a sigmoid, on sets of terms."""

    def __init__(self, terms: np.ndarray, telling: np.ndarray, factors: int, seed: int, bits: int = 20):
        self.terms, self.telling, self.bias, self.bits = terms, telling, 0.0, bits
        self.w = np.zeros(len(terms))
        self.v = np.random.default_rng(seed).normal(0, 1, (len(terms), factors)) * np.where(telling, 0.05, 0.01)[:, None]

    def table(self) -> np.ndarray:
        """A row for each term: its factors, its weight, the sum of its squared factors."""
        return np.column_stack((self.v, self.w, squares(self.v)))

    def margin(self, rows: list[np.ndarray], table: np.ndarray | None = None) -> np.ndarray:
        """Of sets of terms, by their places; table() may be handed in, so that it is made once."""
        out, lens = np.full(len(rows), self.bias), np.array([len(x) for x in rows], np.int64)
        if lens.any():
            x = np.concatenate([np.asarray(x, np.int64) for x in rows])
            got = sums_from((self.table() if table is None else table)[x], (np.cumsum(lens) - lens)[lens > 0])
            out[lens > 0] += got[:, -2] + 0.5 * (squares(got[:, :-2]) - got[:, -1])
        return out

    def score(self, rows: list[np.ndarray], table: np.ndarray | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows, table), -30, 30)))

    def train(self, rows: list[np.ndarray], y: np.ndarray, *, epochs: int, rate: float, decay: float, seed: int) -> None:
        """AdaGrad on the log loss, batch by batch in a seeded order. Sums run over a batch's (row, term) entries, by row and by term; no matrix products, whose threads would spin on so little."""
        rng, size, factors = np.random.default_rng(seed), 64, self.v.shape[1]
        start, shrink = np.where(self.telling, 1e-6, 1.0), np.where(self.telling, decay, 10 * decay)  # other terms start with small steps: many are in a few rows only
        state, past, past_bias = np.column_stack((self.v, self.w)), np.repeat(start[:, None], factors + 1, axis=1), 1e-6
        step = rate * np.append(np.full(factors, 0.3), 1.0)
        rows, y = [np.asarray(x, np.int64) for x in rows], np.asarray(y, float)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), size):
                part = order[at : at + size]
                lens = np.array([len(rows[i]) for i in part])
                x, row = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), lens)
                by_term = np.argsort(x)
                first = np.flatnonzero(np.diff(x[by_term], prepend=-1))
                used, place = x[by_term[first]], np.empty(len(x), np.int64)  # only these terms' weights move
                place[by_term] = np.repeat(np.arange(len(used)), np.diff(first, append=len(x)))
                own = state.take(used, axis=0)
                got = np.zeros((len(part), factors + 2))
                got[lens > 0] = sums_from(np.column_stack((own, squares(own[:, :-1]))).take(place, axis=0), (np.cumsum(lens) - lens)[lens > 0])
                sums = got[:, :factors]
                margin = self.bias + got[:, factors] + 0.5 * (squares(sums) - got[:, -1])
                err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
                slope = sums_from(np.column_stack((err[:, None] * sums, err)).take(row[by_term], axis=0), first)
                slope[:, :-1] -= slope[:, -1:] * own[:, :-1]
                slope += shrink[used, None] * own
                seen = past.take(used, axis=0) + slope**2
                past[used] = seen
                state[used] = own - step * slope / np.sqrt(seen)
                past_bias += err.sum() ** 2
                self.bias -= rate * err.sum() / past_bias**0.5
        self.v, self.w = state[:, :-1].copy(), state[:, -1].copy()


def squares(values: np.ndarray) -> np.ndarray:
    """The sum of the squares of each row."""
    return np.einsum("ij,ij->i", values, values)


def sums_from(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the rows of values from each of begins to the next."""
    return np.add.reduceat(values, begins, axis=0) if len(begins) else values[:0]


def seen_terms(rows: list[np.ndarray], y: np.ndarray, bits: int, least: int, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms in at least least rows, and which of them tell by themselves: their share of the two classes differs by z standard errors or more."""
    counts = [np.bincount(np.concatenate([x for x, t in zip(rows, y, strict=True) if t == c] or [np.zeros(0, np.int64)]), minlength=1 << bits) for c in (0, 1)]
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    p = (counts[0] + counts[1]) / len(rows)
    gap = np.abs(counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
    seen = np.flatnonzero(counts[0] + counts[1] >= least)
    return seen, gap[seen] >= z


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, folds: int = 5, sample: int = 10_000, bits: int = 20, factors: int = 8, least: int = 3, z: float = 5.0, epochs: int = 40, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> FactorMachine:
    """Learns from at most sample labelled documents outside the held-out fold; their hashed terms (of texts of 96 MB at most) come to the driver. Without labels of both kinds the machine knows only a base rate."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, folds=folds, most=sample, seed=seed)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(terms.of(batch.column("t")), pa.list_(pa.int32()))], ["id", "y", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.select("id", rows.y.cast("int").alias("y"), "t").mapInArrow(hashed, f"id {kind}, y int, x array<int>").toArrow()
    got = got.sort_by("id")  # the same order in each run
    y = np.array(got.column("y").to_pylist(), np.int64)
    x = [v.values.to_numpy(zero_copy_only=False) for v in got.column("x")]
    keep, telling = seen_terms(x, y, bits, least, z) if len(y) else (np.zeros(0, np.int64), np.zeros(0, bool))
    place = np.full(1 << bits, -1)
    place[keep] = np.arange(len(keep))
    x = [(p := place[v])[p >= 0] for v in x]
    model = FactorMachine(keep, telling, factors, seed, bits)
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    model.bias = float(np.log(rate_1 / (1 - rate_1)))
    if 0 < y.sum() < len(y):
        model.train(x, y, epochs=epochs, rate=rate, decay=decay, seed=seed)
    return model


def score_toxicity(docs: DataFrame, model: FactorMachine, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, from the whole text alone; a null or empty text gets the bias' score. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        terms, factors = Terms(model.bits, model.terms), model.table()
        for batch in slices(batches, 64):
            scores = model.score(terms.of(batch.column("t")), factors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
