"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own and its neighbours' features; length-weighted forward-backward marginals
give the document's quality, which a logistic curve turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mix, slices, text_of
from .learn import held_out, training_rows

# Classes of bytes: 0 other, 1 blank, 2 lower-case letter, 3 capital, 4 digit, 5 stop or comma, 6 other sign, 7 bar, 8 byte of a longer character.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 6
CLASS[[9, 10, 11, 12, 13, 32]] = 1
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 2, 3, 4
CLASS[[ord(c) for c in ".,;:!?'\"-"]] = 5
CLASS[ord("|")] = 7
CLASS[128:] = 8
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
N_FEATURES = 14


def line_features(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank lines of all texts: features (lines x N_FEATURES), bytes, and the text each is of. About most bytes of text are spread out at a time."""
    found, at = [], 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= most:
            size += len(texts[stop])
            stop += 1
        x, n, owner = _line_features(texts[at:stop])
        found.append((x, n, owner + at))
        at = stop
    if not found:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, "right")
    kinds = CLASS[data]
    blank = kinds == 1
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    stops = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    line = np.searchsorted(ends, starts)
    n_words = np.bincount(line, minlength=len(ends))
    own = np.flatnonzero(n_words)  # the other lines are blank
    n = n_words[own].astype(float)
    sums = lambda mask: np.add.reduceat(mask.astype(np.int32), begins)[own].astype(float)
    size = np.maximum(1.0, sums(~blank))
    share = [sums(kinds == k) / size for k in (3, 4, 5, 6, 7, 8)]
    # a word's hash: its bytes weighed by their places, so that equal words are equal
    place = np.arange(len(data), dtype=np.int64)
    word = np.cumsum(np.bincount(starts, minlength=len(data)).astype(np.int64)) - 1
    weigh = mix((place - starts[np.maximum(word, 0)]).astype(np.uint64) + np.uint64(77)) | np.uint64(1)
    sums64 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(blank, np.uint64(0), BYTE[data] * weigh), dtype=np.uint64)))
    words = sums64[stops] - sums64[starts]
    again = np.concatenate(([False], (words[1:] == words[:-1]) & (line[1:] == line[:-1])))
    signs = np.concatenate(([0], np.cumsum((kinds == 6) | (kinds == 7))))
    signed = signs[stops] > signs[starts]
    order = np.lexsort((words, line))
    fresh = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (line[order][1:] != line[order][:-1])))
    distinct = np.bincount(line[order], fresh, len(ends))[own] / n
    length = (stops - starts).astype(float)
    mean = np.bincount(line, length, len(ends))[own] / n
    closes = kinds[stops[np.searchsorted(line, own, "right") - 1] - 1] == 5
    cols = [*share, np.bincount(line, again, len(ends))[own] / n, np.bincount(line, signed, len(ends))[own] / n, 1 - distinct, np.log1p(mean), np.log1p(n), np.log1p(np.bincount(line, length**2, len(ends))[own] / n - mean**2 + 1e-9), closes.astype(float), (n < 4).astype(float)]
    return np.stack(cols, axis=1).astype(np.float32), (ends - begins)[own], owner[own]


def with_neighbours(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Features of the line, the line before and the line after (zeros beyond the text), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (owner[1:] == owner[:-1])[:, None]
    before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate((x, before, after, np.ones((len(x), 1), x.dtype)), axis=1)


def chains(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chain (a text's lines) begins, and its length."""
    if not len(owner):
        return np.zeros(0, int), np.zeros(0, int)
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return begins, np.diff(np.append(begins, len(owner)))


def reach(steps: np.ndarray) -> np.ndarray:
    """Products, in the logarithm, of each matrix (n x 2 x 2) with all before it."""
    out, k = steps, 1
    while k < len(out):
        before, after = out[:-k], out[k:]
        both = np.logaddexp(before[:, :, :1] + after[:, :1, :], before[:, :, 1:] + after[:, 1:, :])
        out, k = np.concatenate((out[:k], both)), 2 * k
    return out


def forward_backward(pull: np.ndarray, trans: np.ndarray, begins: np.ndarray, lengths: np.ndarray, deep: int = 256) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good of each line, summed expected transitions (2 x 2), and the log partition of all chains.

    pull: log score of good over bad of each line. Chains of up to deep lines run side by side, the longest first; longer
    ones by doubling: a line's product of transition matrices reaches back 1, 2, 4, ... lines.
    """
    score = np.stack((np.zeros_like(pull), pull), axis=1)
    alpha, beta = score.copy(), np.zeros_like(score)
    some = np.flatnonzero(lengths <= deep)
    some = some[np.argsort(-lengths[some], kind="stable")]
    some_begin, some_length = begins[some], lengths[some]
    alive = np.searchsorted(-some_length, -np.arange(1, int(some_length[0]) + 1 if len(some) else 1), "right")  # chains with more than t lines
    for t in range(1, len(alive)):
        at = some_begin[: alive[t]] + t
        alpha[at] = score[at] + np.logaddexp(alpha[at - 1][:, :1] + trans[0], alpha[at - 1][:, 1:] + trans[1])
    for t in range(len(alive) - 2, -1, -1):
        at = some_begin[: alive[t + 1]] + t
        nxt = score[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
    for b, n in zip(begins[lengths > deep].tolist(), lengths[lengths > deep].tolist(), strict=True):
        steps = trans + score[b + 1 : b + n, None, :]  # from a line's label to the next one's
        forward = reach(steps)
        alpha[b + 1 : b + n] = np.logaddexp(score[b, 0] + forward[:, 0], score[b, 1] + forward[:, 1])
        beta[b : b + n - 1] = np.logaddexp.reduce(reach(steps[::-1].transpose(0, 2, 1))[::-1], axis=1)
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(len(pull), bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    joint = np.exp(alpha[at - 1][:, :, None] + trans + (score[at] + beta[at])[:, None, :] - total[at][:, None, None])
    return np.exp(both[:, 1] - total), joint.sum(axis=0) if len(at) else np.zeros((2, 2)), float(total[begins].sum())


class LineField:
    """The trained field: weights of the features, transitions, and the curve from a document's marginals to its score."""

    def __init__(self):
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.w, self.trans, self.slope, self.shift = np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), 1.0, 0.0

    def features(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return with_neighbours(np.clip((x - self.mean) / self.scale, -6, 6), owner)

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of good; 0 without lines."""
        x, size, owner = line_features(texts)
        if not len(x):
            return np.zeros(len(texts))
        good, _, _ = forward_backward(self.features(x, owner) @ self.w, self.trans, *chains(owner))
        total = np.bincount(owner, size, len(texts))
        return np.bincount(owner, good * size, len(texts)) / np.maximum(total, 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.quality(texts) + self.shift, -30, 30)))

    def train(self, texts: list[bytes], y: np.ndarray, *, rounds: int, decay: float) -> None:
        """Lines have no labels: a logistic fit to their documents' labels first tells which lines of bad documents are bad; the field then learns from these."""
        x, size, owner = line_features(texts)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        f = self.features(x, owner).astype(float)
        weight = size / np.bincount(owner, size, len(texts))[owner] / np.where(y[owner] == 1, max(1, y.sum()), max(1, (1 - y).sum()))
        w = logistic(f, y[owner].astype(float), weight / weight.mean(), decay)
        p = f @ w
        worst = np.full(len(texts), np.inf)
        np.minimum.at(worst, owner, p)
        label = np.where(y[owner] == 1, 1, ((p > 0) & (p > worst[owner])).astype(int))
        begins, lengths = chains(owner)
        first = np.zeros(len(label), bool)
        first[begins] = True
        at = np.flatnonzero(~first)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1], label[at]), 1)
        step, theta = np.zeros(len(w) + 4), np.concatenate((w, np.zeros(4)))
        square = np.zeros_like(step)
        for k in range(1, rounds + 1):  # Adam on the exact likelihood
            good, joint, _ = forward_backward(f @ theta[:-4], theta[-4:].reshape(2, 2), begins, lengths)
            slope = np.concatenate((f.T @ (label - good), (seen - joint).ravel())) / len(label) - decay * theta / len(label)
            step, square = 0.9 * step + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            theta += 0.05 * step / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        q = self.quality(texts)
        self.slope, self.shift = logistic(np.stack((q, np.ones_like(q)), axis=1), y.astype(float), np.ones(len(q)), 0.01)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float, rounds: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + decay * np.eye(len(w))
        move = np.linalg.solve(curve, x.T @ (weight * (y - p)) - decay * w)
        w += move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, folds: int = 5, per_label: int = 2500, rounds: int = 150, decay: float = 1.0, seed: int = 3) -> LineField:
    """Learns from at most per_label labelled documents of each label outside the held-out fold; their texts, of 96 MB at most, come to the driver. Without labels of both kinds every score is 0.5."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, folds=folds, most=per_label, seed=seed, per_label=True)
    got = rows.select("id", rows.y.cast("int").alias("y"), "t").toArrow().sort_by("id")
    texts, y = as_bytes(got.column("t").combine_chunks()), np.array(got.column("y").to_pylist(), int)
    model = LineField()
    model.slope = 0.0
    lines = [i for i, t in enumerate(texts) if t.split()]
    if 0 < y[lines].sum() < len(lines):
        model.train([texts[i] for i in lines], y[lines], rounds=rounds, decay=decay)
    return model


def score_quality(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, from the whole text alone. A null, empty or blank text has no good line and gets the lowest score. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = shared.value.score(as_bytes(batch.column("t")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_rejected(docs: DataFrame, model: LineField, text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """docs without those that score below threshold; all columns stay. Narrow: no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.score(as_bytes(batch.column(batch.schema.names.index(text_col)))) >= threshold))

    return docs.withColumn(text_col, text_of(text_col)).mapInArrow(keep, docs.schema) if docs.schema[text_col].dataType.simpleString() != "string" else docs.mapInArrow(keep, docs.schema)
