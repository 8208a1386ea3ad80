"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of words. A context is kept if its next-symbol distribution diverges from its suffix's by more than
its parameters cost; its distribution is smoothed with the suffix's. A token is scored from the longest kept suffix of
what precedes it. Contexts grow word by word until none passes the test. Counts cover all training documents; the tree is
spread over owners of hash ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix
from .groups import STATE, Groups, Packed, cuts, loads, planes, unplanes
from .learn import held_out

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits for a word's number beside the place of its context; words are numbered by place times owners, plus owner, plus 1.
NUMBER = np.uint64(40)
LOW = np.uint64((1 << 40) - 1)
#: In place of a count: the context isn't kept.
NOT_KEPT = np.uint64(0xFFFFFFFFFFFFFFFF)
#: In place of a count: it is told with the items' places.
OFTEN = 255


def word_counts(t: Packed, owners: int) -> dict[int, tuple]:
    """A group's words by hash and their training counts, for each owner."""
    hashes, order = hashed(t.words)
    n = np.bincount(t.at, ~np.array(t.marks, bool)[t.doc], len(order)).astype(np.uint32)[order]
    hashes = hashes[order]
    at = cuts(hashes, owners)
    return {o: (planes(np.diff(hashes[a:b], prepend=np.uint64(0))), planes(n[a:b])) for o, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a}


def falls(values: np.ndarray, number: np.ndarray) -> tuple[str, bytes]:
    """Values that are the smaller, the larger their numbers: in that order, as small steps."""
    return planes(-np.diff(values[np.argsort(number, kind="stable")].astype(np.int64), prepend=0))


def unfalls(data: tuple[str, bytes], number: np.ndarray) -> np.ndarray:
    out = np.zeros(len(number), np.int64)
    out[np.argsort(number, kind="stable")] = -np.cumsum(unplanes(data))
    return out


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return hashes, np.argsort(hashes, kind="stable")


class Live:
    """A group's documents with the scores of the tokens that are settled, and the others: those before which a context of the present depth stands that may be a state."""

    def __init__(self, settings: dict, state: tuple | None = None):
        self.s = settings
        if state:
            self.depth, self.ids, self.marks, *arrays = state
            self.lens, self.known, self.base, self.score, self.pos, self.sym, self.p, self.common, self.last, self.ctx, self.table, self.count = map(unplanes, arrays)
            self.pos, self.ctx, self.p = np.cumsum(self.pos, dtype=np.int32), self.ctx.astype(np.int32), self.p.astype(float)
            self.doc = np.searchsorted(np.cumsum(self.lens), self.pos, "right").astype(np.int32)

    @staticmethod
    def first(t: Packed, got: dict, settings: dict) -> Live:
        """All tokens that have one before them, from the answers about words."""
        self = Live(settings)
        _, order = hashed(t.words)
        c, number = np.zeros(len(order), np.int64), np.zeros(len(order), np.uint64)
        parts = [(x, unplanes(y), o) for x, y, o in got[0].values()]
        number[order] = np.concatenate([y * np.uint64(settings["owners"]) + np.uint64(o + 1) for _, y, o in parts])
        c[order] = np.concatenate([unfalls(x, y) for x, y, _ in parts])
        n, v = settings["totals"]
        p = (c + 0.1) / (n + 0.1 * (v + 1))
        add = lambda x: np.bincount(t.doc, x, len(t.lens))
        self.depth, self.ids, self.marks, self.lens = 1, t.ids, t.marks, t.lens
        self.known, self.base, self.score = add(c[t.at] > 0).astype(np.int64), add(np.log10(p)[t.at]), np.zeros(len(t.lens))
        at, end = t.at, np.array([not w for w in t.words], bool)
        self.pos, self.doc, self.sym, self.p = np.arange(len(at), dtype=np.int32), t.doc.astype(np.int32), number[at], p[at]
        self.common, self.last = (c >= settings["least_pair"])[at], end[at]
        # the context that ends before each token: its place in a table of numbers, how often these occur in training
        self.go(np.arange(1, len(at))[(c[at[:-1]] >= settings["least_context"]) & ~self.last[:-1]], at[:-1], number, c)
        return self

    def go(self, live: np.ndarray, ctx: np.ndarray, table: np.ndarray, count: np.ndarray) -> None:
        """Settles all tokens but the live ones; ctx: the contexts that each token but the last makes for the next one."""
        settled = np.ones(len(self.pos), bool)
        settled[live] = False
        self.score = self.score + np.bincount(self.doc[settled], np.log10(self.p[settled]), len(self.lens))
        self.ctx, self.table, self.count = ctx[live - 1], table, count
        self.pos, self.doc, self.sym, self.p, self.common, self.last = (x[live] for x in (self.pos, self.doc, self.sym, self.p, self.common, self.last))

    def state(self) -> tuple:
        """For the next round, after asked."""
        arrays = self.lens, self.known, self.base, self.score, np.diff(self.pos, prepend=np.int32(0)).astype(np.uint32), self.sym, self.p.astype(np.float32), self.common, self.last, self.ctx.astype(np.uint32), self.table, self.count
        return self.depth, self.ids, self.marks, *map(planes, arrays)

    def asked(self) -> None:
        """Contexts by owner and number, their occurrences in training, and the (context, symbol) items in that order.

        A context of hot occurrences or more is split over owners by its symbols.
        """
        owners, hot = self.s["owners"], self.s["hot"]
        used = np.flatnonzero(np.bincount(self.ctx, minlength=len(self.table)))
        numbers = self.table[used]
        own = mix(numbers) % np.uint64(owners)
        order = np.lexsort((numbers, own))
        rank = np.zeros(len(self.table), np.int32)
        rank[used[order]] = np.arange(len(used))
        self.ctx, self.table, self.count, own = rank[self.ctx], numbers[order], self.count[used[order]], own[order].astype(np.int64)
        self.pick = np.flatnonzero(self.common).astype(np.int32)
        keys = self.ctx[self.pick].astype(np.uint64) << NUMBER | self.sym[self.pick]
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys = keys[order]
        new = np.diff(keys, prepend=~keys[:1]) != 0
        self.item = np.empty(len(keys), np.int32)
        self.item[order] = np.cumsum(new, dtype=np.int32) - 1
        self.first_of, keys = self.pick[order[new]], keys[new]
        self.of, self.item_sym = (keys >> NUMBER).astype(np.int64), keys & LOW
        self.hot = self.count >= hot
        # what owners are asked for, in order: the contexts that aren't split, then each item's part of those that are
        whole = np.flatnonzero(~self.hot)
        self.ask_of, self.ask_owner, self.item_ask = whole, own[whole], (np.cumsum(~self.hot) - 1)[self.of]
        split = np.flatnonzero(self.hot[self.of])
        if len(split):
            of = self.of[split]
            slices = (self.count[of] // hot + 1).astype(np.uint64)
            to = (mix(self.table[of] + (self.item_sym[split] % slices + np.uint64(1)) * ODD) % np.uint64(owners)).astype(np.int64)
            parts, back = np.unique(of * owners + to, return_inverse=True)
            self.item_ask[split] = len(whole) + back
            self.ask_of, self.ask_owner = np.concatenate((whole, parts // owners)), np.concatenate((self.ask_owner, parts % owners))
        order = np.lexsort((self.table[self.ask_of], self.ask_owner)) if len(split) else np.arange(len(whole))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ask_of, self.ask_owner, self.item_ask = self.ask_of[order], self.ask_owner[order], rank[self.item_ask]
        self.sent = np.lexsort((self.item_sym, self.item_ask)) if len(split) else np.arange(len(self.of))

    def lists(self) -> Iterator[tuple[int, tuple]]:
        """For each owner: contexts' numbers, occurrences, how many items each has; items' symbols, counts here, and odds in the suffix; which contexts are parts."""
        train = ~np.array(self.marks, bool)[self.doc[self.pick]]
        counts = np.bincount(self.item, train, len(self.of)).astype(np.uint32)[self.sent]
        odds = np.minimum(255, np.round(-8 * np.log2(self.p[self.first_of]))).astype(np.uint8)[self.sent]
        runs, sym = np.bincount(self.item_ask, minlength=len(self.ask_of)).astype(np.uint32), self.item_sym[self.sent]
        sym[1:] -= np.where(np.diff(self.item_ask[self.sent]) == 0, sym[:-1], np.uint64(0))  # steps, as a context's symbols ascend
        number, n, part = self.table[self.ask_of], self.count[self.ask_of], self.hot[self.ask_of]
        at = np.searchsorted(self.ask_owner, np.arange(self.s["owners"] + 1))
        inner = np.concatenate(([0], np.cumsum(runs, dtype=np.int64)))[at]
        for o in range(self.s["owners"]):
            (a, b), (i, j) = at[o : o + 2], inner[o : o + 2]
            if b > a:
                told = np.diff(number[a:b], prepend=np.uint64(0)), np.diff(n[a:b], prepend=0), runs[a:b], sym[i:j], counts[i:j], odds[i:j], np.flatnonzero(part[a:b]).astype(np.uint32)
                yield o, tuple(map(planes, told))

    def learn(self, got: dict) -> None:
        """Takes the answers about contexts of this depth in, and goes on to those one word longer, which are the items counted now."""
        beta, empty = self.s["beta"], [np.zeros(0, np.uint64)]
        parts = [[unplanes(x[0]), unplanes(x[1]).astype(np.int64), unplanes(x[2])] for x in got.values()]
        for x, (*_, many, owner) in zip(parts, got.values(), strict=True):
            x[1][x[1] == OFTEN] = unfalls(many, x[2])
            x[2] = x[2] * np.uint64(self.s["owners"]) + np.uint64(owner + 1)
        rest, k_sent, number = (np.concatenate([x[i] for x in parts] or empty) for i in range(3))
        ask_weight = np.where(rest == NOT_KEPT, 1, (beta + rest) / (self.count[self.ask_of] + beta))
        gamma = np.ones(len(self.table))
        gamma[self.ask_of] = ask_weight
        if self.hot.any():
            numbers, weights = self.s["weights"][self.depth]
            gamma[self.hot] = weights[np.searchsorted(numbers, self.table[self.hot])]
        k, longer = np.zeros(len(self.of), np.int64), np.zeros(len(self.of), np.uint64)
        k[self.sent] = k_sent
        longer[self.sent[k_sent >= self.s["least_context"]]] = number
        self.p = self.p * gamma[self.ctx]
        self.p[self.pick] += np.where(gamma[self.of] < 1, k / (self.count[self.of] + beta), 0)[self.item]
        count, item = np.zeros(len(self.pos), np.int64), np.zeros(len(self.pos), np.int32)
        count[self.pick], item[self.pick] = k[self.item], self.item
        self.common, self.depth = count >= self.s["least_pair"], self.depth + 1
        self.pick = self.item = self.first_of = self.of = self.item_sym = self.item_ask = self.sent = None
        follows = (self.pos[1:] == self.pos[:-1] + 1) & ~self.last[:-1] & (count[:-1] >= self.s["least_context"])
        self.go(np.flatnonzero(follows) + 1, item[:-1], longer, k)


def count_words(lists: list, owner: int, owners: int, least: int) -> tuple[list, tuple[int, int]]:
    """Adds up the lists' counts: each list gets the sums in its order, and the words' places among the owner's by frequency, from least on (below: words that occur fewer than least times). Beside: tokens and distinct tokens."""
    pairs = [(unplanes(h), unplanes(n)) for h, n in lists]
    words, at = np.unique(np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in pairs]), return_inverse=True)
    sums = np.bincount(at, np.concatenate([n for _, n in pairs]), len(words)).astype(np.int64)
    by = np.argsort(-sums, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[by] = np.arange(len(by)) + least
    rank = np.where(sums < least, least - 1 - sums, rank)
    ends = np.cumsum([0] + [len(h) for h, _ in pairs]).tolist()
    return [(falls(sums[at[a:b]], rank[at[a:b]]), planes(rank[at[a:b]].astype(np.uint64)), owner) for a, b in zip(ends[:-1], ends[1:], strict=True)], (int(sums.sum()), int((sums > 0).sum()))


def weight(n: np.ndarray, kept: np.ndarray, size: np.ndarray, mass: np.ndarray, gain: np.ndarray, beta: float, cost: float) -> np.ndarray:
    """The divergence test: what weight the suffix's distribution has in each context (1: the context isn't kept).

    kept, size, mass, gain: occurrences, number, suffix probability, and divergence of the symbols with a count of their own.
    """
    rest = np.maximum(n - kept, 0)
    gain = gain + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / n / (1 - np.minimum(mass, 1 - 1e-9))), 0)
    stays = (size > 0) & (gain > cost * size * np.log(np.maximum(n, 2)))
    return np.where(stays, (beta + rest) / (n + beta), 1)


def test_contexts(lists: list, owner: int, settings: dict, cost: float, most_items: int = 1 << 19) -> tuple[list, tuple]:
    """Each list gets, of its contexts, the occurrences that go to the suffix (NOT_KEPT: all); of its items the counts (OFTEN: least_context or more); of those that are OFTEN places among the owner's by frequency, and counts.

    Other counts that only have to reach least_pair are told as that. Beside: how many contexts are kept, and the sums of the parts of split contexts.
    Contexts are tested in ranges of about most_items items of all lists, so that only their planes stand in memory as a whole.
    """
    beta, least_pair, least_context = (settings[k] for k in ("beta", "least_pair", "least_context"))
    numbers, n = ([np.cumsum(unplanes(one[i]), dtype=kind) for one in lists] for i, kind in ((0, np.uint64), (1, np.int64)))
    inner = [np.concatenate(([0], np.cumsum(unplanes(one[2]), dtype=np.int64))) for one in lists]
    parts = [unplanes(one[6]).astype(np.int64) for one in lists]
    bounds = ranges(numbers, inner, most_items)
    # for each list and range: what suffixes get, told counts, and which of the frequent items, over all ranges, are the often told ones
    got: list[list[tuple]] = [[] for _ in lists]
    frequent, reports, so_far = [], [], 0
    cut = [np.searchsorted(x, bounds).tolist() + [len(x)] for x in numbers]
    for r in range(len(bounds)):
        at_ = [slice(c[r], c[r + 1]) for c in cut]
        items_ = [(int(x[s.start]), int(x[s.stop])) for x, s in zip(inner, at_, strict=True)]
        keys, first, at = np.unique(np.concatenate([x[s] for x, s in zip(numbers, at_, strict=True)]), return_index=True, return_inverse=True)
        size = np.concatenate([x[s] for x, s in zip(n, at_, strict=True)])[first].astype(float)
        runs = np.concatenate([np.diff(x[s.start : s.stop + 1]) for x, s in zip(inner, at_, strict=True)])
        step, counts, odds = (np.concatenate([unplanes(one[i], *x) for one, x in zip(lists, items_, strict=True)]) for i in (3, 4, 5))
        key_ends, item_ends = np.cumsum([0, *(s.stop - s.start for s in at_)]), np.cumsum([0, *(j - i for i, j in items_)])
        sym, begin = np.cumsum(step, dtype=np.uint64), (np.cumsum(runs) - runs)[runs > 0]
        sym -= np.repeat(sym[begin] - step[begin], runs[runs > 0])
        sym |= np.repeat(at, runs).astype(np.uint64) << NUMBER
        items, first, item = np.unique(sym, return_index=True, return_inverse=True)
        k = np.bincount(item, counts, len(items)).astype(np.int64)
        k[k < least_pair] = 0
        of = (items >> NUMBER).astype(np.int64)
        p = np.exp2(-odds[first].astype(float) / 8)
        add = lambda x: np.bincount(of, np.where(k > 0, x, 0), len(keys))  # noqa: B023, E731
        sums = add(k), add(1.0), add(p), add(k * np.log(np.maximum(k, 1) / size[of] / p))
        kept = weight(size, *sums, beta, cost) < 1
        split = np.zeros(len(keys), bool)
        for x, s, i in zip(parts, at_, key_ends.tolist(), strict=False):
            split[at[x[(x >= s.start) & (x < s.stop)] - s.start + i]] = True
        rest = np.where(kept, np.maximum(size - sums[0], 0).astype(np.uint64), NOT_KEPT)
        often = k >= least_context
        place = np.cumsum(often) - 1 + so_far
        told = np.where(often, OFTEN, np.where((kept | split)[of], k, np.minimum(k, least_pair))).astype(np.uint8)[item]
        for out, a, b, i, j in zip(got, key_ends[:-1], key_ends[1:], item_ends[:-1], item_ends[1:], strict=True):
            out.append((rest[at[a:b]], told[i:j].copy(), place[item[i:j][told[i:j] == OFTEN]]))
        frequent.append(k[often])
        so_far += len(frequent[-1])
        reports.append((int(kept[~split].sum()), keys[split], size[split], *(x[split] for x in sums)))
    k = np.concatenate(frequent)
    rank = np.empty(len(k), np.uint64)
    rank[np.argsort(-k, kind="stable")] = np.arange(len(k), dtype=np.uint64)
    answers = []
    for out in got:
        rest, told, often = map(np.concatenate, zip(*out, strict=True))
        answers.append((planes(rest), planes(told), planes(rank[often]), falls(k[often], rank[often]), owner))
        out.clear()
    return answers, (sum(x[0] for x in reports), *map(np.concatenate, list(zip(*reports, strict=True))[1:]))


def ranges(numbers: list[np.ndarray], inner: list[np.ndarray], most: int) -> np.ndarray:
    """First numbers of ascending ranges of contexts that have about most items each in all lists, or one context; the first is 0."""
    of = np.concatenate(numbers)
    order = np.argsort(of, kind="stable")
    of, held = of[order], np.cumsum(np.concatenate([np.diff(x) for x in inner])[order])
    return np.unique(np.concatenate(([np.uint64(0)], of[np.searchsorted(held, np.arange(most, held[-1], most))])))


def split_weights(reports: list, beta: float, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers of the split contexts, and their weights, from the sums of their parts."""
    parts = [np.concatenate([r[i] for r in reports]) for i in range(1, 7)] if reports else [np.zeros(0)] * 6
    numbers, first, at = np.unique(parts[0], return_index=True, return_inverse=True)
    return numbers, weight(parts[1][first], *(np.bincount(at, x, len(numbers)) for x in parts[2:]), beta, cost)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 10, depth: int = 6, least_context: int = 16, least_pair: int = 2, beta: float = 4.0, cost: float = 1.0, hot: int = 1 << 20, group_bytes: int = 8 << 20, owner_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; learns from the rows outside the held-out fold.

    Tokens are the words between ASCII blanks, A-Z lower-cased, and one end; a null text is empty and has the end only.
    base_score: log10 probability under smoothed word counts, summed; score: under the suffix tree. A context must occur
    least_context (at most 255, not below least_pair) times in training, a symbol least_pair times in it to have a
    probability of its own; what rarer symbols have goes to the suffix's distribution, so each state's probabilities sum
    to 1. cost: nats of divergence, times the logarithm of its count, that each symbol of a context must bring. Contexts
    grow to depth words, or until none of a length passes the test. Words are told apart by 64-bit hashes, all else by
    numbers that owners give. Ids must be integers (or null). Repeated rows count as often as they occur; other columns
    are ignored; an empty table gives no rows.

    group_bytes and owner_bytes (they grow with the square root of the input) bound the memory of a task. A context that
    occurs hot times is split over owners by its symbols; hot grows so that a depth has 200,000 of them at most, whose
    weights (16 bytes each) are all that is broadcast. A token whose longest context is found is settled; only the others
    are carried to the next depth.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, folds).alias("mark"), F.col(text_col).cast("string").alias("t"))
    groups = Groups(rows, group_bytes, owner_bytes, "lm", lower=True, end=True)
    s = {"owners": groups.owners, "least_context": least_context, "least_pair": least_pair, "beta": beta, "weights": {}}
    words, reports = groups.answer(groups.ask(None, lambda body, got: word_counts(Packed(body), s["owners"])), 0, lambda got, owner: count_words(got, owner, s["owners"], least_pair))
    s["totals"] = tuple(sum(r[i] for r in reports) for i in (0, 1))
    s["hot"] = max(hot, s["totals"][0] // 200_000)

    def at_first(body: bytes, got: dict) -> Live:
        live = Live.first(Packed(body), got, s)
        live.asked()
        return live

    def later(body: bytes, got: dict) -> Live:
        """The group after the answers in got, which are about contexts of one depth."""
        if 0 in got:
            live = at_first(body, got)
        else:
            live = Live(s, loads(body))
            live.asked()
        live.learn(got.get(live.depth, {}))
        return live

    def longer(body: bytes, got: dict) -> Iterator[tuple[int, tuple]]:
        live = later(body, got)
        got.clear()
        live.asked()
        yield STATE, live.state()
        yield from live.lists()

    asked, before = groups.ask(words, lambda body, got: at_first(body, got).lists()), words
    for d in range(1, depth + 1):
        given, reports = groups.answer(asked, d, lambda got, owner: test_contexts(got, owner, s, cost))
        before = before.unionByName(given) if d == 1 else given
        s["weights"][d] = split_weights(reports, beta, cost)
        if d == depth or not sum(r[0] for r in reports) and not (s["weights"][d][1] < 1).any():
            break
        asked = groups.advance(before, longer)

    def scores(body: bytes, got: dict) -> pd.DataFrame:
        live = later(body, got)
        live.go(np.zeros(0, np.int64), np.zeros(0, np.int64), live.table, live.count)
        return pd.DataFrame({"doc_id": pd.array(live.ids, "Int64"), "held_out": live.marks, "n_tokens": live.lens, "n_known": live.known, "train_tokens": s["totals"][0], "base_score": live.base, "score": live.score})

    return groups.finish(before, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
