"""Substring dedup by prefix-partitioned suffix trees.

Only suffixes that can start a repeat travel: a window of words is told by its anchor (its least hash of a few words, the
same in every copy), and anchors that occur once in the corpus rule their windows out. The others go, as runs of words, to
the owner of their anchor's range; windows of an anchor too frequent for one owner are dealt by a longer prefix, the whole
window. An owner takes its range in parts of bounded words and builds each part's suffix tree as a suffix array with
common-prefix lengths: leaves below an internal node at least a window deep are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rolling
from .exact_dedup import rice_decode, rice_encode
from .groups import Groups, Packed, Places, cuts, planes, unplanes

BITS = 48
#: Bits for a word's place in its group, below those of its seed's hash that choose the anchor.
PLACE = 36
#: Parts of an owner's range.
SLOTS = 256
LAST = np.iinfo(np.int64).max


def suffix_tree(words: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at least width words, sorted, and the common-prefix length of each with the one before (0 for the first).

    words: the words of all texts, one after the other; left: how many words the suffix at each place has, to the end of
    its text. Ranks by the first 1, 2, 4, ... words are made from those by half as many, up to the longest suffix; these
    also give the common prefixes, the longest power of two first.
    """
    ranks, k, most = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1, int(left.max(initial=1))
    while k < most:
        after = np.zeros(len(words), np.int64)
        at = np.flatnonzero(left > k)
        after[at] = ranks[-1][at + k] + 1
        ranks.append(np.unique(ranks[-1] * (len(words) + 1) + after, return_inverse=True)[1])
        k *= 2
    order = np.flatnonzero(left >= width)
    order = order[np.argsort(ranks[-1][order], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    common, short = np.zeros(len(a), np.int64), np.minimum(left[a], left[b])
    for i in range(len(ranks) - 1, -1, -1):
        at = np.flatnonzero(short - common >= 1 << i)
        common[at[ranks[i][a[at] + common[at]] == ranks[i][b[at] + common[at]]]] += 1 << i
    return order, np.concatenate(([0], common)) if len(order) else common


def repeats(words: np.ndarray, left: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """For each suffix of width words or more whether, by its first width words, it equals one of lower rank (rank: one for each place)."""
    order, common = suffix_tree(words, left, width)
    out = np.zeros(len(words), bool)
    if len(order):
        node = np.flatnonzero(common < width)  # where the leaves below another node of that depth begin
        first = np.minimum.reduceat(rank[order], node)
        out[order] = rank[order] != np.repeat(first, np.diff(np.append(node, len(order))))
    return out


class Windows:
    """A group's words and windows: hashes, anchors, and after the first answers the runs that other groups must see."""

    def __init__(self, t: Packed, width: int, seed_width: int):
        self.t, self.width = t, width
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, t.words), np.uint64, len(t.words))[t.at] if len(t.words) else np.zeros(0, np.uint64)
        n = max(0, len(h) - width + 1)
        self.at = np.flatnonzero(t.doc[:n] == t.doc[width - 1 :]) if n else np.zeros(0, np.int64)  # first words of the windows
        self.doc = t.doc[self.at]
        self.start = self.at - t.begin[self.doc]
        self.win = rolling(h, width)[self.at]
        # the least seed of each window, the first of equal ones: the place stands in the low bits
        seeds = rolling(h, seed_width)
        places = np.uint64((1 << PLACE) - 1)
        keys = seeds & ~places | np.arange(len(seeds), dtype=np.uint64)
        span, size = width - seed_width + 1, 1
        while 2 * size <= span:
            keys = np.minimum(keys[:-size], keys[size:])
            size *= 2
        rest = span - size
        keys = np.minimum(keys[: len(keys) - rest], keys[rest:])
        self.place = (keys[self.at] & places).astype(np.int64)
        self.anchor = seeds[self.place] >> np.uint64(64 - BITS)

    def lists(self, owners: int) -> dict[int, tuple]:
        """The distinct anchors, Rice-coded for each owner, and at how many places each occurs."""
        self.distinct, where = np.unique(self.anchor, return_inverse=True)
        anchors = np.flatnonzero(np.concatenate((np.ones(min(1, len(where)), bool), self.place[1:] != self.place[:-1])))  # a place's windows stand together
        self.count = np.bincount(where[anchors], minlength=len(self.distinct))
        self.where, self.cut = where, cuts(self.distinct, owners, BITS)
        width = (1 << BITS) // owners + 1
        return {o: (rice_encode(self.distinct[a:b] - np.uint64(o * width)), planes(self.count[a:b].astype(np.uint32))) for o, (a, b) in enumerate(zip(self.cut[:-1], self.cut[1:], strict=True)) if b > a}

    def candidates(self, got: dict, owners: int) -> None:
        """Windows whose anchor occurs at two places of the corpus; of equal ones within the group only the first goes on, the others are repeats."""
        self.lists(owners)
        seen, hot = self.count > 1, np.zeros(len(self.distinct), bool)
        for o, bitmaps in got.items():
            a, b = self.cut[o : o + 2]
            for flags, bitmap in zip((seen, hot), bitmaps, strict=True):
                flags[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
        self.flag = np.zeros(len(self.win), bool)
        live = np.flatnonzero(seen[self.where])
        self.ids = ids = np.array([LAST if x is None else x for x in self.t.ids], np.int64)
        self.nulls = nulls = np.array([x is None for x in self.t.ids], bool)
        order = live[np.lexsort((self.start[live], self.doc[live], ids[self.doc[live]], nulls[self.doc[live]], self.win[live]))]
        first = np.concatenate(([True], self.win[order[1:]] != self.win[order[:-1]])) if len(order) else np.zeros(0, bool)
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
        same = np.ones(len(order), bool)
        for k in range(self.width):
            same &= self.t.at[self.at[order] + k] == self.t.at[self.at[lead] + k]
        self.flag[order[~first & same]] = True
        go = np.zeros(len(self.win), bool)
        go[order[first | ~same]] = True
        # runs: neighbouring windows of one anchor; windows of frequent anchors are alone
        at = np.flatnonzero(go)
        new = hot[self.where[at]]
        if len(at):
            new[0] = True
        new[1:] |= (at[1:] != at[:-1] + 1) | (self.place[at[1:]] != self.place[at[:-1]]) | (self.doc[at[1:]] != self.doc[at[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        key = np.where(hot[self.where[at[begin]]], self.win[at[begin]] >> np.uint64(64 - BITS), self.anchor[at[begin]])
        order = np.argsort(key, kind="stable")
        self.run, self.size, self.key = at[begin][order], size[order], key[order]
        self.run_cut = cuts(self.key, owners, BITS)

    def runs(self, owners: int) -> dict[int, tuple]:
        out, width, names = {}, (1 << BITS) // owners + 1, np.array(self.t.words, object)
        for o in range(owners):
            a, b = self.run_cut[o : o + 2]
            if b > a:
                run, size = self.run[a:b], self.size[a:b]
                slot = (self.key[a:b] - np.uint64(o * width)).astype(np.int64) * SLOTS // width
                long = size + self.width - 1
                at = self.t.at[np.repeat(self.at[run] - np.cumsum(long) + long, long) + np.arange(int(long.sum()))]
                used, at = np.unique(at, return_inverse=True)
                doc = self.doc[run]
                told = (slot.astype(np.uint8), self.ids[doc], self.nulls[doc], doc.astype(np.int32), self.start[run], size.astype(np.uint32), at.astype(np.uint32))
                out[o] = (b" ".join(names[used]), *map(planes, told))
        return out

    def repeats(self, got: dict) -> None:
        for o, bitmap in got.items():
            a, b = self.run_cut[o : o + 2]
            size = self.size[a:b]
            at = np.repeat(self.run[a:b] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            self.flag[at] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(at)).astype(bool)

    def stays(self) -> np.ndarray:
        """For each word of the group whether it stays."""
        hit, n = self.at[self.flag], len(self.t.at) + 1
        return np.cumsum(np.bincount(hit, minlength=n) - np.bincount(hit + self.width, minlength=n))[:-1] == 0


def shared_anchors(lists: list, hot: int) -> list:
    """For each list two bitmaps: of the anchors that another list has too, and of those that occur hot times or more."""
    codes, counts = [rice_decode(x) for x, _ in lists], [unplanes(n) for _, n in lists]
    distinct, at, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    total = np.bincount(at, np.concatenate(counts), len(distinct))
    ends = np.cumsum([0] + [len(x) for x in codes])
    return [(np.packbits(n[at[a:b]] > 1).tobytes(), np.packbits(total[at[a:b]] >= hot).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def repeated_windows(lists: list, width: int, most: int) -> list:
    """For each list (in the order of groups) a bitmap of its runs' windows: whether an equal one starts earlier."""
    number = Places()
    cols: list[list] = [[] for _ in range(7)]
    for names, *told in lists:
        for x, to in zip(told, cols, strict=True):
            to.append(unplanes(x))
        own = np.fromiter(map(number.__getitem__, names.split(b" ")), np.uint32)
        cols[6][-1] = own[cols[6][-1]]
    counts = [int(x.sum()) for x in cols[5]]
    group = np.repeat(np.arange(len(lists)), [len(x) for x in cols[5]])
    slot, ids, nulls, doc, start, size, words = (np.concatenate(x) for x in cols)
    size = size.astype(np.int64)
    del number, cols
    # runs of one document never share a window, so their order and the place within a run order all windows
    order = np.lexsort((start, doc, group, ids, nulls))
    of = np.empty(len(order), np.int64)
    of[order] = np.arange(len(order))
    del group, ids, nulls, doc, start, order
    long = size + width - 1
    begin, before = np.cumsum(long) - long, np.cumsum(size) - size
    flag = np.zeros(int(size.sum()), bool)
    by = np.argsort(slot, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], slot[by][1:] != slot[by][:-1])))
    held = np.append(np.cumsum(long[by]) - long[by], long.sum())[np.append(first, len(by))]  # words before each slot
    first = np.append(first, len(by))
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(held, held[i] + most, "right")) - 1)
        part = by[first[i] : first[j]]
        n = long[part]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        left = np.repeat(n, n) - inner
        found = repeats(words[np.repeat(begin[part], n) + inner], left, np.repeat(of[part] << 32, n) + inner, width)
        starts = left >= width
        flag[(np.repeat(before[part], n) + inner)[starts]] = found[starts]
        i = j
    ends = np.cumsum([0, *counts])
    return [np.packbits(flag[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 20, seed_width: int = 6, hot: int = 1 << 14, group_bytes: int = 8 << 20, owner_bytes: int = 24 << 20, most_words: int = 1 << 19, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if with_text) for each row.

    A window is width consecutive words (between ASCII blanks, unchanged) of one document. Every word goes that lies in a
    window whose words also start earlier: in a row with a smaller id (a null id comes last; of rows with one id the
    earlier in the input), or earlier in the same row. Windows are judged on the input. Null texts have no words; texts
    shorter than a window keep all. Whole texts are read; ids must be integers (or null); other columns are ignored; an
    empty table gives no rows.

    group_bytes and owner_bytes (they grow with the square root of the input) bound the memory of a task, most_words that
    of a suffix tree; anchors that occur hot times are split by whole windows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(False).alias("mark"), F.col(text_col).cast("string").alias("t"))
    groups = Groups(rows, group_bytes, owner_bytes, "substrings")
    owners = groups.owners
    asked = groups.ask(None, lambda body, got: Windows(Packed(body), width, seed_width).lists(owners))
    answers, _ = groups.answer(asked, 0, lambda got, owner: (shared_anchors(got, hot), None))

    def ask_runs(body: bytes, got: dict) -> dict:
        w = Windows(Packed(body), width, seed_width)
        w.candidates(got.get(0, {}), owners)
        return w.runs(owners)

    given, _ = groups.answer(groups.ask(answers, ask_runs), 1, lambda got, owner: (repeated_windows(got, width, most_words), None))

    def finish(body: bytes, got: dict) -> pd.DataFrame:
        w = Windows(t := Packed(body), width, seed_width)
        w.candidates(got.get(0, {}), owners)
        w.repeats(got.get(1, {}))
        stays = w.stays()
        kept = [b" ".join(map(t.words.__getitem__, t.at[b : b + n][stays[b : b + n]].tolist())) for b, n in zip(t.begin.tolist(), t.lens.tolist(), strict=True)]
        removed = t.lens - np.bincount(t.doc, stays, len(t.lens)).astype(np.int64)
        out = {"doc_id": pd.array(t.ids, "Int64"), "n_words": t.lens, "n_removed": removed, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return pd.DataFrame(out | ({"kept_text": [x.decode() for x in kept]} if with_text else {}))

    return groups.finish(answers.unionByName(given), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
