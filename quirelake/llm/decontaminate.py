"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of template tokens, and of the words themselves, are
hash-joined with the benchmark's; an alignment counts by its runs of windows whose slots agree: each value of the item stands for one value in the document.
So verbatim copies and questions with other parameters are found alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, rolling, slices, small_enough, text_of

# Unit words and symbols that take the unit placeholder.
UNITS = frozenset(
    b"mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg ton tons oz lb lbs pound pounds ml cl l liter liters litre litres gallon gallons "
    b"s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar "
    b"k c f % $ usd eur gbp dollar dollars cent cents euro euros percent degree degrees mph kph km/h m/s".split()
)
NUMBER = re.compile(rb"[+-]?[$\xe2\x82\xac\xc2\xa3]*\d[\d.,:/]*%?(st|nd|rd|th)?")
EDGES = b".,;:!?\"'()[]{}"
FLAGS = np.uint64(15)
NUM, UNIT, CAPITAL, ENDS = 1, 2, 4, 8
SLOT_H = np.array([0] + [xxhash.xxh3_64_intdigest(x) & ~15 for x in (b"<num>", b"<unit>", b"<name>")], np.uint64)
EXACT = np.uint64(0x5851F42D4C957F2D)  # tells windows of words from windows of template tokens


class Canon(dict):
    """For a word the hash of its bare lower-case form; the low bits say: number, unit, capitalised, ends a sentence."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(EDGES) or word
        flags = ENDS if word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":") else 0
        plain = bare.decode(errors="replace")
        if NUMBER.fullmatch(bare):
            flags |= NUM
        elif bare.lower() in UNITS and len(bare) > 1 or bare in (b"%", b"$"):
            flags |= UNIT
        else:
            flags |= CAPITAL if plain[0] != plain[0].lower() and plain[1:] != plain[1:].upper() else 0  # words in capitals throughout are no names
        out = self[word] = xxhash.xxh3_64_intdigest(plain.lower()) & ~15 | flags
        return out

    def forms(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Hashes of the words as they are, and two templates: token hashes and the kind of slot at each (0: none, 1: number, 2: unit, 3: name).

        In the first template a capitalised word that opens a sentence or the text is plain; in the second each is a name,
        whatever stands before it.
        """
        if len(self) > self.most:
            self.clear()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        flags = (h & FLAGS).astype(np.uint8)
        inside = np.zeros(len(h), bool)
        inside[1:] = flags[:-1] & ENDS == 0
        h &= ~FLAGS
        capital = flags & CAPITAL > 0
        out = []
        for name in (capital & inside, capital):
            kind = np.where(name, np.uint8(3), flags & 3)
            out.append((np.where(kind > 0, SLOT_H[kind], h), kind))
        return h, out


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    return rolling(h, n) ^ np.uint64(n)


def _worded(kind: np.ndarray, n: int) -> np.ndarray:
    """Whether at least half of each window of n tokens is words."""
    sums = np.concatenate(([0], np.cumsum(kind > 0)))
    return 2 * (sums[n:] - sums[:-n]) <= n


def _slots(words: list[bytes], kind: np.ndarray, at: int, n: int) -> list[dict]:
    return [{"p": int(i), "k": int(kind[i]), "v": words[i].strip(EDGES).decode(errors="replace")} for i in np.flatnonzero(kind[at : at + n]) + at]


SLOTS = "array<struct<p:int,k:int,v:string>>"


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, least: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), as_bytes(batch.column("t")), strict=True):
                words = text.split()
                if words:
                    n = min(window, len(words))
                    exact, templates = canon.forms(words)
                    whole = (_windows(exact, n) ^ EXACT).astype(np.int64).tolist()
                    for line, (h, kind) in enumerate(templates):
                        good, hashes = _worded(kind, n) & (len(words) >= least), _windows(h, n).astype(np.int64).tolist()
                        told = (item, n, len(whole), int(good.sum()), line)
                        rows += [(*told, int(i), False, hashes[i], _slots(words, kind, i, n)) for i in np.flatnonzero(good)]
                        rows += [(*told, i, True, w, []) for i, w in enumerate(whole)]
            slot = pa.list_(pa.struct([("p", pa.int32()), ("k", pa.int32()), ("v", pa.string())]))
            kinds = [batch.column("item_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), slot]
            names = ["item_id", "n", "item_windows", "templates", "line", "ipos", "exact", "h", "islots"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(9)], names)

    rows = benchmark.select(F.col(item_col).alias("item_id"), text_of(text_col).alias("t"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.distinct().mapInArrow(cut, f"item_id {kind}, n int, item_windows int, templates int, line int, ipos int, exact boolean, h long, islots {SLOTS}")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 8, least: int = 5, enough: int = 6, filter_bits: int = 24) -> DataFrame:
    """Pairs of a document row and a benchmark item whose template it holds: doc_id, item_id, n_windows, item_windows, start_word, end_word, n_slots, n_changed, text_hash.

    A pair needs, along one alignment, enough common windows of window tokens (13 tokens in a row by default; all
    windows of a shorter item) and consistent slots. Windows are common if their words are the same but for case and
    punctuation at the edges, or their templates. A template is made twice: with capitalised words at the start of
    sentences as plain words, and as names; slots are judged for each, run by run of words that common windows cover: a
    run in which an item's value stands for two values is left out, with all its windows. Items of fewer than window
    tokens are one window. Windows with more placeholders than words and items of fewer than least tokens have no
    template, only their words: an item of one word is found wherever that word is. Null and blank texts match nothing. Of several alignments the longest is told, then the
    first. Repeated document rows give repeated pairs, repeated items one. Other columns are ignored. No benchmark or no
    documents: no rows.

    The benchmark may have any size: documents are first filtered through 2^filter_bits bits set by its windows, which is
    all that is broadcast; a full filter only lets more windows through to the join.
    """
    spark = docs.sparkSession
    bench = materialize(benchmark_windows(benchmark, item_col, item_text_col, window, least), "leak-items")
    bits, lengths = np.zeros(1 << filter_bits, bool), set()
    for r in bench.select("h", "n").distinct().toLocalIterator():  # one partition at a time; the bits have a fixed size
        bits[(r.h & 0xFFFFFFFFFFFFFFFF) >> (64 - filter_bits)] = True
        lengths.add(r.n)
    shared = spark.sparkContext.broadcast((np.packbits(bits, bitorder="little"), sorted(lengths)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, (packed, sizes) = Canon(), shared.value
        slot = pa.list_(pa.struct([("p", pa.int32()), ("k", pa.int32()), ("v", pa.string())]))
        for batch in slices(batches):
            row, pos, wins, slots = [], [], [], []
            for i, text in enumerate(as_bytes(batch.column("t"))):
                words = text.split()
                if not sizes or len(words) < sizes[0]:
                    continue
                exact, ((h, kind), (h_all, kind_all)) = canon.forms(words)
                for n in sizes:
                    if len(words) < n:
                        break
                    first, second = _windows(h, n), _windows(h_all, n)
                    for hashes, kinds, used in ((first, kind, _worded(kind, n)), (second, kind_all, _worded(kind_all, n) & (second != first)), (_windows(exact, n) ^ EXACT, None, True)):
                        key = hashes >> np.uint64(64 - filter_bits)
                        hit = np.flatnonzero((packed[key >> np.uint64(3)] >> (key & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & used)
                        if kinds is None and n < window and len(hit):  # whole items, told by their first place
                            hit = np.sort(hit[np.unique(hashes[hit], return_index=True)[1]])
                        if len(hit):
                            row += [i] * len(hit)
                            pos += hit.tolist()
                            wins += hashes[hit].astype(np.int64).tolist()
                            slots += [[] if kinds is None else _slots(words, kinds, j, n) for j in hit]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("rid", "doc_id", "text_hash")] + [pa.array(pos, pa.int32()), pa.array(wins, pa.int64()), pa.array(slots, slot)], ["rid", "doc_id", "text_hash", "pos", "h", "slots"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(cut, f"rid long, doc_id {kind}, text_hash long, pos int, h long, slots {SLOTS}")
    bench = small_enough(bench, 200, 8 << 20)
    pairs = F.expr("transform(islots, s -> struct(s.k AS k, s.v AS i, slots[array_position(transform(slots, d -> d.p - pos), s.p - ipos) - 1].v AS d))")
    line = ["rid", "doc_id", "text_hash", "item_id", "shift", "line"]
    same = found.join(bench, "h").withColumn("pairs", pairs).withColumn("shift", F.col("pos") - F.col("ipos"))
    order = Window.partitionBy(line).orderBy("ipos", "exact")
    same = same.withColumn("gap", F.when(F.col("ipos") - F.lag("ipos").over(order) > F.col("n"), 1).otherwise(0))
    same = same.withColumn("run", F.sum("gap").over(order))
    runs = same.groupBy(*line, "run").agg(
        F.size(F.collect_set("ipos")).alias("n_windows"),
        F.size(F.collect_set(F.when(~F.col("exact"), F.col("ipos")))).alias("n_templates"),
        F.min("item_windows").alias("item_windows"),
        F.min("templates").alias("templates"),
        F.min("pos").alias("start_word"),
        F.max(F.col("pos") + F.col("n")).alias("end_word"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    one_way = "size(array_distinct(transform(pairs, x -> struct(x.k, x.i)))) = size(pairs)"
    lines = runs.where(one_way).groupBy(line).agg(
        *[F.sum(x).alias(x) for x in ("n_windows", "n_templates")],
        *[F.min(x).alias(x) for x in ("item_windows", "templates", "start_word")],
        F.max("end_word").alias("end_word"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    lines = lines.where((F.col("n_windows") >= F.least(F.lit(enough), "item_windows")) | (F.col("n_templates") > 0) & (F.col("n_templates") >= F.least(F.lit(enough), "templates")))
    lines = lines.withColumns({"n_slots": F.size("pairs"), "n_changed": F.expr("size(filter(pairs, x -> x.i != x.d))")})
    names = ["n_windows", "start_word", "end_word", "n_slots", "n_changed", "item_windows"]
    best = F.max_by(F.struct(*names), F.struct("n_windows", -F.col("start_word"), -F.col("line")))
    out = lines.groupBy("rid", "doc_id", "text_hash", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", *[F.col(f"b.{x}").cast("long").alias(x) for x in names], "text_hash")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that ``find_leaks`` pairs with an item; all columns stay."""
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    leaks = small_enough(materialize(leaks, "leak-rows"), 32, 8 << 20)
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_of(text_col)) == F.col("__h")), "left_anti")
