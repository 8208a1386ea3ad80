"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length; per source the count of documents to take of each length is fitted to the budget
(an even share of every length, then a bounded-knapsack programme for the last words), and seeded documents fill it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of


#: Words that the knapsack fits at most: a megabyte for each set of reachable sums.
MOST_WORDS = 1 << 23


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Budgets by weight; none is above most times its source's size, the excess goes to the others by weight."""
    budget, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if budget * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = budget * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        budget = max(0.0, budget - sum(out[i] for i in over))
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to budget without passing it.

    First every length gives its even share, rounded so that the error never piles up, then the longest that fit go on
    until about window words are left (or twice the longest text, MOST_WORDS at most): a bounded knapsack over what is
    left, solved exactly by reachable sums. Of these,
    one in as many is kept as there are kept at a time, and those between are made again on the way back.
    """
    order = np.argsort(-lengths)
    size, left, take = lengths[order].astype(int), counts[order].astype(int), np.zeros(len(order), int)
    budget, total = int(budget), int((size * left).sum())
    if budget >= total:
        return counts.copy()
    window = min(budget, max(window, min(2 * int(size[0]), MOST_WORDS)))
    ratio, seen, got = (budget - window) / max(1, total), 0.0, 0
    for i, s in enumerate(size):
        if s:
            seen += ratio * s * left[i]
            take[i] = min(left[i], max(0, int((seen - got) // s)))
            got += int(take[i]) * int(s)
    left -= take
    rest = budget - got
    for i, s in enumerate(size):
        if s and rest > window:
            n = min(int(left[i]), (rest - window) // int(s))
            take[i], left[i], rest = take[i] + n, left[i] - n, rest - n * int(s)
    steps, full = [], (1 << (rest + 1)) - 1
    for i, s in enumerate(size):
        k = 1
        while s and left[i] > 0 and k * s <= rest:
            n = min(k, int(left[i]))
            steps.append((i, n * int(s), n))
            left[i] -= n
            k *= 2
    every, kept, reach = max(1, math.isqrt(len(steps))), [], 1
    for j, (_, words, _) in enumerate(steps):
        if j % every == 0:
            kept.append(reach)
        if reach >> rest & 1:
            steps = steps[:j]
            break
        reach |= (reach << words) & full
    at = reach.bit_length() - 1
    for block in range(-(-len(steps) // every) - 1, -1, -1):
        part, sums = steps[block * every : (block + 1) * every], [kept[block]]
        for _, words, _ in part[:-1]:
            sums.append(sums[-1] | (sums[-1] << words) & full)
        for (i, words, n), before in zip(reversed(part), reversed(sums), strict=True):
            if not before >> at & 1:
                take[i] += n
                at -= words
    out = np.zeros(len(order), int)
    out[order] = take
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7, window: int = 1 << 16, group: int = 4096) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    Sources in order of code points, a null source last, have the weights in turn. share: words of the mix for a word of
    the input. most: a target stops at so many times its source's words. A source whose target passes its size is taken
    whole as often as it fits, then in part. Sizes count words between ASCII blanks; a null text has size 0 and takes
    none. The choice among documents of one length depends on seed and id only, so reruns agree; repeated rows count as
    rows of their own. An empty table gives no rows. window: words that the knapsack fits; group: rows of one length
    that are sorted together at most, on average.

    Source totals (a row per source, as there is a weight for each) go to the driver; histograms stay distributed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    rows = materialize(rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")) / F.lit(2.0**64) + 0.5), "mix-rows")
    counts = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.max("n").alias("x")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.s for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    plan = spark.createDataFrame([(r.source, r.s, t) for r, t in zip(totals, goal, strict=True)], "source string, source_size long, target double")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        whole = int(target // size) if size else 0
        some = fit(pdf["size"].to_numpy(), pdf.n.to_numpy(), round(target - whole * size), window)
        return pd.DataFrame({"source": pdf.source, "size": pdf["size"], "whole": whole, "some": some, "source_size": size, "target": target, "parts": -(-pdf.n // group)})

    same = rows["source"].eqNullSafe(F.col("p.source"))
    takes = counts.join(F.broadcast(plan.alias("p")), counts["source"].eqNullSafe(F.col("p.source"))).select(counts["source"], "size", "n", "source_size", "target")
    takes = materialize(takes.groupBy("source").applyInPandas(fitted, "source string, size long, whole long, some long, source_size long, target double, parts long"), "mix-takes")
    at = rows.alias("r").join(takes.alias("p"), same & (rows["size"] == F.col("p.size")))
    at = at.select("doc_id", "r.source", "r.size", "h", "whole", "some", "source_size", "target", F.floor(F.col("h") * F.col("parts")).alias("part"))
    key = ("source", "size")
    sums = at.groupBy(*key, "part").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("need", F.coalesce(before, F.lit(0))).alias("s")
    on = F.col("a.source").eqNullSafe(F.col("s.source")) & (F.col("a.size") == F.col("s.size")) & (F.col("a.part") == F.col("s.part"))
    placed = at.alias("a").join(sums, on).select("a.*", "here", (F.col("some") - F.col("need")).alias("need"))
    sure = placed.where("need <= 0 or need >= here").withColumn("more", F.when(F.col("need") > 0, 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy(*key, "part").orderBy("h", "doc_id"))
    edge = placed.where("need > 0 and need < here").withColumn("more", F.when(rank <= F.col("need"), 1).otherwise(0))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0)
    return sure.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
