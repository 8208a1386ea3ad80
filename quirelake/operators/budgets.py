"""Budgets over ordered texts: prefix, skip, water-filling, history and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def prefix_budget(rows: DataFrame, by: str, order: list[Column], *, budget: int = 8000, text: str = "text") -> DataFrame:
    """Rows in order while their lengths fit; the first that doesn't fit ends the group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget).drop("used")


def skip_budget(groups: DataFrame, items: str, *, budget: int = 8000, gap: int = 0) -> DataFrame:
    """groups with an ordered array of structs (text, ..): items that would pass the budget are skipped, later ones may fit.

    What fits depends on all decisions before, so the array is folded inside one expression.
    """
    step = f"""aggregate({items}, struct(cast(0 AS long) AS used, filter({items}, x -> false) AS kept),
        (a, x) -> if(a.used + length(x.text) + {gap} <= {budget}, struct(a.used + length(x.text) + {gap} AS used, concat(a.kept, array(x)) AS kept), a)).kept"""
    return groups.withColumn("kept", F.expr(step))


def water_fill(rows: DataFrame, by: str, order: str, *, budget: int, text: str = "text", gap: int = 2) -> DataFrame:
    """allowed length of each text so that all of a group, gap characters between them, fit the budget: short ones whole, the rest equal shares.

    Sorted by length, a text is settled if it is at most an equal share of what the shorter ones leave.
    """
    w, all_ = Window.partitionBy(by).orderBy("len", order), Window.partitionBy(by)
    out = rows.withColumn("len", F.length(text).cast("long"))
    out = out.withColumns({"rank": F.row_number().over(w) - 1, "before": F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.count("*").over(all_), "total": F.sum("len").over(all_)})
    gaps = F.lit(gap) * (F.col("n") - 1)
    share = F.floor((F.greatest(F.lit(0), F.lit(budget) - gaps) - F.col("before")) / (F.col("n") - F.col("rank")))
    out = out.withColumn("share", share).withColumn("settled", F.col("len") <= F.col("share"))
    rest = F.min(F.when(~F.col("settled"), F.col("rank"))).over(all_)
    level = F.min(F.when(~F.col("settled"), F.struct("rank", "share"))).over(all_)["share"]
    whole = (F.col("total") + gaps <= budget) | rest.isNull() | (F.col("rank") < rest)
    return out.withColumn("allowed", F.when(whole, F.col("len")).otherwise(F.greatest(F.lit(0), F.least("len", level)))).drop("len", "rank", "before", "n", "total", "share", "settled")


def water_joined(rows: DataFrame, by: str, order: str, *, budget: int, label: str, text: str = "text", gap: str = "\n\n") -> DataFrame:
    """One text per group within the budget: what ``water_fill`` allows of each; a cut one loses a half citation and blanks at its end and gets an ellipsis. label: added last where any was cut."""
    filled = water_fill(rows, by, order, budget=budget, text=text, gap=len(gap))
    part = F.substring(F.col(text), F.lit(1), F.col("allowed").cast("int"))
    cut = F.length(text) > F.col("allowed")
    part = F.when(cut, F.concat(F.regexp_replace(T.strip_partial_citation(part), r"(?U)\s+\z", ""), F.lit("…"))).otherwise(F.col(text))
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t"))))
    joined = F.array_join(F.transform(got, lambda x: x["t"]), gap)
    return filled.groupBy(by).agg(F.concat(joined, F.when(F.max(cut), f"{gap}{label}").otherwise("")).alias("text"))


def drop_cancelled(messages: DataFrame, by: str, order: str) -> DataFrame:
    """Without cancelled answers and the questions right before them."""
    nxt = F.lead("cancelled").over(Window.partitionBy(by).orderBy(order))
    return messages.withColumn("gone", F.col("cancelled") | ((F.col("role") == "user") & F.coalesce(nxt, F.lit(False)))).where(~F.col("gone")).drop("gone")


def trim_history(messages: DataFrame, by: str, order: str, *, budget: int = 4000, text: str = "text") -> DataFrame:
    """The newest messages that fit the budget (a separator each); the newest always stays."""
    w = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    rows = messages.withColumns({"used": F.sum(F.length(text) + 1).over(w), "newest": first})
    return rows.where((F.col("used") <= budget) | (F.col("newest") == 1)).drop("used", "newest")


def format_history(messages: DataFrame, by: str, order: str, *, budget: int = 4000) -> DataFrame:
    """One text per conversation under a header: cancelled pairs dropped, each message with its role and without marks that prompts use, trimmed to the budget."""
    name = F.when(F.col("role") == "user", "Q: ").otherwise("A: ")
    lines = drop_cancelled(messages, by, order).withColumn("line", F.concat(name, T.sanitize_prompt(F.col("text"))))
    kept = trim_history(lines, by, order, budget=budget, text="line")
    got = F.array_sort(F.collect_list(F.struct(order, "line")))
    return kept.groupBy(by).agg(F.concat(F.lit(f"\n{T.SECTIONS[1]}\n"), F.array_join(F.transform(got, lambda x: x["line"]), "\n"), F.lit("\n")).alias("history"))


def retain(messages: DataFrame, by: str, order: str, most: int = 20) -> DataFrame:
    """The last most messages, dropped in even counts so that pairs stay whole."""
    w = Window.partitionBy(by)
    rows = messages.withColumns({"n": F.count("*").over(w), "at": F.row_number().over(w.orderBy(order)) - 1})
    gone = F.when(F.col("n") > most, F.ceil((F.col("n") - most) / 2) * 2).otherwise(0)
    return rows.where(F.col("at") >= gone).drop("n", "at")


def evict(entries: DataFrame, key: str, *, most: int, most_bytes: int, pinned: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """entries with evicted: the least recently used go until counts and bytes fit; pinned keys never go.

    Prefix sums over the unpinned entries in order of use decide. With by, each of its groups has limits of its own; without,
    one store (a bounded manifest) is ordered as a whole.
    """
    rows = entries.withColumn("pin", F.lit(False)) if pinned is None else entries.join(pinned.select(key).distinct().withColumn("pin", F.lit(True)), key, "left").withColumn("pin", F.coalesce("pin", F.lit(False)))
    all_ = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    before = all_.orderBy("pin", "last_accessed", key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"n": F.count("*").over(all_), "b": F.sum("byte_size").over(all_), "n0": F.count("*").over(before), "b0": F.coalesce(F.sum("byte_size").over(before), F.lit(0))})
    over = (F.col("n") - F.col("n0") > most) | (F.col("b") - F.col("b0") > most_bytes)
    return rows.withColumn("evicted", ~F.col("pin") & over).drop("pin", "n", "b", "n0", "b0")


def member_blocks(members: DataFrame, by: str, order: str, *, total: int = 12_000, least: int = 200, summary: int = 3000, excerpt: int = 1500, most: int = 10) -> DataFrame:
    """Blocks of a group's members (file_name, summary, text) within one budget, which labels of citations count against.

    A member's summary (or excerpt) is cut to what is left, loses a cut citation at its end, and gets its document's name
    into bare citations; the qualified length is spent, so the budget may end below zero. Under least nothing more is added.
    """
    raw = F.when(T.trim(F.coalesce("summary", F.lit(""))) != "", F.substring("summary", 1, summary)).otherwise(F.substring(F.coalesce("text", F.lit("")), 1, excerpt))
    got = F.slice(F.array_sort(F.collect_list(F.struct(order, "file_name", T.doc_label(F.col("file_name")).alias("label"), raw.alias("raw")))), 1, most)
    rows = members.groupBy(by).agg(got.alias("ms"))
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    cut = f"regexp_replace(substring(m.raw, 1, cast(a.left AS int)), '{quote(T.PARTIAL_CITATION)}', '')"
    full = f"regexp_replace({cut}, '{quote(T.BARE_CITATION)}', concat('[', regexp_replace(m.label, '([\\\\\\\\$])', '\\\\\\\\$1'), ' p.$1]'))"
    fold = f"""aggregate(ms, struct(cast({total} AS long) AS left, cast(array() AS array<struct<file_name:string,body:string>>) AS out),
        (a, m) -> if(a.left < {least} OR trim(m.raw) = '', a, struct(a.left - length({full}) AS left, concat(a.out, array(struct(m.file_name AS file_name, {full} AS body))) AS out)))"""
    return rows.withColumn("r", F.expr(fold)).select(by, F.col("r.out").alias("blocks"), F.col("r.left").alias("left"))
