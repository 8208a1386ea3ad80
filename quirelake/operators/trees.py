"""Heading trees and outlines as adjacency lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

# Fixed value: a heading of a Markdown text, its signs and its title.
HEADING = r"^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*\z"


def heading_tree(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page as the line's number, text) -> doc_id, line, level, title, parent (line or null), cited_page, cited_doc.

    Headings inside code fences don't count; if a text's last fence never closes, no fence counts. Up to three blanks may
    stand before a heading, and number signs at its end. The parent is the nearest earlier heading of a lesser level: the
    running line numbers of each level give it without a self-join. cited_page and cited_doc: the first citation between
    the heading and the next one, if its page is 1 or more.
    """
    w, all_ = Window.partitionBy("doc_id").orderBy("page"), Window.partitionBy("doc_id")
    fence = F.col("text").rlike(r"^\s*(```|~~~)").cast("int")
    rows = lines.withColumn("fence", fence).withColumn("open", F.sum("fence").over(w)).withColumn("total", F.sum("fence").over(all_))
    closed = F.col("total") % 2 == 0
    inside = closed & ((F.col("open") % 2 == 1) | (F.col("fence") == 1))
    level = F.when(inside, 0).otherwise(F.length(F.regexp_extract("text", HEADING, 1)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("level") > 0, F.col("page"))
    cited = F.when(F.col("text").rlike(T.CITATION), F.struct(F.regexp_extract("text", T.CITATION, 2).cast("long").alias("page"), F.regexp_extract("text", T.CITATION, 1).alias("doc")))
    rows = rows.withColumn("level", level).withColumns({"section": F.max(at).over(w), "cited": cited})
    first = F.first("cited", ignorenulls=True).over(Window.partitionBy("doc_id", "section").orderBy("page").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    seen = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("page"))).over(before)) for k in range(1, 6)]
    rows = rows.withColumns({"cited": first, "parent": F.greatest(*seen)}).where("level > 0")
    good = F.col("cited.page") >= 1
    title = T.clean_title(F.regexp_extract("text", HEADING, 2))
    return rows.select("doc_id", F.col("page").alias("line"), "level", title.alias("title"), "parent", F.when(good, F.col("cited.page")).alias("cited_page"), F.when(good & (F.col("cited.doc") != ""), T.trim(F.col("cited.doc"))).alias("cited_doc"))


def outline(items: DataFrame, *, depth: int = 4, most: int = 500) -> DataFrame:
    """items (doc_id, id, parent, title, page, pos) -> the outline's rows with their level, in reading order.

    Levels below depth and items past most in pre-order are left out, as the outline's definition says; a title of blanks
    becomes a dash, an item without title, page and children goes.
    """
    path = lambda prefix: F.concat(prefix, F.lpad(F.col("pos").cast("string"), 9, "0"), F.lit("/"))
    kids = items.where("parent IS NOT NULL").select("doc_id", F.col("parent").alias("id")).distinct().withColumn("has", F.lit(True))
    rows = items.join(kids, ["doc_id", "id"], "left")
    level = rows.where("parent IS NULL").withColumn("level", F.lit(1)).withColumn("path", path(F.lit("")))
    out = level
    for n in range(2, depth + 1):
        up = level.select("doc_id", F.col("id").alias("parent"), F.col("path").alias("up"))
        level = rows.join(up, ["doc_id", "parent"]).withColumn("level", F.lit(n)).withColumn("path", path(F.col("up"))).drop("up")
        out = out.unionByName(level)
    blank = T.trim(F.coalesce("title", F.lit(""))) == ""
    out = out.where(~(blank & F.col("page").isNull() & F.col("has").isNull()))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "id", "parent", "level", F.when(blank, "—").otherwise(T.trim(F.col("title"))).alias("title"), "page", "rank")


_CODE = re.compile(r"(```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`)", re.S)
_OPEN, _SOLID, _BREAK = re.compile(r"\\\\|\\\(|\\\["), re.compile(r"\S"), re.compile(r"\n[ \t]*\n")
_CITED = re.compile(r"(?:[^\[\]|\n]{1,120}?\s+)?p\.\s*\d+(?:\s*\|\s*[^\]\n]{0,200})?\s*", re.I)


class _Next:
    """Where something is found next at or after a place; searches on from the last find only, so a text is read once."""

    def __init__(self, find):
        self.find, self.at = find, -1

    def __call__(self, start: int) -> int:
        if self.at is not None and self.at < start:
            at = self.find(start)
            self.at = None if at < 0 else at
        return 1 << 60 if self.at is None else self.at


def _plain(text: str, around: tuple[str, str], marks: bool) -> str:
    """around: the characters before and after the part. marks: with dollar marks, else without any."""
    searched = lambda p: lambda i: m.start() if (m := p.search(text, i)) else -1
    pairs = {"\\(": (_Next(lambda i: text.find("\\)", i)), _Next(lambda i: text.find("\n", i))), "\\[": (_Next(lambda i: text.find("\\]", i)), _Next(searched(_BREAK)))}
    dollar, solid = _Next(lambda i: text.find("$", i)), _Next(searched(_SOLID))
    out, done, at = [], 0, 0
    while m := _OPEN.search(text, at):
        at = m.end()
        if m.group() not in pairs:
            continue
        close, ends = pairs[m.group()]
        end = close(at)
        if end >= len(text) or solid(at) >= end or dollar(at) < end or ends(at) < end:
            continue
        before, after = text[m.start() - 1] if m.start() else around[0], text[end + 2 : end + 3] or around[1]
        if "$" in (before, after) or end - at <= 400 and _CITED.fullmatch(text, at, end):
            continue
        mark = "$$" if marks else ""
        out += [text[done : m.start()], mark, text[at:end], mark]
        done = at = end + 2
    return "".join([*out, text[done:]])


def math_marks(text: str, marks: bool = True) -> str:
    """LaTeX brackets as dollar marks (or gone, if marks is false) outside code.

    They stay if they hold nothing, a dollar sign, a citation, or a break they can't span (a line's end in round ones, a
    blank line in square ones), or touch a dollar sign. The time is linear in the text.
    """
    parts = _CODE.split(text)
    return "".join(p if i % 2 else _plain(p, ("", ""), marks) for i, p in enumerate(parts))


@F.pandas_udf(StringType())
def math_normalized(texts: pd.Series) -> pd.Series:
    """``math_marks`` for a column."""
    return texts.map(math_marks, na_action="ignore")


@F.pandas_udf(StringType())
def math_stripped(texts: pd.Series) -> pd.Series:
    """A column without math brackets, where nothing sets them."""
    return texts.map(lambda t: math_marks(t, marks=False), na_action="ignore")
