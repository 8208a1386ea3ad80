"""Pages, chapters, labels and page attribution."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

def page_offsets(pages: DataFrame) -> DataFrame:
    """offset of each page in its document's text, pages joined by a blank line."""
    before = F.sum(F.length("text") + 2).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("offset", F.coalesce(before, F.lit(0)))


def page_at(offsets: DataFrame, places: DataFrame) -> DataFrame:
    """As-of lookup: places (doc_id, at) with the page that holds them (the last that starts at or before).

    Both sides meet in one sorted pass per document, so no pair is formed.
    """
    marks = offsets.select("doc_id", F.col("offset").alias("at"), "page", F.lit(0).alias("kind"))
    asked = places.select("doc_id", "at", F.lit(None).cast("int").alias("page"), F.lit(1).alias("kind"))
    w = Window.partitionBy("doc_id").orderBy("at", "kind", "page").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn("page", F.last("page", ignorenulls=True).over(w)).where("kind = 1").select("doc_id", "at", "page")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\n+"), lambda p: T.trim(p) != "")


def label_pages(pages: DataFrame, *, segment: int = 1500, offset: int = 0) -> DataFrame:
    """One labelled text per document: ``[p.N] `` before each paragraph (and each further segment of a long one)."""
    pieces = F.flatten(F.transform(paragraphs(F.col("text")), lambda p: T.split_points(p, segment)))
    label = F.concat(F.lit("[p."), (F.col("page") + offset).cast("string"), F.lit("] "))
    rows = pages.select("doc_id", "page", F.array_join(F.transform(pieces, lambda p: F.concat(label, T.trim(p))), "\n\n").alias("t")).where("t <> ''")
    return joined(rows, "doc_id", "page", "t").withColumnRenamed("t", "labelled")


def joined(rows: DataFrame, by: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Ordered string aggregation."""
    got = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(by).agg(F.array_join(F.transform(got, lambda x: x[text]), separator).alias(text))


def empty_pages(pages: DataFrame) -> DataFrame:
    """Blank pages of each document, whether they are significant, and whether recognition is needed for want of text."""
    solid = T.solid_length(F.col("text"))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.when(solid == 0, 1).otherwise(0)).alias("n_empty"), F.sum(solid).alias("solid"))
    return out.withColumns({"significant": (F.col("n_empty") >= 2) & (F.col("n_empty") / F.col("n_pages") > 0.1), "needs_ocr": F.col("solid") < 50})


def mask_pages(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages outside the range (clamped, swapped if needed) become empty and keep their numbers."""
    n = F.max("page").over(Window.partitionBy("doc_id"))
    a, b = (F.greatest(F.lit(1), F.least(n, F.lit(x))) for x in sorted((first, last)))
    return pages.withColumn("text", F.when((F.col("page") >= a) & (F.col("page") <= b), F.col("text")).otherwise(""))


def clip_chapters(chapters: DataFrame, first: int, last: int) -> DataFrame:
    """Chapters that overlap the range, cut to it."""
    kept = chapters.where((F.col("start_page") <= last) & (F.col("end_page") >= first))
    return kept.withColumns({"start_page": F.greatest("start_page", F.lit(first)), "end_page": F.least("end_page", F.lit(last))})


def fallback_chapters(pages: DataFrame, size: int = 10) -> DataFrame:
    """Chapters of size pages each."""
    return pages.groupBy("doc_id", F.floor((F.col("page") - 1) / size).alias("chapter")).agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))


def detect_chapters(pages: DataFrame) -> DataFrame:
    """Chapters by headings on first lines: doc_id, chapter, title, start_page, end_page.

    A running heading (the key of the last accepted one) and a number that doesn't grow within its unit start nothing; so
    each decision hangs on the last accepted heading, and candidates (few) are folded per document. Documents without a
    heading fall back to ten pages each.
    """
    head = T.trim(F.split(T.trim(F.col("text")), "\n", -1)[0])
    korean = lambda i: F.regexp_extract("head", r"^제?\s*(\d+)\s*([장절])", i)
    english = F.regexp_extract("head", r"(?i)^chapter\s*(\d+)", 1)
    rows = pages.select("doc_id", "page", head.alias("head")).where(F.col("head").rlike(T.HEADING) & ~F.col("head").rlike(T.TOC_LINE))
    number = F.when(korean(1) != "", korean(1)).when(english != "", english).cast("long")
    unit = F.when(korean(1) != "", korean(2)).when(english != "", "chapter")
    rows = rows.select("doc_id", F.struct("page", F.substring("head", 1, 80).alias("title"), T.heading_key(F.col("head")).alias("key"), number.alias("num"), unit.alias("unit")).alias("h"))
    found = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, hs in zip(pdf.doc_id, pdf.hs, strict=True):
                last, n = None, 0
                for h in hs:
                    same = last is not None and (h["key"] == last["key"] or (h["num"] is not None and last["num"] is not None and h["unit"] == last["unit"] and h["num"] <= last["num"]))
                    if not same:
                        out.append((doc, n, h["title"], 1 if n == 0 else h["page"]))
                        last, n = h, n + 1
            yield pd.DataFrame(out, columns=["doc_id", "chapter", "title", "start_page"])

    made = found.mapInPandas(fold, "doc_id long, chapter int, title string, start_page int")
    count = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    nxt = F.lead("start_page").over(Window.partitionBy("doc_id").orderBy("chapter"))
    headed = made.join(count, "doc_id").select("doc_id", "chapter", "title", "start_page", F.coalesce(nxt - 1, "n_pages").cast("int").alias("end_page"))
    plain = fallback_chapters(pages.join(found.select("doc_id"), "doc_id", "left_anti"))
    return headed.unionByName(plain.select("doc_id", F.col("chapter").cast("int"), F.lit(None).cast("string").alias("title"), "start_page", F.col("end_page").cast("int").alias("end_page")))


def chapter_texts(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Each chapter's pages joined: pages take their chapter as of their number."""
    starts = chapters.select("doc_id", F.col("start_page").alias("page"), "chapter", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"))
    rows = pages.select("doc_id", "page", F.lit(None).cast("int").alias("chapter"), "text", F.lit(1).alias("kind"))
    w = Window.partitionBy("doc_id").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = starts.unionByName(rows).withColumn("chapter", F.last("chapter", ignorenulls=True).over(w)).where("kind = 1")
    got = F.array_sort(F.collect_list(F.struct("page", "text")))
    return rows.groupBy("doc_id", "chapter").agg(F.array_join(F.transform(got, lambda x: x["text"]), "\n\n").alias("text"))


def enrich_pages(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Image notes (doc_id, page, pos, note) as lines below their page's text."""
    lines = joined(notes.withColumn("key", F.struct("doc_id", "page")).withColumn("line", F.concat(F.lit("[이미지 분석: "), "note", F.lit("]"))), "key", "pos", "line", "\n")
    lines = lines.select("key.doc_id", "key.page", "line")
    return pages.join(lines, ["doc_id", "page"], "left").select("doc_id", "page", F.concat_ws("\n", "text", "line").alias("text"))


def dedupe_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; only keys and order decide, so a struct minimum replaces a sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])
