"""Citations: parsing, placement, and resolution against open documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# A bare citation in round brackets, what may stand before and between citations alone on a line, a closing mark.
WRAPPED = r"(?i)\(\s*(\[p\.\s*\d+(?:\s*\|\s*[^\]]*?)?\s*\])\s*\)"
LEAD, BETWEEN, CLOSING = r"(?U)^[\s\-*•]+", r"(?U)^[\x00\s.,]*\z", r"(?U)[.!?。！？]\s*\z"


def place(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): citations on lines of their own go to the end of the last line before that isn't blank, in front of its closing mark.

    Where no such line stands before, they stay, without what surrounded them, and are that line for those that follow.
    Bare citations lose round brackets around them. Lines are classed each by itself; a running maximum finds the line
    that citations go to. id must be unique; a null text stays null.
    """
    lines = F.posexplode(F.split(F.regexp_replace(F.col(text_col), WRAPPED, "$1"), "\n", -1)).alias("at", "line")
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), lines)
    body = F.regexp_replace("line", LEAD, "")
    left = F.regexp_replace(body, T.CITATION, "\0")
    alone = left.contains("\0") & left.rlike(BETWEEN)
    cited = F.array_join(F.regexp_extract_all("line", F.lit(T.CITATION), 0), "")
    w = Window.partitionBy("id").orderBy("at")
    solid = F.length(T.trim(F.col("line"))) > 0
    rows = rows.withColumns({"alone": alone, "cited": F.when(alone, cited), "solid": solid})
    rows = rows.withColumn("first", F.col("solid") & (F.sum(F.col("solid").cast("int")).over(w) == 1))
    stays = ~F.col("alone") | F.col("first")
    rows = rows.withColumn("to", F.max(F.when(stays & (F.col("solid") | F.col("alone")), F.col("at"))).over(w))
    rows = rows.withColumn("to", F.when(stays, F.col("at")).otherwise(F.col("to")))
    line = F.max(F.when(F.col("to") == F.col("at"), F.when(F.col("alone"), F.col("cited")).otherwise(F.col("line"))))
    moved = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("to") != F.col("at"), F.struct("at", "cited")))), lambda x: x["cited"]), "")
    merged = rows.groupBy("id", "to").agg(line.alias("line"), moved.alias("moved"))
    end = F.regexp_extract("line", CLOSING, 0)
    merged = merged.withColumn("line", F.when(F.col("moved") == "", F.col("line")).otherwise(F.concat(F.expr("left(line, length(line) - length(regexp_extract(line, '" + CLOSING.replace("\\", "\\\\") + "', 0)))"), "moved", end)))
    got = F.array_sort(F.collect_list(F.struct("to", "line")))
    out = merged.groupBy("id").agg(F.array_join(F.transform(got, lambda x: x["line"]), "\n").alias("text")).withColumnRenamed("id", id_col)
    return out.unionByName(texts.where(F.col(text_col).isNull()).select(id_col, F.lit(None).cast("string").alias("text")))


def parse(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, page, doc) of each citation in order."""
    return texts.select(id_col, F.posexplode(T.citations(F.col(text_col))).alias("n", "c")).select(id_col, "n", "c.page", "c.doc")


def segments(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, kind, content, page, doc): each text cut at its citations; a citation of page 0 stays text."""
    valid = T.CITATION.replace(r"(\d+)", r"(0*[1-9]\d*)")
    parts = F.split(F.regexp_replace(F.col(text_col), f"({valid})", "\0$1\0"), "\0", -1)
    rows = texts.select(id_col, F.posexplode(parts).alias("n", "content")).where("content <> ''").withColumn("cited", F.col("n") % 2 == 1)
    page, doc = F.regexp_extract("content", valid, 2).try_cast("long"), F.regexp_extract("content", valid, 1)
    return rows.select(id_col, "n", F.when(F.col("cited"), "citation").otherwise("text").alias("kind"), F.when(~F.col("cited"), F.col("content")).alias("content"), F.when(F.col("cited"), page).alias("page"), F.when(F.col("cited") & (doc != ""), doc).alias("doc"))


def resolve(cited: DataFrame, tabs: DataFrame) -> DataFrame:
    """cited (.., page, doc) -> state and target: bare, ok, ambiguous, closed or invalid, by the open tabs' labels (file_name, page_count, doc_hash)."""
    by_label = tabs.groupBy(T.doc_label(F.col("file_name")).alias("label")).agg(F.count("*").alias("n_tabs"), F.min("doc_hash").alias("target"), F.min("page_count").alias("pages"))
    out = cited.join(by_label, F.col("doc") == F.col("label"), "left")
    state = F.when(F.col("doc").isNull(), "bare").when(F.col("n_tabs").isNull(), "closed").when(F.col("n_tabs") > 1, "ambiguous").when(F.col("page") > F.col("pages"), "invalid").otherwise("ok")
    return out.withColumn("state", state).withColumn("target", F.when(F.col("state") == "ok", F.col("target"))).drop("label", "n_tabs", "pages")
