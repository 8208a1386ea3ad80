"""Text of a page from its positioned items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = "array<struct<str:string,transform:array<double>,width:double,has_eol:boolean>>"

# Fixed values of the rules, as shares of the larger of two neighbours' font sizes: a step across the line, a gap along it; and the size where none is given.
ACROSS, GAP, SIZE = 0.5, 0.3, 12.0


def _placed(item: Column) -> dict[str, Column]:
    """What the separator before or after an item depends on; null where it has no place."""
    t = item["transform"]
    m = [F.get(t, F.lit(k)) for k in range(6)]
    along, across = F.hypot(m[0], m[1]), F.hypot(m[2], m[3])
    there = F.size(t) >= 6
    font = F.when(along > 0, along).when(across > 0, across).otherwise(SIZE)
    width = F.when(F.isnan(item["width"]), None).otherwise(item["width"])
    cols = {"x": m[4], "y": m[5], "ux": F.when(along > 0, m[0] / along).otherwise(1.0), "uy": F.when(along > 0, m[1] / along).otherwise(0.0), "font": font, "advance": F.coalesce(width, F.length(item["str"]) * font / 2)}
    return {k: F.when(there, c) for k, c in cols.items()}


def page_texts(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """pages (keys, items) -> keys, text: the items' texts in order, with what their places put between neighbours.

    A step across the line of writing, or an item that ends its line, puts a line break; a gap along it a blank; empty
    items that end lines a blank line. An item without a place is set off by a blank, and nothing is known about the gap
    after it. Items without text are left out. A page without items is empty. keys must tell pages apart.
    """
    rows = pages.select(*keys, F.posexplode("items").alias("at", "item")).where(F.col("item.str").isNotNull())
    w = Window.partitionBy(*keys).orderBy("at")
    ends = F.coalesce(F.col("item.has_eol"), F.lit(False))
    empty = F.col("item.str") == ""
    rows = rows.withColumn("blanks", F.sum((empty & ends).cast("int")).over(w)).where(~empty)
    rows = rows.withColumns(_placed(F.col("item")) | {"eol": F.coalesce(F.col("item.has_eol"), F.lit(False))})
    last = {c: F.lag(c).over(w) for c in ("x", "y", "ux", "uy", "font", "advance", "eol", "blanks", "at")}
    rows = rows.withColumns({f"last_{k}": c for k, c in last.items()})
    dx, dy, scale = F.col("x") - F.col("last_x"), F.col("y") - F.col("last_y"), F.greatest("font", "last_font")
    along, across = dx * F.col("last_ux") + dy * F.col("last_uy"), F.abs(dx * F.col("last_uy") - dy * F.col("last_ux"))
    blank = F.col("last_x").isNotNull() & (F.col("blanks") > F.col("last_blanks"))
    between = (
        F.when(F.col("last_at").isNull(), "")
        .when(F.col("x").isNull(), F.when(blank, "\n\n").otherwise(" "))
        .when(F.col("last_x").isNull(), "")
        .when(blank, "\n\n")
        .when(F.col("last_eol") | (across > ACROSS * scale), "\n")
        .when(along > F.col("last_advance") + GAP * scale, " ")
        .otherwise("")
    )
    parts = F.array_sort(F.collect_list(F.struct("at", "part")))
    made = rows.withColumn("part", F.concat(between, F.col("item.str"))).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("text"))
    return pages.select(*keys).join(made, list(keys), "left").withColumn("text", F.coalesce("text", F.lit("")))
