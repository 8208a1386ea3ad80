"""What the classifiers share: which labelled rows they may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, materialize, small_enough, text_of


def held_out(id_col: str, folds: int) -> Column:
    """Rows of the held-out fold: crc32 of the id as text is 0 modulo folds (a null id is held out)."""
    return bucket_of(id_col, folds) == 0


def training_rows(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, label_col: str, *, folds: int, most: int, seed: int, per_label: bool = False, most_bytes: int = 96 << 20) -> DataFrame:
    """Texts (t) and labels (y) of at most most labelled rows outside the held-out fold (of each label value if per_label).

    The sample is the rows with the smallest seeded hashes of their ids, so it is the same in each run; it ends where the
    next text would take it over most_bytes (of a label value, half of it). A null label is no label. With labels None, label_col is a column of docs. Of ids labelled twice the largest label counts.
    """
    have = (docs if labels is None else labels).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds))
    have = have.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    have = have.withColumn("h", F.xxhash64(F.lit(seed), F.col("id").cast("string")))
    if per_label:
        counts = small_enough(materialize(have.groupBy(F.col("y").alias("of")).agg(F.count("*").alias("n")), "learn-counts"), 64, 4 << 20)
        # a frequent label's rows are thinned before they meet, to about twice what is taken
        near = F.col("h") / F.lit(2.0**64) + 0.5 <= (2.0 * most + 50) / F.col("n")
        have = have.join(counts, F.col("y") == F.col("of")).where(near).withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("h", "id"))).where(F.col("rank") <= most)
    else:
        have = have.orderBy("h", "id").limit(most)
    chosen = small_enough(materialize(have.select("id", "y", "h"), "learn-rows"), 64, 16 << 20)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    sizes = materialize(texts.join(chosen, "id").groupBy("id").agg(F.max("y").alias("y"), F.max("h").alias("h"), F.sum(F.octet_length("t")).alias("size")), "learn-sizes")
    held = F.sum("size").over(Window.partitionBy("y").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = small_enough(materialize(sizes.withColumn("held", held).where(F.col("held") <= most_bytes // 2).select("id", "y"), "learn-rows"), 64, 16 << 20)
    return texts.join(chosen, "id").select("id", "t", "y")
