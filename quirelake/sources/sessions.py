"""Sources and sinks of the document store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 100 << 20
SCHEMA_VERSION = 1
SESSION = "schema_version int, doc_hash string, file_name string, file_path string, page_texts array<string>, summaries map<string,struct<content:string,model:string,provider:string>>, qa_messages array<struct<id:string,role:string,content:string>>, embed_model string, embed_dim int, chunk_meta array<struct<text:string,index:int,page_start:int>>"
COLLECTIONS = "schema_version int, collections array<struct<id:string,name:string,doc_hashes:array<string>,created_at:string,last_accessed:string>>"


def is_pdf(content: Column, most: int = MOST_BYTES) -> Column:
    """Not too large, and the magic within the first 1024 bytes."""
    return (F.length(content) <= most) & F.contains(F.substring(content, 1, 1024), F.unhex(F.lit("255044462D")))


def read_pdfs(spark: SparkSession, path: str, parser) -> DataFrame:
    """pages (path, page, text) of the PDF files below path; parser(bytes) gives their pages' texts. Files that fail have none.

    Only a parser is missing for real files; what is not a PDF or too large is left out by the size and magic checks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("length") <= MOST_BYTES).where(is_pdf(F.col("content")))

    def pages(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, data in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows += [(name, i + 1, t) for i, t in enumerate(parser(bytes(data)))]
                except Exception:
                    continue  # a broken file is skipped, the others stay
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(pages, "path string, page int, text string")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session files, one JSON object each; unreadable ones are skipped, unknown versions keep texts but no index."""
    rows = spark.read.schema(SESSION + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where(F.col("_bad").isNull() & F.col("doc_hash").rlike("^[a-f0-9]{64}$")).drop("_bad")
    known = F.col("schema_version") == SCHEMA_VERSION
    return rows.withColumns({c: F.when(known, F.col(c)) for c in ("embed_model", "embed_dim", "chunk_meta")})


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Collections of the known version; a newer file is refused."""
    rows = spark.read.schema(COLLECTIONS).option("multiLine", True).json(path)
    newer = rows.where(F.col("schema_version") > SCHEMA_VERSION).limit(1).count()
    if newer:
        raise ValueError("the collections file has a newer version")
    return rows.select(F.explode("collections").alias("c")).select("c.*").where((F.length("id") > 0) & (F.length(F.trim("name")) > 0))


def save_table(rows: DataFrame, path: str) -> None:
    """Replaces a table; Spark's committer makes the new files visible at the end."""
    rows.write.mode("overwrite").parquet(path)


def save_markdown(rows: DataFrame, path: str) -> None:
    """rows (file_name, text) as text files by name; only .md and .txt names."""
    good = rows.where(F.col("file_name").rlike(r"(?i)\.(md|txt)$"))
    good.select("file_name", F.col("text").alias("value")).write.mode("overwrite").partitionBy("file_name").text(path)


def html_page(title: Column, body: Column, lang: Column) -> Column:
    """A summary as an HTML page; the title is escaped, an odd language becomes ko."""
    safe = title
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    code = F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("ko")
    return F.concat(F.lit('<!doctype html><html lang="'), code, F.lit('"><head><meta charset="utf-8"><title>'), safe, F.lit("</title></head><body>"), body, F.lit("</body></html>"))
