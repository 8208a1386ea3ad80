"""Retrieval contexts and the question pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budgets as B
from ..operators import chunking as C
from ..operators import search as S
from ..operators.prompts import Embedder, Generator, build_prompts


def context(hits: DataFrame, by: str, *, budget: int = 8000, named: bool = False) -> DataFrame:
    """hits (by, rank, doc, idx, text, page[, file_name]) -> one context per group: labelled segments in order of rank while they fit (others are skipped), then in document order."""
    page = F.coalesce(T.page_label(F.col("page")), F.lit(""))
    if named:
        inner = F.when(F.col("page") >= 1, F.concat(F.lit(" p."), F.col("page").cast("string"))).otherwise("")
        label = T.doc_label(F.col("file_name"))
        page = F.when(label != "", F.concat(F.lit("["), label, inner, F.lit("]"))).otherwise(page)
    segment = F.when(F.lit(named) | (page != ""), F.concat(page, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    rows = hits.withColumn("segment", segment).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "idx", F.col("segment").alias("text")))).alias("items"))
    kept = B.skip_budget(rows, "items", budget=budget)
    sorted_ = F.array_sort(F.transform("kept", lambda x: F.struct(x["doc"], x["idx"], x["text"])))
    return kept.select(by, F.array_join(F.transform(sorted_, lambda x: x["text"]), "\n\n").alias("context")).where("context <> ''")


def keyword_context(docs: DataFrame, question: str, *, budget: int = 8000, size: int = 500) -> DataFrame:
    """docs (doc_id, text) -> context without vectors: a short text whole, else its chunks with most keywords, in document order.

    Chunks are taken by score while the budget holds and the score is positive; the first that fails ends it. With
    nothing taken (or no keyword) the first and last chunk stand in, cut to the budget; so does an only chunk, whatever
    its score.
    """
    text = F.coalesce("text", F.lit(""))
    short = docs.where(F.length(text) <= budget).select("doc_id", text.alias("context"))
    long = docs.where(F.length(text) > budget)
    chunks = C.chunk_documents(long, size)
    words = T.keywords(F.lit(question))
    scored = S.chunk_keyword_scores(chunks, words)
    w = Window.partitionBy("doc_id")
    run = w.orderBy(F.desc("score"), "chunk").rowsBetween(Window.unboundedPreceding, 0)
    scored = scored.withColumns({"used": F.sum(F.length("text")).over(run), "n": F.count("*").over(w)})
    scored = scored.withColumn("taken", (F.col("n") > 1) & (F.col("score") > 0) & (F.col("used") <= budget)).withColumn("any", F.max("taken").over(w))
    kept = scored.where(F.col("taken") | (~F.col("any") & ((F.col("chunk") == 0) | (F.col("chunk") == F.col("n") - 1))))
    got = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    made = kept.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(got, lambda x: x["text"]), "\n\n"), 1, budget).alias("cut"), F.array_join(F.transform(got, lambda x: x["text"]), "\n\n").alias("full"), F.first("any").alias("any"))
    return short.unionByName(made.select("doc_id", F.when(F.col("any"), F.col("full")).otherwise(F.col("cut")).alias("context")))


def build_index(pages: DataFrame, embedder: Embedder) -> DataFrame:
    """pages -> chunks with their page ranges and vectors."""
    return embedder.embed(C.chunk_pages(pages))


def ask(index: DataFrame, question: DataFrame, embedder: Embedder, generator: Generator, *, k: int = 5, least: float = 0.3) -> DataFrame:
    """index (doc_id, chunk, text, page_start, embedding), question (one row: text) -> per document: context and answer."""
    q = embedder.embed(question.select("text").limit(1)).select(F.col("embedding").alias("q"))
    hits = S.top_each(S.similar(index, q, least=least), "doc_id", k, "chunk")
    hits = hits.select("doc_id", "rank", F.lit("").alias("doc"), F.col("chunk").alias("idx"), "text", F.col("page_start").alias("page"))
    made = context(hits, "doc_id").withColumns({"lang": F.lit("en"), "kind": F.lit("qa"), "text": F.col("context")})
    return generator.generate(build_prompts(made)).select("doc_id", "context", "answer")


def summarize(docs: DataFrame, generator: Generator, *, size: int = 4000, budget: int = 16_000, lang: str = "en") -> DataFrame:
    """docs (doc_id, text) -> summary: each chunk is summarised, then the parts (water-filled into the budget) together."""
    chunks = C.chunk_documents(docs, size).withColumns({"lang": F.lit(lang), "kind": F.lit("full")})
    parts = generator.generate(build_prompts(chunks)).select("doc_id", "chunk", F.col("answer").alias("text"))
    whole = B.water_joined(parts, "doc_id", "chunk", budget=budget, label="[...]")
    final = generator.generate(build_prompts(whole.withColumns({"lang": F.lit(lang), "kind": F.lit("full")})))
    return final.select("doc_id", T.drop_small_talk(F.col("answer")).alias("summary"))
