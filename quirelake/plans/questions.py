"""The question pipeline: context, draft, check against the index, a second try, and the answer's last touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as X
from ..operators import collection as L
from ..operators import search as S
from ..operators.prompts import Embedder, Generator, build_prompts, refine_prompt
from ..sources.shared import stored
from .retrieval import context, keyword_context

#: Sentences of an answer that are checked.
MOST_SENTENCES = 100


def collection_context(members: DataFrame, index: DataFrame, questions: DataFrame, *, most: int = L.MOST_MEMBERS, least: float = L.LEAST, budget: int = 8000) -> DataFrame:
    """members (id, pos, doc_hash, file_name, status, active), index, questions (id, q) -> per collection: context (null: nothing found), degraded."""
    used = L.effective_members(members, most)
    hits = L.collection_hits(used, index, questions, least=least)
    made = context(hits.select("id", "rank", F.col("doc_hash").alias("doc"), F.col("chunk").alias("idx"), "text", F.col("page_start").alias("page"), "file_name"), "id", budget=budget, named=True)
    state = L.collection_state(used, index)
    return members.select("id").distinct().join(made, "id", "left").join(state.select("id", "degraded"), "id", "left").withColumn("degraded", F.col("context").isNull() | F.coalesce("degraded", F.lit(True)))


def document_context(index: DataFrame, docs: DataFrame, question: str, q: DataFrame, *, k: int = 5, least: float = 0.3, budget: int = 8000) -> DataFrame:
    """docs (doc_id, text), index (doc_id, chunk, ..) and the question's vector -> doc_id, context, source: the best chunks, else those with its keywords."""
    hits = S.top_each(S.similar(index, q, least=least), "doc_id", k, "chunk")
    hits = hits.select("doc_id", "rank", F.lit("").alias("doc"), F.col("chunk").alias("idx"), "text", F.col("page_start").alias("page"))
    found = stored(context(hits, "doc_id", budget=budget).withColumn("source", F.lit("index")), "found")
    rest = docs.join(found.select("doc_id"), "doc_id", "left_anti")
    return found.unionByName(keyword_context(rest, question, budget=budget).where(T.trim(F.col("context")) != "").withColumn("source", F.lit("keywords")))


def check(answers: DataFrame, index: DataFrame, embedder: Embedder) -> DataFrame:
    """answers (doc_id, answer), index (doc_id, embedding) -> per document the verdict on the answer's first sentences against its own chunks."""
    said = answers.select("doc_id", F.posexplode(F.slice(T.sentences(F.col("answer")), 1, MOST_SENTENCES)).alias("n", "text"))
    said = embedder.embed(said).select("doc_id", "n", F.col("embedding").alias("q"))
    from ..functions import vector as V

    pairs = said.join(index.select("doc_id", "embedding"), "doc_id").where(F.size("embedding") == F.size("q"))
    best = pairs.groupBy("doc_id", "n").agg(F.max(V.dot(F.col("embedding"), F.col("q"))).alias("m"))
    support = said.select("doc_id", "n").join(best, ["doc_id", "n"], "left").select("doc_id", "n", F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0))).alias("support"))
    return S.verdict(support.withColumnRenamed("n", "sentence"), "doc_id")


def answer_question(index: DataFrame, docs: DataFrame, question: str, embedder: Embedder, generator: Generator, *, least: float = 0.3, budget: int = 8000, lang: str = "en") -> DataFrame:
    """One question to each of docs (doc_id, text): doc_id, source, refined, average, answer.

    The context goes to the model with the question; an answer whose sentences the index supports too weakly is given back
    with its draft once. Citations go to the ends of lines, small talk goes. Documents without a context have no row.
    index should be a stored table: it is read twice. What later steps need more than once is stored too, or each would
    compute all before it again.
    """
    spark = docs.sparkSession
    q = embedder.embed(spark.createDataFrame([(question,)], "text string")).select(F.col("embedding").alias("q"))
    asked = document_context(index, docs, question, q, least=least, budget=budget)
    asked = asked.withColumns({"lang": F.lit(lang), "kind": F.lit("qa"), "text": F.concat("context", F.lit("\n\n[질문]\n"), T.sanitize_prompt(F.lit(question)))})
    drafts = stored(generator.generate(build_prompts(asked)).select("doc_id", "context", "source", "answer"), "drafts")
    judged = drafts.join(check(drafts, index, embedder), "doc_id", "left").withColumn("refine", F.coalesce("refine", F.lit(False)) & (F.col("source") == "index"))
    judged = stored(judged, "judged")
    again = generator.generate(judged.where("refine").withColumn("prompt", refine_prompt(F.lit(question), F.col("answer"), F.col("context"))).drop("answer"))
    out = stored(judged.where("not refine").unionByName(again.select(*judged.columns)).drop("context"), "answers")
    placed = X.place(out.select("doc_id", "answer"), "doc_id", "answer")
    return out.drop("answer").join(placed, "doc_id").select("doc_id", "source", F.col("refine").alias("refined"), "average", T.drop_small_talk(F.col("text")).alias("answer"))
