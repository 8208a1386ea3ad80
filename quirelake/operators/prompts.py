"""Prompts from templates, and the pluggable models they go to."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import joined

#: Templates by language and kind; a language without one takes the first language's. ``{text}`` stands for the text.
TEMPLATES = [
    (lang, kind, f"{verb[kind]}\n{cite if kind != 'keywords' else ''}\n---\n\n{{text}}")
    for lang, cite, verb in (
        ("ko", "각 문장 끝에 [p.N]을 붙이세요.", {"full": "다음 문서를 요약하세요.", "chapter": "다음 장을 요약하세요.", "keywords": "핵심어를 뽑으세요.", "qa": "질문에 답하세요."}),
        ("en", "End each sentence with [p.N].", {"full": "Summarize the document.", "chapter": "Summarize the chapter.", "keywords": "List the keywords.", "qa": "Answer the question."}),
    )
    for kind in verb
]


class Embedder(Protocol):
    """Adds ``embedding`` (unit vectors) to rows with ``text``."""

    def embed(self, rows: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    """Adds ``answer`` to rows with ``prompt``."""

    def generate(self, rows: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """Stand-in without a model: hashed word counts."""

    def embed(self, rows: DataFrame) -> DataFrame:
        from .chunking import hash_embedding

        return hash_embedding(rows)


class ExtractiveGenerator:
    """Stand-in without a model: the first sentences of what follows the prompt's rule."""

    def __init__(self, sentences: int = 2):
        self.sentences = sentences

    def generate(self, rows: DataFrame) -> DataFrame:
        body = split_prompt(F.col("prompt"))["body"]
        parts = F.filter(F.split(T.collapse(body), T.SENTENCE_END), lambda s: F.length(s) > 0)
        return rows.withColumn("answer", F.array_join(F.slice(parts, 1, self.sentences), " "))


def split_prompt(prompt: Column) -> Column:
    """system and body of a prompt, cut at its first rule; without one all is body."""
    at = F.instr(prompt, "---\n\n")
    return F.struct(F.when(at > 0, F.substring(prompt, 1, at - 1)).otherwise("").alias("system"), F.when(at > 0, F.substring(prompt, at + 5, F.length(prompt))).otherwise(prompt).alias("body"))


def build_prompts(rows: DataFrame, first: str = "ko") -> DataFrame:
    """rows (.., lang, kind, text) -> prompt, by their language's template or the first language's."""
    spark = rows.sparkSession
    t = F.broadcast(spark.createDataFrame(TEMPLATES, "lang string, kind string, template string"))
    base = t.where(F.col("lang") == first).select("kind", F.col("template").alias("base"))
    out = rows.join(t, ["lang", "kind"], "left").join(F.broadcast(base), "kind", "left")
    return out.withColumn("prompt", F.replace(F.coalesce("template", "base"), F.lit("{text}"), F.col("text"))).drop("template", "base")


# The headers and rules of the second try.
REFINE = """

[질문]
{question}

[초안 답변]
{draft}

위 초안 답변 중 원문(컨텍스트) 에서 근거를 찾을 수 있는 내용만 남기고 다시 작성하세요.
규칙:
- 원문에 명시되지 않은 주장은 제거하거나 "문서에서 확인되지 않음" 으로 표시
- 문체와 구조(문단/목록 형식) 는 초안을 그대로 유지
- [p.N] 인용은 근거 페이지를 찾으면 그대로, 찾을 수 없으면 제거
- 새 정보를 추가하지 말고 초안의 정확성만 개선"""


def refine_prompt(question: Column, draft: Column, context: Column) -> Column:
    """The prompt that asks for a draft's supported part only."""
    parts = REFINE.replace("{draft}", "{question}").split("{question}")
    return F.concat(context, F.lit(parts[0]), question, F.lit(parts[1]), draft, F.lit(parts[2]))


def collection_prompt(blocks: DataFrame, by: str, order: str) -> DataFrame:
    """One prompt per collection from its members' blocks (file_name, body); headings inside bodies are escaped."""
    escaped = F.regexp_replace("body", r"(?m)^(\s*)(#{1,6}\s)", r"$1\\$2")
    rows = blocks.withColumn("block", F.concat(F.lit("## "), T.doc_label(F.col("file_name")), F.lit("\n"), escaped))
    return joined(rows, by, order, "block").withColumnRenamed("block", "prompt")
