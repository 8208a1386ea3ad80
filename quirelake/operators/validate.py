"""Validation of requests and settings: the first failing check names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_url, trim

# Fixed values of the rules: providers, summary kinds, languages, sizes and the shape of model names.
PROVIDERS = ("ollama", "claude", "openai", "gemini")
KINDS = ("full", "chapter", "keywords", "qa", "custom")
LANGUAGES = ("ko", "en", "ja", "zh", "auto")
MODEL = r"^[a-zA-Z0-9]([a-zA-Z0-9._:/\-]*[a-zA-Z0-9])?\z"
MOST_ID, MOST_TEXT, MOST_MODEL, MOST_PROMPT = 256, 10 << 20, 128, 4000


def request_error(rows: DataFrame) -> DataFrame:
    """error of each generate request (request_id, text, url, kind, provider, model, temperature, language, custom_prompt), null if it is good.

    The first rule that fails names the error. A missing (null) temperature, language or custom prompt is allowed; only
    the local provider's URL must parse and be local; kind custom needs a prompt.
    """
    local, url = F.col("provider") == "ollama", F.col("url")
    parsed = F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("HOST")).isNotNull()
    prompt = F.col("custom_prompt")
    checks = [
        ("requestId", F.length("request_id").between(1, MOST_ID)),
        ("text", F.length("text").between(1, MOST_TEXT)),
        ("ollamaBaseUrl", url.isNotNull() & (~F.coalesce(local, F.lit(False)) | parsed)),
        ("ollamaBaseUrl: localhost only", ~F.coalesce(local, F.lit(False)) | local_url(url)),
        ("type", F.col("kind").isin(*KINDS)),
        ("provider", F.col("provider").isin(*PROVIDERS)),
        ("model", F.col("model").rlike(MODEL) & (F.length("model") <= MOST_MODEL)),
        ("temperature", F.col("temperature").isNull() | (~F.isnan("temperature") & F.col("temperature").between(0, 2))),
        ("language", F.col("language").isNull() | F.col("language").isin(*LANGUAGES)),
        ("customPrompt", (prompt.isNull() | (F.length(prompt) <= MOST_PROMPT)) & ((F.col("kind") != "custom") | (trim(F.coalesce(prompt, F.lit(""))) != ""))),
    ]
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"Invalid {name}")) for name, ok in checks])
    return rows.withColumn("error", error)


def embedding_batch_ok(texts: Column) -> Column:
    """1 to 200 texts of 1 to 32000 characters."""
    return F.coalesce(F.size(texts).between(1, 200) & F.forall(texts, lambda t: F.length(t).between(1, 32_000)), F.lit(False))


def clean_templates(templates: Column, most: int = 20) -> Column:
    """Valid templates, the first most of them, their names and prompts cut."""
    good = F.filter(templates, lambda t: F.length(t["id"]).between(1, 64) & (F.length(F.trim(t["name"])) > 0) & (F.length(F.trim(t["prompt"])) > 0))
    return F.transform(F.slice(good, 1, most), lambda t: F.struct(t["id"].alias("id"), F.substring(t["name"], 1, 60).alias("name"), F.substring(t["prompt"], 1, 4000).alias("prompt"), F.when(t["strategy"] == "chunked", "chunked").otherwise("single").alias("strategy")))


def merge_settings(defaults: Column, changes: Column, valid: Column) -> Column:
    """defaults overlaid with the changes whose keys are known and whose values are valid (a map of keys to checks)."""
    good = F.map_filter(changes, lambda k, v: F.map_contains_key(defaults, k) & F.coalesce(F.try_element_at(valid, k), F.lit(False)))
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(good, k))
    return F.map_concat(kept, good)
