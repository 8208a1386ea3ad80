"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import search as S
from ..sources.tables import manifest_of, pages_of, summaries_of, table

WORD = "erat"


def _scored(spark: SparkSession, d: str, least: float) -> DataFrame:
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return S.similar(e, query, least=least).select("vec_id", "label", F.round("score", 6).alias("score"))


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return S.top(S.top_each(_scored(spark, d, 0.3), "label", 3, "vec_id"), 50, "vec_id").select("vec_id", "label", "score")


def semantic_search_all(spark: SparkSession, d: str) -> DataFrame:
    return S.top(S.top_each(_scored(spark, d, -1.0), "label", 3, "vec_id"), 50, "vec_id").select("vec_id", "label", "score")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.top(_scored(spark, d, 0.0), 5, "vec_id")


def vector_top1(spark: SparkSession, d: str) -> DataFrame:
    return S.best(_scored(spark, d, 0.0).where("vec_id <> 0"), "vec_id")


def collection_merge_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.top(S.top_each(_scored(spark, d, 0.0), "label", 5, "vec_id"), 8, "label", "vec_id").select("vec_id", "label", "score")


def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("v", V.normalize(F.transform("embedding", lambda x: x * 3)))
    return e.select("vec_id", F.round(V.norm(F.col("v")), 4).alias("norm"), F.round(F.col("v")[0].cast("double"), 4).alias("first"))


def embedding_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.valid(F.col("embedding"), 64).alias("valid"))


def index_states(spark: SparkSession, d: str) -> DataFrame:
    return S.index_state(manifest_of(table(spark, d, "documents")), "base", 64).groupBy("state").agg(F.count("*").alias("n"))


def _support(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    # every twentieth vector, reversed (itself it would find), against all
    return S.verify(e.where("vec_id % 20 = 0").select("vec_id", "label", F.reverse("embedding").alias("embedding")), e, keys=("vec_id", "label"))


def verify_scores(spark: SparkSession, d: str) -> DataFrame:
    return _support(spark, d).select("vec_id", F.round("support", 6).alias("support"))


def verify_decision(spark: SparkSession, d: str) -> DataFrame:
    v = S.verdict(_support(spark, d), "label")
    return v.select("label", "n", "n_weak", F.round("average", 6).alias("average"), "refine")


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = S.keyword_scores(pages_of(docs), docs.select("doc_id", F.col("source").alias("file_name")), summaries_of(docs), WORD)
    return found.select("doc_id", "file_name", "score", "in_summary")


def keyword_ranked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    seen = manifest_of(docs).select("doc_id", "last_accessed")
    return S.top(keyword_search(spark, d).join(seen, "doc_id"), 50, F.desc("last_accessed"), "doc_id").select("doc_id", "score")


def keyword_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = S.keyword_scores(pages_of(docs), docs.select("doc_id", F.col("source").alias("file_name")), summaries_of(docs), WORD)
    return found.select("doc_id", F.explode("snippets").alias("s")).select("doc_id", F.col("s.page").cast("long").alias("page"), F.col("s.text").alias("snippet"))


def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(T.keywords(F.col("text"))).alias("word")).groupBy("item_id", "word").agg(F.count("*").alias("n"))


def chunk_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    words = F.broadcast(table(spark, d, "benchmark").where("item_id = 1").limit(1).select(T.keywords(F.col("text")).alias("words")))
    pages = pages_of(table(spark, d, "documents")).crossJoin(words)  # one row: the question
    return S.chunk_keyword_scores(pages, F.col("words")).where("score > 0").select("doc_id", "page", "score")


def highlight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").contains(WORD)).select("doc_id", F.length(T.highlight(F.col("text"), WORD)).alias("n"))


QUERIES = {f.__name__: f for f in (semantic_search, semantic_search_all, vector_topk, vector_top1, collection_merge_topk, vector_normalize, embedding_validity, index_states, verify_scores, verify_decision, keyword_search, keyword_ranked, keyword_snippets, keyword_extract, chunk_keyword_score, highlight)}

_S = """s AS (SELECT vec_id, label, round(greatest(-1, least(1, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)))), 6) AS score FROM embeddings)"""
_V = """v AS (SELECT a.vec_id, a.label, greatest(0, max(greatest(-1, least(1, list_dot_product(list_reverse(a.embedding)::DOUBLE[], b.embedding::DOUBLE[]))))) AS support
              FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 GROUP BY ALL)"""
_P = """p AS (SELECT doc_id, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)"""
_M = """m AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 'base' END END AS embed_model,
              CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 11 = 0 THEN 32 ELSE 64 END END AS embed_dim,
              CASE WHEN doc_id % 7 <> 0 THEN ceil(length(coalesce(text, '')) / 2000) ELSE 0 END::BIGINT AS chunk_count, length(coalesce(text, ''))::BIGINT AS byte_size,
              doc_id * 37 % 1009 AS last_accessed, sha256(coalesce(text, '')) AS doc_hash, source AS file_name, len(string_split(coalesce(text, ''), chr(10))) AS page_count FROM documents)"""
_K = f"""{_P}, h AS (SELECT doc_id, page, text, ((length(text) - length(replace(lower(text), '{WORD}', ''))) // {len(WORD)}) AS occ FROM p),
         b AS (SELECT doc_id, sum(occ) AS occ FROM h WHERE occ > 0 GROUP BY 1),
         f AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS content FROM documents WHERE doc_id % 2 = 0),
         t AS (SELECT doc_id, content FROM f WHERE contains(lower(content), '{WORD}')),
         k AS (SELECT d.doc_id, d.source AS file_name, (5 * contains(lower(d.source), '{WORD}')::INT + coalesce(occ, 0) + 2 * (t.doc_id IS NOT NULL)::INT)::BIGINT AS score, t.doc_id IS NOT NULL AS in_summary, b.doc_id IS NOT NULL AS on_page
               FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id)"""
_BL = r"[\s\x0B\x{85}\p{Z}]+"


def _snip(text: str, at: str) -> str:
    n = len(WORD)
    return f"""(CASE WHEN {at} > 50 THEN '…' ELSE '' END || trim(regexp_replace(substr({text}, greatest(0, {at} - 50) + 1, least(length({text}), {at} + {n} + 50) - greatest(0, {at} - 50)), '{_BL}', ' ', 'g')) || CASE WHEN {at} + {n} + 50 < length({text}) THEN '…' ELSE '' END)"""


_STOP = "', '".join(T.STOP_WORDS)
_KW = f"""list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[?？!！.,;:''"()\\[\\]{{}}]', ' ', 'g'), '{_BL}'), lambda w: lower(w)), lambda w: length(w) >= 2 AND NOT list_contains(['{_STOP}'], w))"""
ORACLES = {
    "semantic_search": f"WITH {_S} SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0.3) WHERE r <= 3 ORDER BY score DESC, vec_id LIMIT 50",
    "semantic_search_all": f"WITH {_S} SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 3 ORDER BY score DESC, vec_id LIMIT 50",
    "vector_topk": f"WITH {_S} SELECT vec_id, label, score FROM s WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 5",
    "vector_top1": f"WITH {_S} SELECT vec_id, score FROM s WHERE vec_id <> 0 AND score >= 0 ORDER BY score DESC, vec_id LIMIT 1",
    "collection_merge_topk": f"WITH {_S} SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0) WHERE r <= 5 ORDER BY score DESC, label, vec_id LIMIT 8",
    "vector_normalize": "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: (x * 3)::FLOAT::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: (x / sqrt(list_dot_product(e, e)))::FLOAT::DOUBLE) AS u FROM v) SELECT vec_id, round(sqrt(list_dot_product(u, u)), 4) AS norm, round(u[1], 4) AS first FROM n",
    "embedding_validity": "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid FROM embeddings",
    "index_states": f"WITH {_M} SELECT CASE WHEN embed_model IS NULL OR chunk_count = 0 THEN 'missing' WHEN embed_model = 'base' AND embed_dim = 64 THEN 'ready' ELSE 'mismatch' END AS state, count(*) AS n FROM m GROUP BY 1",
    "verify_scores": f"WITH {_V} SELECT vec_id, round(support, 6) AS support FROM v",
    "verify_decision": f"WITH {_V} SELECT label, count(*) AS n, sum((support < 0.5)::INT)::BIGINT AS n_weak, round(avg(support), 6) AS average, (n_weak >= 2 OR n_weak / n > 0.2 OR avg(support) < 0.65) AS refine FROM v GROUP BY label",
    "keyword_search": f"WITH {_K} SELECT doc_id, file_name, score, in_summary FROM k WHERE score > 0",
    "keyword_ranked": f"WITH {_K} SELECT doc_id, score FROM k WHERE score > 0 ORDER BY score DESC, doc_id * 37 % 1009 DESC, doc_id LIMIT 50",
    "keyword_snippets": f"""WITH {_K}, g AS (SELECT doc_id, page, text, instr(lower(text), '{WORD}') - 1 AS i, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM h WHERE occ > 0)
        SELECT doc_id, page, {_snip('text', 'i')} AS snippet FROM g WHERE r <= 3
        UNION ALL SELECT t.doc_id, 0, {_snip('content', f"(instr(lower(content), '{WORD}') - 1)")} FROM t JOIN k USING (doc_id) WHERE NOT on_page""",
    "keyword_extract": f"SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest({_KW}) AS word FROM benchmark) GROUP BY ALL",
    "chunk_keyword_score": f"""WITH {_P}, q AS (SELECT {_KW} AS words FROM benchmark WHERE item_id = 1), w AS (SELECT unnest(words) AS w FROM q),
        l AS (SELECT doc_id, page, lower(text) AS t FROM p WHERE text <> ''),
        c AS (SELECT doc_id, page, CASE WHEN regexp_matches(w, '^[a-z0-9]+$') THEN len(regexp_extract_all(t, '\\b' || w || '\\b', 0)) ELSE (length(t) - length(replace(t, w, ''))) // length(w) END AS n FROM l, w)
        SELECT doc_id, page, sum(n)::BIGINT AS score FROM c GROUP BY ALL HAVING sum(n) > 0""",
    "highlight": f"SELECT doc_id, length(text) + 13 * ((length(text) - length(replace(lower(text), '{WORD}', ''))) // {len(WORD)}) AS n FROM documents WHERE contains(lower(text), '{WORD}')",
}
