"""Queries over retrieval contexts, prompts and token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..operators import prompts as M
from ..operators import validate as V
from ..plans import retrieval as R
from ..sources.sessions import html_page, is_pdf
from ..sources.tables import pages_of, table
from ..streaming import tokens as K
from .search import _P


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """Pages as hits, ranked by length: those that fit 1500 characters."""
    pages = pages_of(table(spark, d, "documents")).where("text <> ''")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("text") % 97), "page"))
    hits = pages.select("doc_id", rank.alias("rank"), F.lit("").alias("doc"), F.col("page").alias("idx"), "text", F.when(F.col("page") % 4 > 0, F.col("page")).alias("page"))
    return R.context(hits, "doc_id", budget=1500).select("doc_id", F.length("context").alias("n"), F.sha2("context", 256).alias("sha"))


def keyword_context(spark: SparkSession, d: str) -> DataFrame:
    docs = P.joined(pages_of(table(spark, d, "documents")), "doc_id", "page", "text")
    return R.keyword_context(docs, "where is erat and the tion?").select("doc_id", F.length("context").alias("n"))


def ask_documents(spark: SparkSession, d: str) -> DataFrame:
    index = R.build_index(pages_of(table(spark, d, "documents")), M.HashEmbedder())
    question = table(spark, d, "benchmark").where("item_id = 1").select("text")
    return R.ask(index, question, M.HashEmbedder(), M.ExtractiveGenerator(), least=0.0)


def summarize_documents(spark: SparkSession, d: str) -> DataFrame:
    return R.summarize(P.joined(pages_of(table(spark, d, "documents")), "doc_id", "page", "text"), M.ExtractiveGenerator())


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "ko").otherwise("fr").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "keywords").otherwise("full").alias("kind"), "text")
    made = M.build_prompts(rows)
    return made.select("doc_id", F.length("prompt").alias("n"), (M.split_prompt(F.col("prompt"))["body"] == F.col("text")).alias("same"))


def collection_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("doc_id % 50 = 1").select(F.col("source").alias("group"), "doc_id", F.concat(F.lit("a|b "), F.col("doc_id")).alias("file_name"), F.concat(F.lit("# h\n  ## i\n"), F.substring("text", 1, 30)).alias("body"))
    return M.collection_prompt(rows, "group", "doc_id").select("group", "prompt")


def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    runs = K.idle_runs(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return runs.select("user_id", F.col("run").cast("long").alias("run"), F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"), "n")


def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return e.select("event_type", F.explode(keys).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


def token_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("user_id") % 4
    provider = F.when(k == 0, "ollama").when(k == 1, "claude").when(k == 2, "openai").otherwise("gemini")
    tok = F.col("event_type")
    line = F.when(k == 0, F.concat(F.lit('{"response":"'), tok, F.lit('"}'))).when(k == 1, F.concat(F.lit('data: {"delta":{"text":"'), tok, F.lit('"}}'))).when(k == 2, F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), tok, F.lit('"}}]}'))).otherwise(F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"'), tok, F.lit('"}]}}]}')))
    last = F.when(F.col("event_id") % 10 == 0, "data: [DONE]").when(F.col("event_id") % 31 == 0, '{"promptFeedback":{"blockReason":"SAFETY"}}').otherwise(line)
    lines = e.select(F.col("user_id").alias("request_id"), provider.alias("provider"), F.col("event_id").alias("seq"), last.alias("line"))
    return K.concatenated(K.decode(lines)).select("request_id", "state", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))


def image_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Pages as images: the first of each signature, ten a document, fifty at most in page order."""
    pages = pages_of(table(spark, d, "documents"))
    data = F.base64(F.encode(F.substring("text", 1, 200), "UTF-8"))
    rows = pages.where("text <> ''").select("doc_id", "page", T.image_signature(T.mime_of(data), F.length("text"), F.lit(60), data).alias("signature"))
    first = P.dedupe_first(rows, ["doc_id", "signature"], ["page"])
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return first.withColumn("rank", rank).where("rank <= 10").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("page").alias("pages"))


def pdf_gate(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("doc_id") % 3 == 0, F.lit("%PDF-1.7")).when(F.col("doc_id") % 3 == 1, F.concat(F.repeat(F.lit("x"), 1100), F.lit("%PDF-"))).otherwise("none")
    return table(spark, d, "documents").withColumn("content", F.concat(lead, F.lit("!")).cast("binary")).select("doc_id", is_pdf(F.col("content")).alias("pdf"))


def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    defaults = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    changes = F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.lit("bad"), F.lit("z"), F.lit("9"))
    ok = F.create_map(F.lit("a"), F.col("lang").isin("en", "de"), F.lit("b"), F.lit(False), F.lit("z"), F.lit(True))
    rows = table(spark, d, "documents").select("doc_id", F.explode(V.merge_settings(defaults, changes, ok)).alias("key", "value"))
    return rows


def template_clean(spark: SparkSession, d: str) -> DataFrame:
    one = lambda i: F.struct(F.concat(F.lit("t"), F.lit(i)).alias("id"), F.when((F.col("doc_id") + i) % 4 == 0, " ").otherwise(F.repeat("source", 20)).alias("name"), F.lit("p").alias("prompt"), F.when(F.lit(i % 2 == 0), "chunked").otherwise("odd").alias("strategy"))
    rows = table(spark, d, "documents").select("doc_id", V.clean_templates(F.array(*[one(i) for i in range(26)])).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.length(F.col("t")[0]["name"]).alias("name_chars"), F.get("t", F.lit(19))["id"].alias("last_id")).na.fill("-", ["last_id"])


def model_choice(spark: SparkSession, d: str) -> DataFrame:
    """The first of each source's preferred models that is installed."""
    rows = table(spark, d, "documents").select("source", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("llama", "nomic", "mxbai", "bge")]), (F.col("doc_id") % 4 + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, ":latest").otherwise("x")).alias("installed"))
    prefs = F.broadcast(spark.createDataFrame([(0, "nomic"), (1, "bge"), (2, "llama")], "rank int, base string"))
    found = rows.join(prefs, T.model_matches(F.col("installed"), F.col("base")))
    return found.groupBy("source").agg(F.min_by("base", "rank").alias("model"))


def html_export(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(html_page(F.concat(F.lit("<a> & "), "source"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("x1"))).alias("n"))


QUERIES = {f.__name__: f for f in (rag_context, keyword_context, ask_documents, summarize_documents, prompt_build, collection_prompt, idle_sessions, json_props, token_states, image_dedupe, pdf_gate, settings_merge, template_clean, model_choice, html_export)}

_EN = {k: len(t) - 6 for lang, k, t in M.TEMPLATES if lang == "en"}
_KO = {k: len(t) - 6 for lang, k, t in M.TEMPLATES if lang == "ko"}
ORACLES = {
    "rag_context": f"""WITH RECURSIVE {_P}, h AS (SELECT doc_id, page, CASE WHEN page % 4 > 0 THEN '[p.' || page || ']' || chr(10) ELSE '' END || text AS s, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) % 97 DESC, page) AS rank FROM p WHERE text <> ''),
        r AS (SELECT doc_id, page, s, rank, length(s) <= 1500 AS kept, CASE WHEN length(s) <= 1500 THEN length(s) ELSE 0 END AS used FROM h WHERE rank = 1
        UNION ALL SELECT h.doc_id, h.page, h.s, h.rank, r.used + length(h.s) <= 1500, CASE WHEN r.used + length(h.s) <= 1500 THEN r.used + length(h.s) ELSE r.used END FROM r JOIN h ON h.doc_id = r.doc_id AND h.rank = r.rank + 1),
        c AS (SELECT doc_id, string_agg(s, chr(10) || chr(10) ORDER BY page) AS c FROM r WHERE kept GROUP BY 1) SELECT doc_id, length(c) AS n, sha256(c) AS sha FROM c""",
    "prompt_build": f"SELECT doc_id, length(text) + CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN {_EN['keywords']} ELSE {_EN['full']} END ELSE CASE WHEN doc_id % 2 = 0 THEN {_KO['keywords']} ELSE {_KO['full']} END END AS n, true AS same FROM documents",
    "collection_prompt": "SELECT source AS \"group\", string_agg('## a b ' || doc_id || chr(10) || chr(92) || '# h' || chr(10) || '  ' || chr(92) || '## i' || chr(10) || regexp_replace(substr(text, 1, 30), '^(\\s*)(#{1,6}\\s)', '\\1' || chr(92) || chr(92) || '\\2'), chr(10) || chr(10) ORDER BY doc_id) AS prompt FROM documents WHERE doc_id % 50 = 1 GROUP BY 1",
    "idle_sessions": "WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, false)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, run::BIGINT AS run, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM r GROUP BY user_id, run",
    "json_props": "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL",
    "token_states": "WITH t AS (SELECT user_id AS request_id, event_id, CASE WHEN event_id % 10 = 0 OR event_id % 31 = 0 THEN '' ELSE event_type END AS tok, event_id % 10 = 0 AS done, event_id % 10 <> 0 AND event_id % 31 = 0 AS blocked FROM events), c AS (SELECT request_id, string_agg(tok, '' ORDER BY event_id) AS s, bool_or(done) AS e, bool_or(blocked) AS b FROM t GROUP BY 1) SELECT request_id, CASE WHEN b THEN 'BLOCKED' WHEN e AND s = '' THEN 'EMPTY_RESPONSE' WHEN e THEN 'done' ELSE 'open' END AS state, length(s) AS n, sha256(s) AS sha FROM c",
    "image_dedupe": f"WITH {_P}, f AS (SELECT doc_id, min(page) AS page FROM p WHERE text <> '' GROUP BY doc_id, length(text), length(to_base64(encode(substr(text, 1, 200)))), substr(to_base64(encode(substr(text, 1, 200))), 1, 64), right(to_base64(encode(substr(text, 1, 200))), 64)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM f) SELECT doc_id, count(*) AS n, sum(page)::BIGINT AS pages FROM r WHERE k <= 10 GROUP BY 1",
    "pdf_gate": "SELECT doc_id, doc_id % 3 = 0 AS pdf FROM documents",
    "settings_merge": "SELECT doc_id, 'a' AS key, CASE WHEN lang IN ('en', 'de') THEN lang ELSE '1' END AS value FROM documents UNION ALL SELECT doc_id, 'b', '2' FROM documents",
    "template_clean": "WITH t AS (SELECT doc_id, source, list_filter(range(0, 26), lambda i: (doc_id + i) % 4 <> 0)[1:20] AS l FROM documents) SELECT doc_id, len(l)::INT AS n, least(60, 20 * length(source))::INT AS name_chars, coalesce('t' || l[20], '-') AS last_id FROM t",
    "model_choice": "WITH i AS (SELECT source, ['llama', 'nomic', 'mxbai', 'bge'][1 + doc_id % 4] || CASE WHEN doc_id % 3 = 0 THEN ':latest' ELSE 'x' END AS m FROM documents), p AS (SELECT * FROM (VALUES (0, 'nomic'), (1, 'bge'), (2, 'llama')) v(rank, base)) SELECT source, arg_min(base, rank) AS model FROM i JOIN p ON m = base OR starts_with(m, base || ':') GROUP BY 1",
    "html_export": "SELECT doc_id, length(text) + length(source) + 117 AS n FROM documents",
}
