"""Queries over budgets, the store, validation and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budgets as B
from ..operators import store as S
from ..operators import validate as V
from ..sources.tables import manifest_of, pages_of, table
from .search import _BL, _M, _P


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest_of(table(spark, d, "documents"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return m.select(F.col("file_name").alias("id"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 13 == 0, F.sha2(F.col("doc_id").cast("string"), 256)).when(F.col("doc_id") % 17 == 0, F.lit("bad")).otherwise(F.col("doc_hash")).alias("doc_hash"))


def _talk(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), ((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 0)).alias("cancelled"))


def member_resolution(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return S.resolve_members(S.unique_members(_members(spark, d)), m, m.where("doc_id % 10 = 3").select("doc_hash", F.concat(F.lit("tab "), "file_name").alias("file_name")), "base", 64).select("id", F.col("pos").cast("long").alias("pos"), "name", "source", "status")


def member_counts(spark: SparkSession, d: str) -> DataFrame:
    return member_resolution(spark, d).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "ready", 1).otherwise(0)).alias("n_ready"))


def lru_evict(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return B.evict(m, "doc_id", most=15, most_bytes=60_000, pinned=m.where("doc_id % 9 = 0"), by="file_name").select("doc_id", "evicted")


def lru_evict_store(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d).where("file_name = 'src3'")
    return B.evict(m, "doc_id", most=30, most_bytes=200_000).where("evicted").select("doc_id")


def waterfill_budget(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines, some with a citation, as one text of 1000 characters at most (before its label)."""
    lines = pages_of(table(spark, d, "documents")).withColumn("text", F.when(F.col("page") % 3 == 0, F.concat("text", F.lit(" [other.pdf p. 12|a longer quote]"))).otherwise(F.col("text")))
    out = B.water_joined(lines, "doc_id", "page", budget=1000, label="[cut]")
    return out.select("doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))


def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    kept = B.prefix_budget(pages_of(table(spark, d, "documents")), "doc_id", [F.desc(F.length("text") % 7), F.col("page")], budget=2000)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def skip_budget(spark: SparkSession, d: str) -> DataFrame:
    pages = pages_of(table(spark, d, "documents"))
    groups = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("items"))
    kept = B.skip_budget(groups, "items", budget=600)
    return kept.select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.page")


def member_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("group"), F.concat(F.lit("[a] "), "source").alias("file_name"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("S [p.3] "), "text", F.lit(" [p.12]"))).alias("summary"), "text")
    return B.member_blocks(docs, "group", "doc_id").select("group", F.size("blocks").alias("n"), "left", F.sha2(F.to_json("blocks"), 256).alias("sha"))


def cancelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return B.drop_cancelled(_talk(spark, d), "conv_id", "turn").select("conv_id", "turn")


def history_trim(spark: SparkSession, d: str) -> DataFrame:
    return B.trim_history(_talk(spark, d), "conv_id", "turn", budget=800).select("conv_id", "turn")


def history_format(spark: SparkSession, d: str) -> DataFrame:
    """Some messages try to open a section of the prompt."""
    marked = F.concat(F.lit("[질문] x\n---\n"), "text")
    talk = _talk(spark, d).withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, marked).otherwise(F.col("text")))
    return B.format_history(talk, "conv_id", "turn", budget=900)


def qa_retention(spark: SparkSession, d: str) -> DataFrame:
    return B.retain(_talk(spark, d), "conv_id", "turn", 3).select("conv_id", "turn")


def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).agg(F.count("*").alias("n"), F.sum("byte_size").alias("bytes"))


def recent_list(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).orderBy(F.desc("last_accessed"), "doc_id").limit(20).select("doc_id", "last_accessed")


def upsert_sessions(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d).select("doc_id", "file_name", (F.col("doc_id") * 2).alias("created_at"))
    new = m.where("doc_id % 4 = 0").select(F.when(F.col("doc_id") % 8 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).alias("doc_id"), F.concat("file_name", F.lit("+")).alias("file_name"), F.lit(7).cast("long").alias("created_at"))
    return S.upsert(m, new, "doc_id")


def keep_index(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d).withColumn("has_blob", F.col("doc_id") % 3 == 0)
    return S.keep_index(m, m.where("doc_id % 2 = 0"), "doc_id").groupBy(F.coalesce("embed_model", F.lit("-")).alias("model")).agg(F.count("*").alias("n"), F.sum("chunk_count").alias("chunks"))


def summaries_merge(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d).select("doc_id", F.create_map(F.lit("full"), F.lit("old"), F.lit("keywords"), F.lit("k")).alias("summaries"))
    delta = m.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "full").otherwise("chapter").alias("kind"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("new").alias("content")).where("doc_id % 3 = 0")
    merged = S.merge_summaries(m, delta, "doc_id")
    return merged.select("doc_id", "merged", F.explode("summaries").alias("kind", "content"))


def patch_sessions(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d).select("doc_id", "file_name")
    patches = m.where("doc_id % 5 = 0").select((F.col("doc_id") * 3).alias("doc_id"), F.lit("patched").alias("file_name"))
    done, ok = S.patch(m, patches, "doc_id", ["file_name"])
    return done.select("doc_id", "file_name", F.lit("row").alias("kind")).unionByName(ok.where("not ok").select("doc_id", F.lit("").alias("file_name"), F.lit("refused").alias("kind")))


def touch_and_remove(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d).select("doc_id", "last_accessed")
    return S.remove(S.touch(m, F.col("doc_id") == 5, F.lit(9_999).cast("long")), m.where("doc_id % 6 = 0"), "doc_id")


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    m = S.unique_members(_manifest(spark, d).select(F.lit("x").alias("id"), F.col("doc_id").alias("pos"), "doc_hash"), 10**9).select("doc_hash", F.col("pos").alias("k"))
    manifest = m.where("k % 3 > 0").select("doc_hash", (F.col("k") % 2).alias("chunk_count"))
    bad = F.when(F.col("k") % 10 == 9, F.lit("0")).otherwise(F.col("doc_hash"))
    folders = m.where("k % 7 > 0").select("doc_hash", (F.col("k") % 6 > 0).alias("readable"), bad.alias("body_hash"), (F.col("k") % 4 > 0).alias("has_blob"))
    return S.reconcile(manifest, folders).groupBy("action").agg(F.count("*").alias("n"))


def tabs_merge(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    old = m.where("doc_id < 50").select("doc_id", "file_name", F.col("page_count").cast("long").alias("page_count"))
    new = m.where("doc_id >= 40 AND doc_id < 60").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "new").alias("file_name"), F.lit(1).cast("long").alias("page_count"))
    return S.merge_tabs(old, new, "doc_id").select("doc_id", F.coalesce("file_name", F.lit("-")).alias("file_name"), "page_count")


def normalize_entries(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    k = F.col("doc_id") % 4
    raw = m.select(F.when(k == 0, "x").otherwise(F.col("doc_hash")).alias("doc_hash"), F.repeat("file_name", 200).alias("file_name"), F.lit("/p").alias("file_path"), F.when(k == 1, "NaN").when(k == 2, "abc").otherwise(F.col("page_count").cast("string")).alias("page_count"), F.col("embed_model"), F.col("byte_size").cast("string").alias("byte_size"), F.when(k == 2, "no date").otherwise("2024-01-02T03:04:05.000Z").alias("created_at"))
    return S.normalize_entries(raw).groupBy("doc_hash").agg(F.count("*").alias("n"), F.max(F.length("file_name")).alias("name_chars"), F.sum("page_count").alias("pages"), F.min("created_at").alias("created_at"))


def persist_plan(spark: SparkSession, d: str) -> DataFrame:
    bit = lambda n: F.col("doc_id") % n == 0
    rows = _manifest(spark, d).select("doc_id", (~bit(11)).alias("enabled"), bit(13).alias("restoring"), bit(2).alias("flushing"), bit(3).alias("busy"), bit(5).alias("index_changed"), (~bit(7)).alias("summary_done"), bit(17).alias("indexing"), bit(19).alias("failed"), F.col("chunk_count").alias("chunks"))
    return S.persist_plan(rows).select("doc_id", "mode", "keep_index")


def safe_href(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.concat(F.lit("javascript:"), "url")).when(k == 1, F.concat("url", F.lit("\u202e"))).when(k == 2, F.lit("  #anchor ")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.safe_href(url).alias("safe"))


def redact_paths(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(r"C:\Users\ann\x.ts c:/Users/bo/y /home/al/z \\srv\share\a /etc/passwd D:\w E:/v https://h/p "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", T.redact_paths(text).alias("text"))


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.col("doc_id").cast("string"), 256)
    text = F.concat(F.lit("Bearer "), key, F.lit(" sk-ant-"), key, F.lit(" sk-proj-"), key, F.lit(" AIza"), key, F.lit(" sk-short "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", T.redact_secrets(text).alias("text"))


def vision_clean(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see https://a.b/c?d and ```code\nx```. "), "text")
    return table(spark, d, "documents").select("doc_id", T.clean_vision(text).alias("text"))


def conversational_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 4
    talk = F.when(k == 0, "I hope this helps!").when(k == 1, "Feel free to ask [p.3]").when(k == 2, "도움이 되길 바랍니다").otherwise("以上です。")
    text = F.concat(talk, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\n\n\nTo summarize, x"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.drop_small_talk(text).alias("text"))


def request_errors(spark: SparkSession, d: str) -> DataFrame:
    """Twenty requests that break one rule each, or none."""
    k, null = F.col("doc_id") % 20, F.lit(None).cast("string")
    rows = table(spark, d, "documents").select(
        "doc_id",
        F.when(k == 0, "").when(k == 18, F.repeat(F.lit("r"), 257)).otherwise("any id!").alias("request_id"),
        F.when(k == 1, "").otherwise(F.col("text")).alias("text"),
        F.when(k == 2, null).when(k == 3, "not a url").when(k.isin(4, 19), "http://evil.example/").otherwise("http://localhost:11434").alias("url"),
        F.when(k == 5, "poem").when(k.isin(12, 13, 14), "custom").otherwise("full").alias("kind"),
        F.when(k == 6, "acme").when(k == 19, "claude").otherwise("ollama").alias("provider"),
        F.when(k == 7, "-x").when(k == 8, "m:").when(k == 17, F.repeat(F.lit("m"), 129)).otherwise("m:7b").alias("model"),
        F.when(k == 9, 3.0).when(k != 15, 0.5).alias("temperature"),
        F.when(k == 10, "xx").when(k == 16, "auto").when(k != 15, "en").alias("language"),
        F.when(k == 11, F.repeat(F.lit("x"), 4001)).when(k == 13, " \n").when(k == 14, "as a poem").alias("custom_prompt"),
    )
    return V.request_error(rows).select("doc_id", F.coalesce("error", F.lit("ok")).alias("error"))


def http_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    rows = table(spark, d, "events").select("event_id", F.when(k < 2, 429).when(k == 2, 503).when(k == 3, 529).otherwise(500).alias("status"), F.when(k == 0, "Quota exceeded").otherwise("slow").alias("detail"), F.when(k == 0, "3.5").when(k == 1, "900").when(k == 2, "soon").otherwise("-1").alias("after"))
    return rows.select("event_id", F.coalesce(T.http_error(F.col("status"), F.col("detail")), F.lit("-")).alias("error"), F.coalesce(T.retry_after_ms(F.col("after")), F.lit(-1).cast("long")).alias("wait_ms"))


def progress_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    line = F.when(k == 0, "pulling ab12 ▕██▏ 45%").when(k == 1, "pulling manifest").when(k == 2, "verifying sha256 digest").when(k == 3, "writing manifest").when(k == 4, "success").when(k == 5, "pulling abcdef").otherwise("hello")
    return table(spark, d, "events").select("event_id", T.progress_event(T.last_line(F.concat(F.lit("x\n\x1b[2K"), line, F.lit("\n")))).alias("event"))


QUERIES = {f.__name__: f for f in (member_resolution, member_counts, lru_evict, lru_evict_store, waterfill_budget, prefix_budget, skip_budget, member_blocks, cancelled_pairs, history_trim, history_format, qa_retention, session_stats, recent_list, upsert_sessions, keep_index, summaries_merge, patch_sessions, touch_and_remove, reconcile, tabs_merge, normalize_entries, persist_plan, safe_href, redact_paths, redact_secrets, vision_clean, conversational_filter, request_errors, http_errors, progress_events)}

_MR = f"""{_M}, b AS (SELECT file_name AS id, doc_id AS pos, CASE WHEN doc_id % 13 = 0 THEN sha256(doc_id::VARCHAR) WHEN doc_id % 17 = 0 THEN 'bad' ELSE doc_hash END AS doc_hash FROM m),
    u AS (SELECT id, doc_hash, min(pos) AS pos FROM b WHERE regexp_matches(doc_hash, '^[a-f0-9]{{64}}$') GROUP BY ALL), v0 AS (SELECT id, doc_hash, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS p0 FROM u), v AS (SELECT id, doc_hash, p0 AS pos FROM v0 WHERE p0 < 50),
    w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY doc_id) = 1), t AS (SELECT doc_hash, min('tab ' || file_name) AS tab FROM m WHERE doc_id % 10 = 3 GROUP BY 1),
    r AS (SELECT id, pos, coalesce(tab, file_name, v.doc_hash) AS name, CASE WHEN tab IS NULL THEN 'session' ELSE 'memory' END AS source, CASE WHEN w.doc_hash IS NULL THEN CASE WHEN tab IS NULL THEN 'missing' ELSE 'no-index' END WHEN chunk_count = 0 THEN 'no-index' WHEN embed_model <> 'base' OR embed_dim <> 64 THEN 'model-mismatch' ELSE 'ready' END AS status FROM v LEFT JOIN w ON w.doc_hash = v.doc_hash LEFT JOIN t ON t.doc_hash = v.doc_hash)"""
_T = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, role = 'assistant' AND (conv_id + turn) % 5 = 0 AS cancelled FROM conversations)"
_TC = f"{_T}, k AS (SELECT * FROM (SELECT *, cancelled OR (role = 'user' AND coalesce(lead(cancelled) OVER (PARTITION BY conv_id ORDER BY turn), false)) AS gone FROM t) WHERE NOT gone)"

def _redacted(rules) -> str:
    """SQL for the rules, one after the other, on the text."""
    sql = "coalesce(text, '')"
    for pattern, by in rules:
        sql = f"regexp_replace({sql}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return sql


_PATHLESS = _redacted([(p.replace("(?!/)[^", "[^/"), by) for p, by in T.PATHS])
ORACLES = {
    "member_resolution": f"WITH {_MR} SELECT * FROM r",
    "member_counts": f"WITH {_MR} SELECT id, count(*) AS n, sum((status = 'ready')::INT)::BIGINT AS n_ready FROM r GROUP BY 1",
    "lru_evict": f"""WITH {_M}, x AS (SELECT *, doc_id % 9 = 0 AS pin FROM m), y AS (SELECT *, count(*) OVER g AS n, sum(byte_size) OVER g AS b, count(*) OVER w AS n0, coalesce(sum(byte_size) OVER w, 0) AS b0 FROM x WINDOW g AS (PARTITION BY file_name), w AS (PARTITION BY file_name ORDER BY pin, last_accessed, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT doc_id, NOT pin AND (n - n0 > 15 OR b - b0 > 60000) AS evicted FROM y""",
    "lru_evict_store": f"WITH {_M}, y AS (SELECT *, count(*) OVER () AS n, sum(byte_size) OVER () AS b, count(*) OVER w AS n0, coalesce(sum(byte_size) OVER w, 0) AS b0 FROM m WHERE file_name = 'src3' WINDOW w AS (ORDER BY last_accessed, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id FROM y WHERE n - n0 > 30 OR b - b0 > 200000",
    "waterfill_budget": rf"""WITH {_P}, p2 AS (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN text || ' [other.pdf p. 12|a longer quote]' ELSE text END AS text FROM p),
        x AS (SELECT doc_id, page, text, length(text) AS len, row_number() OVER w - 1 AS r, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, count(*) OVER g AS n, sum(length(text)) OVER g AS t FROM p2 WINDOW w AS (PARTITION BY doc_id ORDER BY length(text), page), g AS (PARTITION BY doc_id)),
        y AS (SELECT *, floor((greatest(0, 1000 - 2 * (n - 1)) - b) / (n - r)) AS s FROM x), z AS (SELECT *, min(CASE WHEN len > s THEN r END) OVER (PARTITION BY doc_id) AS f FROM y), l AS (SELECT *, max(CASE WHEN r = f THEN s END) OVER (PARTITION BY doc_id) AS v FROM z),
        a AS (SELECT *, CASE WHEN t + 2 * (n - 1) <= 1000 OR f IS NULL OR r < f THEN len ELSE greatest(0, least(len, v)) END::BIGINT AS allowed FROM l),
        c AS (SELECT doc_id, page, len > allowed AS cut, CASE WHEN len > allowed THEN regexp_replace(regexp_replace(substr(text, 1, allowed), '\[[^\]\n]{{0,130}}\z', ''), '[\s\x0B\x{{85}}\p{{Z}}]+\z', '') || '…' ELSE text END AS part FROM a),
        j AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY page) || CASE WHEN bool_or(cut) THEN chr(10) || chr(10) || '[cut]' ELSE '' END AS text FROM c GROUP BY 1)
        SELECT doc_id, length(text) AS n, sha256(text) AS sha FROM j""",
    "prefix_budget": f"WITH {_P}, u AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY length(text) % 7 DESC, page ROWS UNBOUNDED PRECEDING) AS used FROM p) SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM u WHERE used <= 2000 GROUP BY 1",
    "skip_budget": f"""WITH RECURSIVE {_P}, r AS (SELECT doc_id, page, length(text) <= 600 AS kept, CASE WHEN length(text) <= 600 THEN length(text) ELSE 0 END AS used FROM p WHERE page = 1
        UNION ALL SELECT p.doc_id, p.page, r.used + length(text) <= 600, CASE WHEN r.used + length(text) <= 600 THEN r.used + length(text) ELSE r.used END FROM r JOIN p ON p.doc_id = r.doc_id AND p.page = r.page + 1)
        SELECT doc_id, page::INT AS page FROM r WHERE kept""",
    "cancelled_pairs": f"WITH {_TC} SELECT conv_id, turn FROM k",
    "history_trim": f"WITH {_T} SELECT conv_id, turn FROM (SELECT *, sum(length(text) + 1) OVER w AS used, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE used <= 800 OR rn = 1",
    "history_format": f"""WITH {_TC}, l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || CASE WHEN (conv_id + turn) % 7 = 0 THEN chr(92) || '[질문' || chr(92) || '] x' || chr(10) || chr(92) || '-' || chr(92) || '-' || chr(92) || '-' || chr(10) ELSE '' END || text AS line FROM k),
        h AS (SELECT *, sum(length(line) + 1) OVER w AS used, row_number() OVER w AS rn FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, chr(10) || '[이전 대화]' || chr(10) || string_agg(line, chr(10) ORDER BY turn) || chr(10) AS history FROM h WHERE used <= 900 OR rn = 1 GROUP BY 1""",
    "qa_retention": f"WITH {_T} SELECT conv_id, turn FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nr FROM t) WHERE nr >= CASE WHEN n > 3 THEN ceil((n - 3) / 2) * 2 ELSE 0 END",
    "session_stats": f"WITH {_M} SELECT count(*) AS n, sum(byte_size)::BIGINT AS bytes FROM m",
    "recent_list": f"WITH {_M} SELECT doc_id, last_accessed FROM m ORDER BY last_accessed DESC, doc_id LIMIT 20",
    "upsert_sessions": "WITH n AS (SELECT CASE WHEN doc_id % 8 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, source || '+' AS file_name FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, source AS file_name, doc_id * 2 AS created_at FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT n.doc_id, file_name, coalesce(d.doc_id * 2, 7) FROM n LEFT JOIN documents d ON d.doc_id = n.doc_id",
    "keep_index": f"WITH {_M} SELECT CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN coalesce(embed_model, '-') ELSE '-' END AS model, count(*) AS n, sum(CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN chunk_count ELSE 0 END)::BIGINT AS chunks FROM m GROUP BY 1",
    "summaries_merge": """WITH d AS (SELECT doc_id, doc_id % 3 = 0 AND doc_id % 5 <> 0 AS merged, CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'chapter' END AS kind FROM documents)
        SELECT doc_id, merged, 'keywords' AS kind, 'k' AS content FROM d UNION ALL SELECT doc_id, merged, 'full', CASE WHEN merged AND kind = 'full' THEN 'new' ELSE 'old' END FROM d UNION ALL SELECT doc_id, merged, 'chapter', 'new' FROM d WHERE merged AND kind = 'chapter'""",
    "patch_sessions": "WITH p AS (SELECT doc_id * 3 AS doc_id FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM p) THEN 'patched' ELSE source END AS file_name, 'row' AS kind FROM documents UNION ALL SELECT doc_id, '', 'refused' FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "touch_and_remove": "SELECT doc_id, CASE WHEN doc_id = 5 THEN 9999 ELSE doc_id * 37 % 1009 END AS last_accessed FROM documents WHERE doc_id % 6 <> 0",
    "reconcile": f"""WITH {_M}, u AS (SELECT doc_hash, row_number() OVER (ORDER BY min(doc_id)) - 1 AS k FROM m GROUP BY 1) SELECT CASE WHEN k % 7 = 0 THEN 'none' WHEN k % 3 > 0 THEN CASE WHEN k % 2 > 0 AND k % 4 = 0 THEN 'repair' ELSE 'none' END WHEN k % 6 = 0 THEN 'leave' WHEN k % 10 = 9 THEN 'remove' ELSE 'register' END AS action, count(*) AS n FROM u WHERE k % 3 > 0 OR k % 7 > 0 GROUP BY 1""",
    "tabs_merge": f"WITH {_M} SELECT doc_id, CASE WHEN doc_id >= 40 THEN CASE WHEN doc_id % 2 = 0 THEN 'new' WHEN doc_id < 50 THEN file_name ELSE '-' END ELSE file_name END AS file_name, CASE WHEN doc_id >= 40 THEN 1 ELSE page_count END::BIGINT AS page_count FROM m WHERE doc_id < 60",
    "normalize_entries": f"WITH {_M} SELECT doc_hash, count(*) AS n, max(least(512, length(file_name) * 200))::INT AS name_chars, sum(CASE WHEN doc_id % 4 = 3 THEN page_count ELSE 0 END)::BIGINT AS pages, min(CASE WHEN doc_id % 4 = 2 THEN '1970-01-01T00:00:00.000Z' ELSE '2024-01-02T03:04:05.000Z' END) AS created_at FROM m WHERE doc_id % 4 <> 0 GROUP BY 1",
    "persist_plan": f"WITH {_M} SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 OR (doc_id % 2 <> 0 AND doc_id % 3 = 0) THEN 'skip' WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'patch' ELSE 'full' END AS mode, doc_id % 17 = 0 OR doc_id % 19 = 0 OR chunk_count = 0 AS keep_index FROM m",
    "safe_href": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true ELSE regexp_matches(lower(trim(url)), '^(https?://|mailto:|#)') END AS safe FROM pages",
    "redact_paths": f"SELECT doc_id, '~ ~ ~ <share> <system> <path> <path> https://h/p ' || {_PATHLESS} AS text FROM documents",
    "redact_secrets": f"SELECT doc_id, 'Bearer [REDACTED] sk-ant-[REDACTED] sk-[REDACTED] AIza[REDACTED] sk-short ' || {_redacted(T.SECRETS)} AS text FROM documents",
    "vision_clean": r"SELECT doc_id, substr(regexp_replace('see [URL 제거됨] and [코드블록 제거됨]. ' || text, 'https?://\S+', '[URL 제거됨]', 'g'), 1, 500) AS text FROM documents",
    "conversational_filter": f"SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'Feel free to ask [p.3]' || chr(10) || rtrim(coalesce(text, ''), chr(10)) ELSE regexp_replace(regexp_replace(coalesce(text, ''), '^{_BL}', ''), '{_BL}$', '') END AS text FROM conversations",
    "request_errors": """SELECT doc_id, CASE WHEN doc_id % 20 IN (0, 18) THEN 'Invalid requestId' WHEN doc_id % 20 = 1 OR coalesce(text, '') = '' THEN 'Invalid text' WHEN doc_id % 20 IN (2, 3) THEN 'Invalid ollamaBaseUrl'
        WHEN doc_id % 20 = 4 THEN 'Invalid ollamaBaseUrl: localhost only' WHEN doc_id % 20 = 5 THEN 'Invalid type' WHEN doc_id % 20 = 6 THEN 'Invalid provider' WHEN doc_id % 20 IN (7, 8, 17) THEN 'Invalid model'
        WHEN doc_id % 20 = 9 THEN 'Invalid temperature' WHEN doc_id % 20 = 10 THEN 'Invalid language' WHEN doc_id % 20 IN (11, 12, 13) THEN 'Invalid customPrompt' ELSE 'ok' END AS error FROM documents""",
    "http_errors": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'cloudQuota' WHEN 1 THEN 'cloudRateLimit' WHEN 4 THEN '-' ELSE 'cloudOverloaded' END AS error, CASE event_id % 5 WHEN 0 THEN 3500 WHEN 1 THEN 60000 ELSE -1 END::BIGINT AS wait_ms FROM events",
    "progress_events": "SELECT event_id, ['pulling', 'pullingManifest', 'verifying', 'writing', 'success', 'preparing', 'raw'][1 + event_id % 7] AS event FROM events",
}
