"""Queries over restoring, members, images and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import collection as L
from ..operators import prompts as M
from ..operators import session as S
from ..operators import store as O
from ..plans import questions as Q
from ..plans import retrieval as R
from ..sources.shared import stored
from ..sources.tables import manifest_of, pages_of, table
from .search import _M, _P


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest_of(table(spark, d, "documents"))


def restore_session(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    rows = m.withColumns({"schema_version": F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1), "n_vectors": F.col("chunk_count") - F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)})
    return S.restore_index(rows, "base", 64).select("doc_id", "with_index")


def restore_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 > 0, F.col("text")).alias("content"))
    return S.restore_messages(rows).select("conv_id", "turn")


def restore_summaries(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    rows = m.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "full").when(F.col("doc_id") % 3 == 1, "mystery").otherwise(F.concat(F.lit("custom:t"), F.col("doc_id") % 5)).alias("kind"))
    return S.restore_summaries(rows, spark.createDataFrame([("t1",), ("t3",)], "id string"))


def open_collection(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return S.open_collection(m.select(F.col("file_name").alias("id"), "doc_hash"), m.where("doc_id % 3 = 0"))


def union_members(spark: SparkSession, d: str) -> DataFrame:
    m = O.unique_members(_manifest(spark, d).select(F.col("file_name").alias("id"), F.col("doc_id").alias("pos"), "doc_hash"), 10)
    return S.union_members(m.where("pos = 4").select("id", "doc_hash"), m)


def embedding_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    requests = e.groupBy(F.col("label").alias("request")).agg(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string")).alias("texts"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    answers = e.select(F.col("label").alias("request"), place.alias("index"), F.col("embedding").alias("vector"), "vec_id").where("vec_id % 4 > 0")
    got = S.restore_order(requests, answers)
    return got.select("request", F.col("text").cast("long").alias("vec_id"), F.col("vector").isNotNull().alias("there"), F.round(F.coalesce(F.col("vector")[0].cast("double"), F.lit(0.0)), 5).alias("x"))


def accept_images(spark: SparkSession, d: str) -> DataFrame:
    pages = pages_of(table(spark, d, "documents"))
    images = pages.select("doc_id", (F.floor((F.col("page") - 1) / 4) + 1).alias("page"), F.col("page").alias("pos"), (F.length("text") % 300).alias("width"), F.lit(120).alias("height"))
    kept = S.accept_images(images, accepted=6, examined=20, per_page=2)
    return kept.select("doc_id", F.col("pos").cast("long").alias("pos"), S.scaled(F.col("width") * 10, F.col("height") * 10)["width"].cast("long").alias("w"))


def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(S.batch_of(F.col("vec_id")).alias("batch")).agg(F.count("*").alias("n"), S.eta_ms(F.sum("vec_id") * F.lit(1.0), F.count("*"), F.lit(500)).alias("eta"))


def collection_context(spark: SparkSession, d: str) -> DataFrame:
    """Per source: its first ten documents' first lines as hits of a collection."""
    docs = table(spark, d, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.col("doc_id") % 13), "doc_id"))
    hits = pages_of(docs).where("page = 1").join(docs.select("doc_id", "source"), "doc_id")
    hits = hits.select("source", rank.alias("rank"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("doc"), F.lit(0).alias("idx"), F.substring("text", 1, 300).alias("text"), F.when(F.col("doc_id") % 2 == 0, 1).alias("page"), F.concat(F.lit("a|"), "source").alias("file_name")).where("rank <= 10")
    return R.context(hits, "source", budget=1200, named=True).select("source", F.length("context").alias("n"), F.sha2("context", 256).alias("sha"))


def collections_lru(spark: SparkSession, d: str) -> DataFrame:
    """Collections by last use: the fifteen that stay."""
    c = _manifest(spark, d).groupBy(F.col("file_name").alias("id")).agg(F.max("last_accessed").alias("last_accessed"))
    return c.orderBy(F.desc("last_accessed"), "id").limit(15)


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels as collections of seven documents each; every fifth is not ready, some ready ones have no vectors."""
    e = table(spark, d, "embeddings")
    doc = F.concat(F.lit("d"), F.col("vec_id") % 7)
    index = e.where("vec_id % 7 <> 6 or label % 3 > 0").select(F.concat("label", F.lit("-"), doc).alias("doc_hash"), F.col("vec_id").alias("chunk"), F.concat(F.lit("t"), "vec_id").alias("text"), F.when(F.col("vec_id") % 5 > 0, F.col("vec_id") % 5).alias("page_start"), "embedding")
    members = e.select(F.col("label").alias("id"), (F.col("vec_id") % 7).alias("pos")).distinct()
    members = members.select("id", "pos", F.concat("id", F.lit("-d"), "pos").alias("doc_hash"), F.when(F.col("pos") == 2, "[|]").otherwise(F.concat(F.lit("f"), "pos")).alias("file_name"), F.when((F.col("id") + F.col("pos")) % 5 == 4, "missing").otherwise("ready").alias("status"), (F.col("pos") == F.col("id") % 7).alias("active"))
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return members, index, members.select("id").distinct().crossJoin(F.broadcast(q))  # one row


def collection_answer_context(spark: SparkSession, d: str) -> DataFrame:
    """Contexts for one question from four members at most of each collection."""
    out = Q.collection_context(*_asked(spark, d), most=4, least=-1.0)
    return out.select(F.col("id").cast("long").alias("id"), F.length("context").alias("n"), F.sha2("context", 256).alias("sha"), "degraded")


def collection_states(spark: SparkSession, d: str) -> DataFrame:
    members, index, _ = _asked(spark, d)
    out = L.collection_state(L.effective_members(members, 6), index)
    return out.select(F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"), F.col("dim").cast("long").alias("dim"), F.col("loaded").cast("long").alias("loaded"), F.col("expected").cast("long").alias("expected"), "truncated", "degraded")


def small_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules on single values: addresses in recognised text, transport errors, sizes, ranges, paths, images, summaries."""
    k = F.col("doc_id") % 8
    text = F.concat(F.lit("see https://a.b/c?d "), F.coalesce("text", F.lit("")))
    code = F.element_at(F.array(*[F.lit(x) for x in ("ECONNREFUSED", "EAI_AGAIN", "ENETUNREACH", "ECONNRESET", "ETIMEDOUT", "EPIPE", "ENOTFOUND", "x")]), (k + 1).cast("int"))
    size = F.when(k == 0, "nan").when(k == 1, "-5").when(k == 2, "0").when(k == 3, "abc").when(k == 4, "4000").when(k == 5, "Infinity").when(k == 6, "12.5")
    one = lambda content: F.struct(content.alias("content"))
    summaries = F.create_map(F.lit("full"), one(F.when(k % 3 == 0, "").otherwise("F")), F.lit("chapter"), one(F.lit("C")))
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(T.clean_ocr(text), 256).alias("ocr"), S.transport_error(code).alias("transport"), T.good_size(size, 500).alias("size"),
        T.full_range(F.when(k > 0, k), k + 1, F.lit(5)).alias("whole"), T.readable_again(F.concat(F.when(k % 2 == 0, "/a/").when(k == 1, "c:\\x").otherwise("x"), "source")).alias("readable"),
        T.raster_kind(F.lit(10), k + 1, F.lit(90)).alias("raster"), T.pick_summary(summaries, F.when(k % 2 == 0, "full").otherwise("qa")).alias("picked"),
        T.clamp_page(k, F.lit(5)).cast("long").alias("page"), T.ocr_scale(F.col("doc_id") % 160).cast("double").alias("scale"),
    )


def searchable_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    k = F.col("vec_id") % 6
    v = F.when(k == 1, F.slice("embedding", 1, 63)).when(k == 2, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return e.select("vec_id", T.searchable(F.when(k == 3, "").otherwise("m"), F.when(k == 4, 0.0).when(k == 5, 64.5).otherwise(64.0), v).alias("ok"))


def stored_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose vectors are too large lose them; sidecars replace older chunk lists."""
    m = _manifest(spark, d).withColumns({"blob_bytes": F.col("chunk_count").cast("long") * 256, "chunk_meta": F.when(F.col("doc_id") % 2 == 0, "old")})
    side = m.where("doc_id % 3 = 0").select("doc_hash", F.lit("new").alias("chunk_meta"))
    out = O.cap_index(O.with_chunks(m, side), most=1024)
    return out.select("doc_id", F.coalesce("embed_model", F.lit("-")).alias("model"), F.col("chunk_count").cast("long").alias("chunks"), F.coalesce("chunk_meta", F.lit("-")).alias("meta"), O.stored_bytes(F.col("file_name"), F.col("blob_bytes"), F.col("chunk_meta")).cast("long").alias("bytes"))


def answered_question(spark: SparkSession, d: str) -> DataFrame:
    """The whole question pipeline with the stand-in models."""
    docs = table(spark, d, "documents")
    index = stored(R.build_index(pages_of(docs), M.HashEmbedder()), "index")
    return Q.answer_question(index, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "where is erat and the tion?", M.HashEmbedder(), M.ExtractiveGenerator(), least=0.1)


QUERIES = {f.__name__: f for f in (restore_session, restore_messages, restore_summaries, open_collection, union_members, embedding_order, accept_images, embedding_batches, collection_context, collections_lru, collection_answer_context, collection_states, small_rules, searchable_vectors, stored_sessions, answered_question)}

_AM = """x AS (SELECT *, label || '-d' || vec_id % 7 AS doc_hash, CASE WHEN vec_id % 5 > 0 THEN vec_id % 5 END AS page FROM embeddings WHERE vec_id % 7 <> 6 OR label % 3 > 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (pos = id % 7) DESC, pos) AS rank, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT label AS id, vec_id % 7 AS pos, label || '-d' || vec_id % 7 AS doc_hash, CASE WHEN vec_id % 7 = 2 THEN '[|]' ELSE 'f' || vec_id % 7 END AS file_name FROM embeddings WHERE (label + vec_id % 7) % 5 <> 4))"""
ORACLES = {
    "restore_session": f"WITH {_M} SELECT doc_id, coalesce(doc_id % 10 <> 0 AND embed_model = 'base' AND embed_dim = 64 AND doc_id % 6 <> 0 AND chunk_count > 0, false) AS with_index FROM m",
    "restore_messages": "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND turn % 3 > 0 AND text IS NOT NULL",
    "restore_summaries": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'mystery' ELSE 'custom:t' || doc_id % 5 END AS kind FROM documents WHERE doc_id % 3 < 2 OR doc_id % 5 IN (1, 3)",
    "open_collection": f"WITH {_M}, k AS (SELECT DISTINCT doc_hash FROM m WHERE doc_id % 3 = 0) SELECT file_name AS id, count(*) AS n, count(k.doc_hash) AS n_open, count(k.doc_hash) > 0 AND count(k.doc_hash) < count(*) AS partial FROM m LEFT JOIN k USING (doc_hash) GROUP BY 1",
    "union_members": f"WITH {_M}, u AS (SELECT file_name AS id, doc_hash, row_number() OVER (PARTITION BY file_name ORDER BY min(doc_id)) - 1 AS p FROM m GROUP BY file_name, doc_hash) SELECT id, doc_hash, (CASE WHEN p = 4 THEN 0 WHEN p < 4 THEN p + 1 ELSE p END)::INT AS pos FROM u WHERE p < 10",
    "embedding_order": "SELECT label AS request, vec_id, vec_id % 4 > 0 AS there, round(CASE WHEN vec_id % 4 > 0 THEN embedding[1]::DOUBLE ELSE 0 END, 5) AS x FROM embeddings",
    "accept_images": f"""WITH {_P}, i AS (SELECT doc_id, (page - 1) // 4 + 1 AS pg, page AS pos, length(text) % 300 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS s FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pg ORDER BY pos) AS o FROM i WHERE s <= 20 AND least(w, 120) >= 50), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pg, pos) AS r FROM k WHERE o <= 2)
        SELECT doc_id, pos, round(w * 10 * least(1.0, 1024 / greatest(w * 10, 1200)))::BIGINT AS w FROM n WHERE r <= 6""",
    "embedding_batches": "SELECT vec_id // 50 AS batch, count(*) AS n, round(sum(vec_id)::DOUBLE / count(*) * (500 - count(*))) AS eta FROM embeddings GROUP BY 1",
    "collection_context": """WITH RECURSIVE h AS (SELECT source, doc_id, '[a ' || source || CASE WHEN doc_id % 2 = 0 THEN ' p.1' ELSE '' END || ']' || chr(10) || substr(string_split(coalesce(text, ''), chr(10))[1], 1, 300) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id % 13 DESC, doc_id) AS rank FROM documents),
        r AS (SELECT source, doc_id, s, rank, length(s) <= 1200 AS kept, CASE WHEN length(s) <= 1200 THEN length(s) ELSE 0 END AS used FROM h WHERE rank = 1
        UNION ALL SELECT h.source, h.doc_id, h.s, h.rank, r.used + length(h.s) <= 1200, CASE WHEN r.used + length(h.s) <= 1200 THEN r.used + length(h.s) ELSE r.used END FROM r JOIN h ON h.source = r.source AND h.rank = r.rank + 1 WHERE h.rank <= 10),
        c AS (SELECT source, string_agg(s, chr(10) || chr(10) ORDER BY doc_id) AS c FROM r WHERE kept GROUP BY 1) SELECT source, length(c) AS n, sha256(c) AS sha FROM c""",
    "collections_lru": f"WITH {_M} SELECT file_name AS id, max(last_accessed) AS last_accessed FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "collection_answer_context": f"""WITH {_AM}, s AS (SELECT m.id, x.doc_hash, m.file_name, x.vec_id, x.page, greatest(-1, least(1, list_dot_product(x.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)))) AS score FROM (SELECT * FROM u WHERE rank <= 4) m JOIN x USING (doc_hash)),
        t AS (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY score DESC, vec_id) AS r FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_hash, vec_id) AS r2 FROM t WHERE r <= 5),
        c AS (SELECT id, string_agg(CASE WHEN file_name = '[|]' THEN coalesce('[p.' || page || ']', '') ELSE '[' || file_name || coalesce(' p.' || page, '') || ']' END || chr(10) || 't' || vec_id, chr(10) || chr(10) ORDER BY doc_hash, vec_id) AS c FROM b WHERE r2 <= 8 GROUP BY 1),
        g AS (SELECT u.id, count(DISTINCT x.doc_hash) AS loaded, count(DISTINCT u.doc_hash) AS expected, any_value(n > 4) AS truncated FROM u LEFT JOIN x USING (doc_hash) WHERE rank <= 4 GROUP BY 1)
        SELECT id::BIGINT AS id, length(c) AS n, sha256(c) AS sha, c IS NULL OR loaded < 2 OR loaded < expected OR truncated AS degraded FROM (SELECT DISTINCT label AS id FROM embeddings) a LEFT JOIN c USING (id) LEFT JOIN g USING (id)""",
    "collection_states": f"""WITH {_AM}, g AS (SELECT u.id, count(x.doc_hash) AS size, count(DISTINCT x.doc_hash) AS loaded, count(DISTINCT u.doc_hash) AS expected, any_value(n > 6) AS truncated FROM u LEFT JOIN x USING (doc_hash) WHERE rank <= 6 GROUP BY 1)
        SELECT id::BIGINT AS id, size, CASE WHEN size > 0 THEN 64 END::BIGINT AS dim, loaded, expected, truncated, loaded < 2 OR loaded < expected OR truncated AS degraded FROM g""",
    "small_rules": r"""WITH d AS (SELECT *, doc_id % 8 AS k, regexp_replace('see ' || ' ' || coalesce(text, ''), 'https?://\S+', '', 'g') AS o FROM documents)
        SELECT doc_id, sha256(CASE WHEN length(o) > 12000 THEN left(o, 12000) || chr(10) || chr(10) || '[...]' ELSE o END) AS ocr, CASE WHEN k IN (0, 1, 2, 4, 6) THEN 'streamConnectFailed' ELSE 'streamDisconnected' END AS transport,
               CASE k WHEN 4 THEN 4000.0 WHEN 6 THEN 12.5 ELSE 500.0 END::DOUBLE AS size, k = 0 OR k <= 1 AND k + 1 >= 5 AS whole, k % 2 = 0 OR k = 1 AS readable,
               CASE WHEN 90 >= 40 * (k + 1) THEN 'rgba' WHEN 90 >= 30 * (k + 1) THEN 'rgb' WHEN 90 >= 10 * (k + 1) THEN 'gray' END AS raster, CASE WHEN k % 3 = 0 THEN '' ELSE 'F' END AS picked,
               CASE WHEN k BETWEEN 1 AND 5 THEN k END::BIGINT AS page, CASE WHEN doc_id % 160 > 100 THEN 1.0 WHEN doc_id % 160 > 50 THEN 1.5 ELSE 2.0 END::DOUBLE AS scale FROM d""",
    "searchable_vectors": "SELECT vec_id, vec_id % 6 = 0 AS ok FROM embeddings",
    "stored_sessions": f"""WITH {_M}, h AS (SELECT DISTINCT doc_hash FROM m WHERE doc_id % 3 = 0), z AS (SELECT m.*, chunk_count * 256 > 1024 AS cut, CASE WHEN h.doc_hash IS NOT NULL THEN 'new' WHEN doc_id % 2 = 0 THEN 'old' END AS meta0 FROM m LEFT JOIN h USING (doc_hash))
        SELECT doc_id, CASE WHEN cut THEN '-' ELSE coalesce(embed_model, '-') END AS model, CASE WHEN cut THEN 0 ELSE chunk_count END AS chunks, coalesce(meta0, '-') AS meta, (strlen(file_name) + CASE WHEN cut THEN 0 ELSE chunk_count * 256 END + coalesce(strlen(meta0), 0))::BIGINT AS bytes FROM z""",
}
