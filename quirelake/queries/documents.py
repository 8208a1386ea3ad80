"""Queries over pages, chapters, chunks, citations and headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import citations as X
from ..operators import pages as P
from ..operators import trees as R
from ..sources.tables import manifest_of, pages_of, table
from .search import _BL, _M, _P


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages_of(_docs(spark, d))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text with citations at its end: a bare one, one of its own source, one of another document."""
    first = F.coalesce("text", F.lit(""))
    page = (F.col("doc_id") % 9).cast("string")
    text = F.concat(first, F.lit(" [p."), page, F.lit("]. And [ "), "source", F.lit(" p."), page, F.lit("|quote] or [other.pdf p. 3].\n- [p.4]"))
    return _docs(spark, d).select("doc_id", "source", text.alias("text"))


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Lines with headings: every third line is one, its level and indent by its number; every tenth is a fence; some lines have a citation."""
    head = F.concat(F.repeat(F.lit(" "), (F.col("page") % 4).cast("int")), F.repeat(F.lit("#"), (F.col("page") * 7 % 4 + 1).cast("int")), F.lit(" **T"), "page", F.lit("** ##"))
    cited = F.concat("text", F.lit(" [a "), F.col("page") % 2, F.lit(" p. "), F.col("page") % 4, F.lit("]"))
    mark = F.when(F.col("page") % 10 == 9, F.lit("```")).when(F.col("page") % 3 == 1, head).when(F.col("page") % 5 == 3, cited).otherwise(F.col("text"))
    return _pages(spark, d).select("doc_id", "page", mark.alias("text"))


def chars_per_token(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(T.chars_per_token(F.coalesce("text", F.lit(""))), 6).alias("cpt"), F.length(T.sample_evenly(F.col("text"))).alias("sampled"))


def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return P.page_offsets(_pages(spark, d)).select("doc_id", "page", F.col("offset").cast("long").alias("offset"))


def offset_to_page(spark: SparkSession, d: str) -> DataFrame:
    places = _docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(700).cast("long"))).alias("at"))
    return P.page_at(P.page_offsets(_pages(spark, d)), places)


def page_labels(spark: SparkSession, d: str) -> DataFrame:
    return P.label_pages(_pages(spark, d)).select("doc_id", F.length("labelled").alias("n"), F.sha2("labelled", 256).alias("sha"))


def empty_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.empty_pages(_pages(spark, d)).select("doc_id", "n_pages", "n_empty", "significant", "needs_ocr")


def page_range_mask(spark: SparkSession, d: str) -> DataFrame:
    return P.mask_pages(_pages(spark, d), 4, 2).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("chars"))


def chapters_fallback(spark: SparkSession, d: str) -> DataFrame:
    return P.fallback_chapters(_pages(spark, d))


def chapters_clipped(spark: SparkSession, d: str) -> DataFrame:
    return P.clip_chapters(P.fallback_chapters(_pages(spark, d)), 5, 12)


def chapters_detected(spark: SparkSession, d: str) -> DataFrame:
    head = F.when((F.col("page") % 4 == 2) & (F.col("doc_id") % 3 > 0), F.concat(F.lit("Chapter "), (F.col("page") / 8).cast("int") + 1, F.lit(" x\n"))).otherwise("")
    return P.detect_chapters(_pages(spark, d).withColumn("text", F.concat(head, "text")))


def chapter_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    chapters = P.fallback_chapters(pages).withColumn("chapter", F.col("chapter").cast("int"))
    return P.chapter_texts(chapters, pages).select("doc_id", F.col("chapter").cast("long").alias("chapter"), F.sha2("text", 256).alias("sha"))


def chunks_whole(spark: SparkSession, d: str) -> DataFrame:
    docs = P.joined(_pages(spark, d), "doc_id", "page", "text")
    return C.chunk_documents(docs, 500).select("doc_id", "chunk", F.length("text").alias("n"))


def chunks_overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_pages(_pages(spark, d)).select("doc_id", "chunk", F.length("text").alias("n"), "page_start", "page_end")


def image_notes(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    notes = pages.where("page <= 2").select("doc_id", "page", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("note", F.concat(F.lit("n"), "pos"))
    return P.enrich_pages(pages, notes).select("doc_id", "page", F.length("text").alias("n"))


def doc_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_hash"))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return P.dedupe_first(manifest_of(_docs(spark, d)).select("doc_hash", "doc_id", "file_name"), ["doc_hash"], ["doc_id"])


def sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("n", "sentence"))
    return rows.select("conv_id", "turn", F.col("n").cast("long").alias("n"), "sentence")


def citations_parse(spark: SparkSession, d: str) -> DataFrame:
    return X.parse(_cited(spark, d), "doc_id", "text").select("doc_id", F.col("n").cast("long").alias("n"), "page", "doc")


def citation_resolve(spark: SparkSession, d: str) -> DataFrame:
    tabs = manifest_of(_docs(spark, d)).where("doc_id < 12")
    return X.resolve(X.parse(_cited(spark, d), "doc_id", "text"), tabs).select("doc_id", F.col("n").cast("long").alias("n"), "page", "state", "target")


def citation_qualify(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).select("doc_id", T.qualify_citations(F.col("text"), F.concat(F.lit("[$a] "), "source")).alias("text"))


def citation_strip(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).select("doc_id", T.strip_citations(F.col("text")).alias("text"), T.strip_partial_citation(F.concat("text", F.lit(" [p.12"))).alias("cut"))


def citation_place(spark: SparkSession, d: str) -> DataFrame:
    """Citations on lines of their own, in brackets, after blank lines, before any text."""
    text = F.concat(F.lit("- [p.1]\n"), "text", F.lit(". \n\n*  [p.5|q] , ([p.6|r]).\nNext ( [p.7] )\n  [p.8]\n"))
    return X.place(_cited(spark, d).select("doc_id", text.alias("text")), "doc_id", "text")


def citation_segments(spark: SparkSession, d: str) -> DataFrame:
    return X.segments(_cited(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("page").alias("pages"), F.sum(F.length("content")).alias("chars"), F.count("doc").alias("named"))


def summary_tree(spark: SparkSession, d: str) -> DataFrame:
    tree = R.heading_tree(_headed(spark, d))
    return tree.select("doc_id", "line", F.col("level").cast("long").alias("level"), "title", F.coalesce("parent", F.lit(0)).alias("parent"), F.coalesce("cited_page", F.lit(0)).alias("cited_page"), F.coalesce("cited_doc", F.lit("-")).alias("cited_doc"))


def outline(spark: SparkSession, d: str) -> DataFrame:
    """Items: lines, under the line whose number is theirs divided by three."""
    items = _pages(spark, d).select("doc_id", F.col("page").alias("id"), F.when(F.col("page") > 3, F.floor(F.col("page") / 3).cast("int")).alias("parent"), F.when(F.col("page") % 5 > 0, F.concat(F.lit("t"), "page")).alias("title"), F.when(F.col("page") % 2 > 0, F.col("page")).alias("page"), F.col("page").alias("pos"))
    return R.outline(items, depth=3, most=500).select("doc_id", F.col("id").cast("long").alias("id"), F.col("level").cast("long").alias("level"), "title", F.col("rank").cast("long").alias("rank"))


def math_marks(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(r"\(x+"), F.col("doc_id").cast("string"), F.lit(r"\) and \[p. 3\] `\(a\)`"))
    return _docs(spark, d).select("doc_id", R.math_normalized(text).alias("text"))


def title_clean(spark: SparkSession, d: str) -> DataFrame:
    first = F.translate(F.substring(F.split(F.coalesce("text", F.lit("")), "\n", -1)[0], 1, 40), "*_`~", "")
    return _docs(spark, d).select("doc_id", T.clean_title(F.concat(F.lit("**"), "source", F.lit("** my_doc 2020~2024 ~~x~~ `y` 2 * 3 * 4 [p.3] "), first)).alias("title"))


QUERIES = {f.__name__: f for f in (chars_per_token, page_offsets, offset_to_page, page_labels, empty_pages, page_range_mask, chapters_fallback, chapters_clipped, chapters_detected, chapter_texts, chunks_whole, chunks_overlap, image_notes, doc_hash, dedupe_first, sentences, citations_parse, citation_resolve, citation_qualify, citation_strip, citation_place, citation_segments, summary_tree, outline, math_marks, title_clean)}

_O = f"{_P}, o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p)"
_C = """c AS (SELECT doc_id, source, coalesce(text, '') || ' [p.' || doc_id % 9 || ']. And [ ' || source || ' p.' || doc_id % 9 || '|quote] or [other.pdf p. 3].' || chr(10) || '- [p.4]' AS text FROM documents)"""
_CIT = r"(?i)\[(?:([^\[\]|\n]{1,120}?)\s+)?p\.\s*(\d+)(?:\s*\|\s*[^\]\n]{0,200})?\s*\]"
_VALID = _CIT.replace(r"(\d+)", r"(0*[1-9]\d*)")
_CP = f"""{_C}, x AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CIT}', 1)) AS doc, unnest(regexp_extract_all(text, '{_CIT}', 2))::BIGINT AS page, generate_subscripts(regexp_extract_all(text, '{_CIT}', 2), 1) AS i FROM c),
    y AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, page, CASE WHEN doc <> '' THEN doc END AS doc FROM x WHERE page >= 1)"""
ORACLES = {
    "chars_per_token": r"""WITH s AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE array_to_string(list_transform(range(0, 10), lambda i: substr(text, i * (length(text) // 10) + 1, 200)), '') END AS s FROM documents)
        SELECT doc_id, round(greatest(1.5, 4 - 2.5 * length(regexp_replace(s, '[^　-鿿가-힯豈-﫿]', '', 'g')) / greatest(length(s), 1)), 6) AS cpt, length(s) AS sampled FROM s""",
    "page_offsets": f"WITH {_O} SELECT doc_id, page, off AS offset FROM o",
    "offset_to_page": f"WITH {_O}, q AS (SELECT doc_id, unnest(range(0, length(text) + 1, 700)) AS at FROM documents) SELECT q.doc_id, q.at, o.page FROM q ASOF JOIN o ON q.doc_id = o.doc_id AND q.at >= o.off",
    "page_labels": f"""WITH {_P}, g AS (SELECT doc_id, page, text, generate_series AS k FROM p, generate_series(0, 200) WHERE k * 1500 < length(text) AND trim(regexp_replace(text, '{_BL}', ' ', 'g')) <> ''),
        l AS (SELECT doc_id, page, k, '[p.' || page || '] ' || regexp_replace(regexp_replace(substr(text, k * 1500 + 1, 1500), '^{_BL}', ''), '{_BL}$', '') AS t FROM g), a AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page, k) AS t FROM l GROUP BY 1) SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM a""",
    "empty_pages": f"WITH {_P}, e AS (SELECT doc_id, length(regexp_replace(text, '{_BL}', '', 'g')) AS s FROM p) SELECT doc_id, count(*) AS n_pages, sum((s = 0)::INT)::BIGINT AS n_empty, (n_empty >= 2 AND n_empty / count(*) > 0.1) AS significant, sum(s) < 50 AS needs_ocr FROM e GROUP BY 1",
    "page_range_mask": f"WITH {_P}, m AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS n FROM p) SELECT doc_id, count(*) AS n_pages, sum(CASE WHEN page BETWEEN least(n, 2) AND least(n, 4) THEN length(text) ELSE 0 END)::BIGINT AS chars FROM m GROUP BY 1",
    "chapters_fallback": f"WITH {_P} SELECT doc_id, (page - 1) // 10 AS chapter, min(page)::INT AS start_page, max(page)::INT AS end_page FROM p GROUP BY ALL",
    "chapters_clipped": f"WITH {_P}, c AS (SELECT doc_id, (page - 1) // 10 AS chapter, min(page) AS a, max(page) AS b FROM p GROUP BY ALL) SELECT doc_id, chapter, greatest(a, 5)::INT AS start_page, least(b, 12)::INT AS end_page FROM c WHERE a <= 12 AND b >= 5",
    "chapter_texts": f"WITH {_P} SELECT doc_id, (page - 1) // 10 AS chapter, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS sha FROM p GROUP BY ALL",
    "image_notes": f"WITH {_P} SELECT doc_id, page, length(text) + CASE WHEN page <= 2 THEN 2 * length('[이미지 분석: n0]') + 2 ELSE 0 END AS n FROM p",
    "doc_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS doc_hash FROM documents",
    "dedupe_first": "SELECT doc_hash, doc_id, source AS file_name FROM (SELECT *, sha256(coalesce(text, '')) AS doc_hash FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY doc_id) = 1",
    "sentences": rf"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '{_CIT}', '', 'g'), '{_BL}', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant'),
        s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '([.!?])([가-힯぀-ヿ一-鿿])', '\1' || chr(1) || '\2', 'g'), '([。！？])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 15) AS s FROM t)
        SELECT conv_id, turn, unnest(range(0, len(s))) AS n, unnest(s) AS sentence FROM s""",
    "citations_parse": f"WITH {_CP} SELECT doc_id, n, page, doc FROM y",
    "citation_resolve": f"WITH {_CP}, {_M}, t AS (SELECT file_name, count(*) AS k, min(doc_hash) AS target, min(page_count) AS pages FROM m WHERE doc_id < 12 GROUP BY 1) SELECT y.doc_id, n, page, CASE WHEN doc IS NULL THEN 'bare' WHEN k IS NULL THEN 'closed' WHEN k > 1 THEN 'ambiguous' WHEN page > pages THEN 'invalid' ELSE 'ok' END AS state, CASE WHEN state = 'ok' THEN target END AS target FROM y LEFT JOIN t ON y.doc = t.file_name",
    "citation_qualify": rf"WITH {_C} SELECT doc_id, regexp_replace(text, '(?i)\[p\.\s*(\d+)(?:\s*\|\s*[^\]\n]{{0,200}})?\s*\]', '[$a ' || source || ' p.\1]', 'g') AS text FROM c",
    "citation_place": f"""WITH {_C} SELECT doc_id, '[p.1]' || chr(10) || left(text, length(text) - 9) || '[p.4][p.5|q][p.6|r].' || chr(10) || chr(10) || 'Next [p.7][p.8]' || chr(10) AS text FROM c""",
    "citation_segments": rf"""WITH {_C}, x AS (SELECT doc_id, text, regexp_extract_all(text, '{_VALID}', 0) AS m, regexp_extract_all(text, '{_VALID}', 1) AS d, regexp_extract_all(text, '{_VALID}', 2) AS p, regexp_replace(text, '{_VALID}', chr(1), 'g') AS r FROM c)
        SELECT doc_id, len(m) + len(list_filter(string_split(r, chr(1)), lambda z: z <> '')) AS n, list_sum(list_transform(p, lambda z: z::BIGINT))::BIGINT AS pages, (length(text) - list_sum(list_transform(m, lambda z: length(z))))::BIGINT AS chars, len(list_filter(d, lambda z: z <> ''))::BIGINT AS named FROM x""",
    "citation_strip": f"WITH {_C} SELECT doc_id, regexp_replace(text, '{_CIT}', '', 'g') AS text, text || ' ' AS cut FROM c",
    "summary_tree": f"""WITH {_P}, h AS (SELECT doc_id, page, CASE WHEN page % 10 = 9 THEN '```' WHEN page % 3 = 1 THEN repeat(' ', (page % 4)::INT) || repeat('#', (page * 7 % 4 + 1)::INT) || ' **T' || page || '** ##' WHEN page % 5 = 3 THEN text || ' [a ' || page % 2 || ' p. ' || page % 4 || ']' ELSE text END AS text FROM p),
        f AS (SELECT *, regexp_matches(text, '^\\s*(```|~~~)')::INT AS fence FROM h), g AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY page) AS o, sum(fence) OVER (PARTITION BY doc_id) AS t FROM f),
        k AS (SELECT doc_id, page AS line, CASE WHEN t % 2 = 0 AND (fence = 1 OR o % 2 = 1) THEN 0 ELSE length(regexp_extract(text, '^ {{0,3}}(#{{1,6}})\\s+.', 1)) END AS level, text FROM g),
        l AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM k WHERE level > 0),
        c AS (SELECT doc_id, line, regexp_extract(text, '{_CIT}', 2)::BIGINT AS page, trim(regexp_extract(text, '{_CIT}', 1)) AS doc FROM k WHERE regexp_matches(text, '{_CIT}')),
        s AS (SELECT l.doc_id, l.line, arg_min(c.page, c.line) AS page, arg_min(c.doc, c.line) AS doc FROM l JOIN c ON c.doc_id = l.doc_id AND c.line >= l.line AND (nxt IS NULL OR c.line < nxt) GROUP BY ALL)
        SELECT a.doc_id, a.line::INT AS line, a.level::BIGINT AS level, 'T' || a.line AS title, coalesce(max(b.line), 0)::INT AS parent, coalesce(any_value(s.page), 0) AS cited_page, coalesce(any_value(CASE WHEN s.page >= 1 AND s.doc <> '' THEN s.doc END), '-') AS cited_doc
        FROM l a LEFT JOIN l b ON a.doc_id = b.doc_id AND b.line < a.line AND b.level < a.level LEFT JOIN s ON s.doc_id = a.doc_id AND s.line = a.line GROUP BY a.doc_id, a.line, a.level""",
    "outline": f"""WITH RECURSIVE {_P}, i AS (SELECT doc_id, page AS id, CASE WHEN page > 3 THEN page // 3 END AS parent, CASE WHEN page % 5 > 0 THEN 't' || page END AS title, CASE WHEN page % 2 > 0 THEN page END AS page FROM p),
        r AS (SELECT *, 1 AS level, lpad(id::VARCHAR, 9, '0') || '/' AS path FROM i WHERE parent IS NULL UNION ALL SELECT i.*, level + 1, path || lpad(i.id::VARCHAR, 9, '0') || '/' FROM i JOIN r ON i.doc_id = r.doc_id AND i.parent = r.id WHERE level < 3),
        k AS (SELECT * FROM r WHERE NOT (title IS NULL AND page IS NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = r.doc_id AND i.parent = r.id)))
        SELECT doc_id, id, level::BIGINT AS level, coalesce(title, '—') AS title, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rank FROM k QUALIFY rank <= 500""",
    "math_marks": "SELECT doc_id, '$$x+' || doc_id || '$$ and ' || chr(92) || '[p. 3' || chr(92) || '] `' || chr(92) || '(a' || chr(92) || ')`' AS text FROM documents",
    "title_clean": f"SELECT doc_id, trim(regexp_replace(source || ' my_doc 2020~2024 x y 2 * 3 * 4 ' || translate(substr(string_split(coalesce(text, ''), chr(10))[1], 1, 40), '*_`~', ''), '{_BL}', ' ', 'g')) AS title FROM documents",
}
