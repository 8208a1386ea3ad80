"""Text functions on columns. Lengths and cuts count code points; blanks are Unicode blanks where a name says so."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, words and replacements that results depend on.
BLANK = r"(?U)\s"
CITATION = r"(?i)\[(?:([^\[\]|\n]{1,120}?)\s+)?p\.\s*(\d+)(?:\s*\|\s*[^\]\n]{0,200})?\s*\]"
BARE_CITATION = r"(?i)\[p\.\s*(\d+)(?:\s*\|\s*[^\]\n]{0,200})?\s*\]"
PARTIAL_CITATION = r"\[[^\]\n]{0,130}\z"
TOC_LINE = r"[.·…]{2,}\s*\d+\s*\z|\s{3,}\d+\s*\z"
HEADING = r"(?i)^(제?\d+[장절]|chapter\s*\d+|\d+장)"
CJK_CHARS = r"[　-鿿가-힯豈-﫿]"
STOP_WORDS = (
    "은 는 이 가 을 를 의 에 에서 로 으로 과 와 도 만 부터 까지 보다 처럼 같은 그 저 이것 그것 저것 것 수 등 및 하다 되다 있다 없다 않다 대해 대한 통해 "
    "the a an is are was were in on at to for of with by from as and or not that this it be has have had do does what which how why when where who"
).split()
SENTENCE_END = r"(?<=[.!?])\s+(?=\S)|(?<=[.!?])(?=[가-힯぀-ヿ一-鿿])|(?<=[。！？])\s*(?=\S)"
SMALL_TALK = (
    r"도움이\s*되[길었]?\s*(바랍|되었|되셨)",
    r"궁금한\s*(점|사항|것|내용)이?\s*(있으시면|있으면)",
    r"추가(로|적인)?\s*(궁금|질문|문의)",
    r"언제든지?\s*(물어|말씀|문의|연락)",
    r"말씀해\s*주세요",
    r"필요하시면\s*(언제|말씀|연락)",
    r"자세한\s*정보가?\s*필요하시면",
    r"요약해\s*드리겠습니다",
    r"설명해\s*드리겠습니다",
    r"정리해\s*드리겠습니다",
    r"알려\s*드리겠습니다",
    r"다루고\s*있습니다\s*[:：]\s*$",
    r"^주요\s*내용을?\s*요약\s*[:：]?\s*$",
    r"이상으로\s*.*(마치|끝|정리)",
    r"좋은\s*자료입니다",
    r"잘\s*정리되어",
    r"강점을\s*잘\s*보여",
    r"도움이\s*되(었으면|길)\s*좋겠",
    r"(?i)^(I\s+)?hope\s+this\s+helps",
    r"(?i)feel\s+free\s+to\s+ask",
    r"(?i)let\s+me\s+know\s+if\s+you",
    r"(?i)if\s+you\s+have\s+any\s+(other\s+)?questions",
    r"(?i)I['’]d\s+be\s+happy\s+to\s+help",
    r"(?i)here['’]?s?\s+(a\s+)?summary\s+of",
    r"(?i)in\s+conclusion\s*[,.:]",
    r"(?i)to\s+summarize\s*[,.:]",
    r"お役に立てれば",
    r"ご質問があれば",
    r"^以上(です|になります|となります)",
    r"お気軽にお聞き",
    r"^.{0,12}要約(いた)?します[。：:]?\s*$",
    r"希望(对你|这)有(所)?帮助",
    r"如有(任何)?疑问",
    r"^以上(就是|是|为)",
    r"总结如下\s*[：:]?\s*$",
)
PATHS = (
    (r"""(?i)[A-Z]:\\Users\\[^\\\s"'<>|?*]+(?:\\[^\s"'<>|?*]+)*""", "~"),
    (r"""(?i)\b[A-Z]:/Users/[^/\s"'<>|?*]+(?:/[^\s"'<>|?*]+)*""", "~"),
    (r"""/Users/[^/\s"'<>|?*]+(?:/[^\s"'<>|?*]+)*""", "~"),
    (r"""/home/[^/\s"'<>|?*]+(?:/[^\s"'<>|?*]+)*""", "~"),
    (r"""\\\\[^\\\s"'<>|?*]+\\[^\\\s"'<>|?*]+(?:\\[^\s"'<>|?*]+)*""", "<share>"),
    (r"""/(?:etc|var|usr|opt|tmp|private|boot|sys|proc|dev|run|srv|mnt|media)(?:/[^\s"'<>|?*]*)?""", "<system>"),
    (r"""(?i)[A-Z]:\\[^\s"'<>|?*]+""", "<path>"),
    (r"""(?i)\b[A-Z]:/(?!/)[^\s"'<>|?*]+""", "<path>"),
)
SECRETS = (
    (r"(?i)Bearer\s+[A-Za-z0-9._~\-+/=]+", "Bearer [REDACTED]"),
    (r"\bsk-ant-[A-Za-z0-9_\-]{20,}\b", "sk-ant-[REDACTED]"),
    (r"\bsk-(?:proj-|test-|live-)?[A-Za-z0-9_\-]{20,}\b", "sk-[REDACTED]"),
    (r"\bAIza[A-Za-z0-9_\-]{30,}\b", "AIza[REDACTED]"),
)
URL_GONE, CODE_GONE = "[URL 제거됨]", "[코드블록 제거됨]"
SECTIONS = ("[질문]", "[이전 대화]", "[요약 내용]", "[원문 관련 부분]")
BAD_URL_CHAR = r"[\u0000-\u001F\u007F‪-‮⁦-⁩]"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once a row however often it is named, inside other functions too."""
    return F.transform(F.array(value), of)[0]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def solid_length(c: Column) -> Column:
    """Code points that are not blanks."""
    return F.length(F.regexp_replace(c, BLANK, ""))


def replace_all(c: Column, rules: tuple) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def redact_paths(c: Column) -> Column:
    return replace_all(c, PATHS)


def redact_secrets(c: Column) -> Column:
    return replace_all(c, SECRETS)


def clean_vision(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"https?://\S+", URL_GONE), r"(?s)```.*?```", CODE_GONE), 1, 500)


def clean_ocr(c: Column, most: int = 12_000, marker: str = "\n\n[...]") -> Column:
    """Without addresses; a cut is marked."""
    gone = F.regexp_replace(c, r"https?://\S+", "")
    return F.when(F.length(gone) > most, F.concat(F.substring(gone, 1, most), F.lit(marker))).otherwise(gone)


def sample_evenly(c: Column, size: int = 2000, buckets: int = 10) -> Column:
    """Equal pieces at equal strides; a short text as it is."""
    each, stride = size // buckets, F.floor(F.length(c) / buckets).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.substring(c, i * stride + 1, F.lit(each)))
    return F.when(F.length(c) <= size, c).otherwise(F.array_join(parts, ""))


def chars_per_token(c: Column) -> Column:
    ratio = lambda s: (F.length(s) - F.length(F.regexp_replace(s, CJK_CHARS, ""))) / F.greatest(F.length(s), F.lit(1))
    return F.greatest(F.lit(1.5), 4 - 2.5 * once(sample_evenly(c), ratio))


def split_points(c: Column, size: int) -> Column:
    """Pieces of size code points."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n <= 1, F.array(c)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(c, i * size + 1, F.lit(size))))


def doc_label(c: Column) -> Column:
    """A file name as the document part of a citation."""
    return trim(F.substring(collapse(F.regexp_replace(c, r"[\[\]|\n]", " ")), 1, 110))


def qualify_citations(text: Column, name: Column) -> Column:
    label = doc_label(name)
    by = F.concat(F.lit("["), F.regexp_replace(label, r"([\\$])", r"\\$1"), F.lit(" p.$1]"))
    return F.when(F.length(label) == 0, text).otherwise(F.regexp_replace(text, F.lit(BARE_CITATION), by))


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


def strip_partial_citation(c: Column) -> Column:
    return F.regexp_replace(c, PARTIAL_CITATION, "")


def citations(c: Column) -> Column:
    """The citations of a text in order: page (>= 1) and doc (null if bare)."""
    docs, pages = F.regexp_extract_all(c, F.lit(CITATION), 1), F.regexp_extract_all(c, F.lit(CITATION), 2)
    found = F.transform(F.arrays_zip(docs.alias("d"), pages.alias("p")), lambda x: F.struct(F.expr("1").alias("one"), F.when(x["d"] != "", x["d"]).alias("doc"), x["p"].cast("long").alias("page")))
    return F.transform(F.filter(found, lambda x: x["page"] >= 1), lambda x: F.struct(x["page"].alias("page"), x["doc"].alias("doc")))


def keywords(c: Column) -> Column:
    words = F.transform(F.split(F.regexp_replace(c, r"""[?？!！.,;:'"()\[\]{}]""", " "), r"(?U)\s+"), F.lower)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of part (not empty) in text."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def keyword_count(lower_text: Column, word: Column) -> Column:
    """Whole words for ASCII keywords, substrings for others."""
    whole = F.regexp_count(lower_text, F.concat(F.lit("(?<![A-Za-z0-9_])"), word, F.lit("(?![A-Za-z0-9_])")))
    return F.when(word.rlike("^[a-z0-9]+$"), whole.cast("long")).otherwise(occurrences(lower_text, word))


def snippet(text: Column, at: Column, length: Column, radius: int = 50) -> Column:
    """The surroundings of a match (at: from 0) on one line, dotted where cut."""
    start, end = F.greatest(F.lit(0), at - radius), F.least(F.length(text), at + length + radius)
    body = collapse(F.substring(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


def short(text: Column, most: int = 180) -> Column:
    one = collapse(text)
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def sentences(c: Column, least: int = 15) -> Column:
    parts = F.split(collapse(strip_citations(c)), SENTENCE_END)
    return F.filter(F.transform(parts, trim), lambda s: F.length(s) >= least)


def drop_small_talk(c: Column) -> Column:
    def stays(line: Column) -> Column:
        t = trim(line)
        talk = t.rlike(SMALL_TALK[0])
        for p in SMALL_TALK[1:]:
            talk = talk | t.rlike(p)
        return (t == "") | t.rlike(CITATION) | ~talk

    return trim(F.regexp_replace(F.array_join(F.filter(F.split(c, "\n", -1), stays), "\n"), r"\n{3,}", "\n\n"))


def sanitize_prompt(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?m)^\s*---\s*$", r"\\-\\-\\-")
    for s in SECTIONS:
        name = s.strip("[]")
        c = F.regexp_replace(c, rf"(?m)^\s*\[{name}\]", rf"\\[{name}\\]")
    return c


def clean_title(c: Column) -> Column:
    c = strip_citations(c)
    for p in (r"\*\*([^*]+?)\*\*", r"\*(?!\s)([^*\n]*[^*\s])\*", r"__([^_]+?)__", r"`([^`]+?)`", r"~~([^~]+?)~~"):
        c = F.regexp_replace(c, p, "$1")
    return collapse(c)


def heading_key(c: Column) -> Column:
    return F.lower(trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"[.·:;,\-–—]+\z", "")))


def safe_href(c: Column) -> Column:
    t = trim(c)
    return F.coalesce((t != "") & ~t.rlike(BAD_URL_CHAR) & (t.startswith("#") | F.lower(t).rlike(r"^(https?://|mailto:)")), F.lit(False))


def highlight(c: Column, query: str) -> Column:
    """Occurrences of query, whatever its signs and cases, in marks."""
    return F.regexp_replace(c, "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", query), "<mark>$0</mark>") if query else c


def mime_of(c: Column) -> Column:
    """Type of an image from the beginning of its base64 text."""
    return F.when(c.startswith("/9j/"), "image/jpeg").when(c.startswith("iVBOR"), "image/png").when(c.startswith("R0lGO"), "image/gif").when(c.startswith("UklGR"), "image/webp").otherwise("image/jpeg")


def image_signature(mime: Column, width: Column, height: Column, data: Column) -> Column:
    tail = F.when(F.length(data) > 128, F.right(data, F.lit(64))).otherwise("")
    return F.concat_ws("|", mime, F.concat_ws("x", width, height), F.length(data), F.substring(data, 1, 64), tail)


def http_error(status: Column, detail: Column) -> Column:
    quota = detail.rlike("(?i)insufficient_quota|exceeded your current quota|billing|quota")
    return F.when((status == 429) & quota, "cloudQuota").when(status == 429, "cloudRateLimit").when(status.isin(503, 529), "cloudOverloaded")


def retry_after_ms(c: Column, most: int = 60_000) -> Column:
    s = c.try_cast("double")
    return F.when((s >= 0) & ~F.isnan(s), F.least(s * 1000, F.lit(float(most)))).cast("long")


def progress_event(line: Column) -> Column:
    percent = F.regexp_extract(line, r"(?i)^pulling\s+\S+.*?(\d+%)", 1)
    return (
        F.when(percent != "", "pulling").when(line.rlike(r"(?i)^pulling\s+manifest"), "pullingManifest").when(line.rlike("(?i)^verifying"), "verifying")
        .when(line.rlike("(?i)^writing"), "writing").when(line.rlike("(?i)^success"), "success").when(line.rlike(r"(?i)^pulling\s+[a-f0-9]"), "preparing").otherwise("raw")
    )


def last_line(c: Column) -> Column:
    plain = F.regexp_replace(c, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|[@-Z\\-_])", "")
    lines = F.filter(F.transform(F.split(plain, r"[\r\n]+"), trim), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def local_url(c: Column) -> Column:
    host = F.try_parse_url(c, F.lit("HOST"))
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")).isin("http", "https") & host.isin("localhost", "127.0.0.1", "::1", "[::1]"), F.lit(False))


def ocr_scale(pages: Column) -> Column:
    return F.when(pages > 100, 1.0).when(pages > 50, 1.5).otherwise(2.0)


def model_matches(installed: Column, base: Column) -> Column:
    return (installed == base) | installed.startswith(F.concat(base, F.lit(":")))


def page_label(page: Column) -> Column:
    return F.when(page >= 1, F.concat(F.lit("[p."), F.floor(page).cast("string"), F.lit("]"))).otherwise("")


def clamp_page(page: Column, most: Column) -> Column:
    return F.when((page >= 1) & (page <= most), F.floor(page))


def full_range(start: Column, end: Column, pages: Column) -> Column:
    """Whether a range of pages (null: none) covers a document."""
    return F.when(start.isNull() | end.isNull(), True).otherwise((start <= 1) & (end >= pages))


def good_size(value: Column, fallback: float) -> Column:
    """A size given as text or number, or the fallback where it is no finite positive number."""
    n = value.try_cast("double")
    return F.when((n > 0) & (n < float("inf")) & ~F.isnan(n), n).otherwise(float(fallback))


def pick_summary(summaries: Column, kind: Column) -> Column:
    """The content of a map's summary of that kind, else of its first kind; null if that is empty or there is none."""
    own = F.try_element_at(summaries, kind)["content"]
    return F.when(F.length(own) > 0, own).otherwise(F.get(F.map_values(summaries), F.lit(0))["content"])


def readable_again(path: Column) -> Column:
    """Whether a path leads to a folder, so that the file can be read again."""
    return F.coalesce(path.rlike(r"[/\\\\]"), F.lit(False))


def raster_kind(width: Column, height: Column, size: Column) -> Column:
    """What an image's bytes can be: rgba, rgb or gray by their number for each pixel; null if too few."""
    pixels = width.cast("long") * height
    return F.when(size >= 4 * pixels, "rgba").when(size >= 3 * pixels, "rgb").when(size >= pixels, "gray")


def searchable(model: Column, dim: Column, vector: Column, most: int = 8192) -> Column:
    """Whether a semantic search makes sense: a model's name, a whole dimension within bounds, and as many finite numbers."""
    whole = (dim == F.floor(dim)) & (dim > 0) & (dim <= most)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.length(model) > 0) & whole & (F.size(vector) == dim) & finite, F.lit(False))
