"""Literal cases and properties of the operators that SQL can't express."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.functions import vector as V
from quirelake.operators import assembly, budgets, chunking, citations, pages, prompts, search, store, trees
from quirelake.streaming import tokens


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_keyword_count(spark):
    assert one(spark, T.keyword_count(F.col("t"), F.lit("ai")), t="he said it would rain again") == 0
    assert one(spark, T.keyword_count(F.col("t"), F.lit("ai")), t="ai, ai (ai)") == 3
    assert one(spark, T.keyword_count(F.col("t"), F.lit("요약")), t="요약과 요약") == 2


def test_sentences(spark):
    assert len(one(spark, T.sentences(F.col("t")), t="This is plainly wrong.다음 주장은 환각입니다 정말로 그렇습니다.")) == 2
    assert len(one(spark, T.sentences(F.col("t")), t="The number 3.14abc is no end of it")) == 1


@pytest.mark.parametrize(
    ("given_", "want"),
    [("결론이다.\n- [p.5]", "결론이다[p.5]."), ("핵심 사실\n[p.5]", "핵심 사실[p.5]"), ("([p.3])", "[p.3]"), ("no citation", "no citation"), ("kept blanks  \n* [p.1], [a p.2]\n[p.3]", "kept blanks  [p.1][a p.2][p.3]"),
     ("\n - [p.1]\n[p.2].\nend", "\n[p.1][p.2]\nend"), (f"(  [p.7 | {'q' * 300}] )", f"[p.7 | {'q' * 300}]"), ("", ""), (None, None), ("  \n", "  \n")],
)
def test_citation_place(spark, given_, want):
    df = spark.createDataFrame([(7, given_, "x")], "key long, body string, at string")
    assert [tuple(r) for r in citations.place(df, "key", "body").collect()] == [(7, want)]


def test_segments(spark):
    df = spark.createDataFrame([(1, "a [p.0] b [doc x p. 2|q] c"), (2, ""), (3, "[p.4][p.5]")], "id long, text string")
    got = [(r.id, r.kind, r.content, r.page, r.doc) for r in citations.segments(df, "id", "text").orderBy("id", "n").collect()]
    assert got == [(1, "text", "a [p.0] b ", None, None), (1, "citation", None, 2, "doc x"), (1, "text", " c", None, None), (3, "citation", None, 4, None), (3, "citation", None, 5, None)]


def test_titles(spark):
    for raw, want in (("my_doc.pdf", "my_doc.pdf"), ("2020~2024", "2020~2024"), ("__굵게__ 와 ~~취소~~", "굵게 와 취소"), ("2 * 3 * 4", "2 * 3 * 4")):
        assert one(spark, T.clean_title(F.col("t")), t=raw) == want


def test_prompt_marks(spark):
    assert one(spark, T.sanitize_prompt(F.col("t")), t="a\n---\n[질문] b") == "a\n\\-\\-\\-\n\\[질문\\] b"


def test_redaction_of_long_unclosed_openers_is_quick(spark):
    assert one(spark, F.size(T.citations(F.col("t"))), t="[p.5| " * 32_000) == 0


def test_heading_tree(spark):
    md = "# 문서\n## 개요\n### 배경\n### 목표\n```\n# no\n```\n## 결론".split("\n")
    df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(md)], "doc_id long, page int, text string")
    got = {r.title: (r.level, r.parent) for r in trees.heading_tree(df).collect()}
    assert got == {"문서": (1, None), "개요": (2, 1), "배경": (3, 2), "목표": (3, 2), "결론": (2, 1)}
    md = ["```", "# a ##", "```", "   ## b [x p. 3]", "~~~", "# c", "see [p.4]", "    # code", "#d"]  # the last fence never closes: none counts
    df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(md)], "doc_id long, page int, text string")
    got = [(r.title, r.level, r.parent, r.cited_page, r.cited_doc) for r in trees.heading_tree(df).orderBy("line").collect()]
    assert got == [("a", 1, None, None, None), ("b", 2, 2, 3, "x"), ("c", 1, None, 4, None)]


def test_math():
    assert trees.math_marks(r"\(a\) \[b\] `\(c\)` \[p. 3\] \( \)") == r"$$a$$ $$b$$ `\(c\)` \[p. 3\] \( \)"
    assert trees.math_marks("\\[\nE=mc\n\\] \\(a\nb\\) \\[a\n \nb\\]") == "$$\nE=mc\n$$ \\(a\nb\\) \\[a\n \nb\\]"
    assert trees.math_marks(r"$\(x\) \\(y\\) \(a $ b\) \\[6pt] \[note p. x\]") == r"$\(x\) \\(y\\) \(a $ b\) \\[6pt] $$note p. x$$"
    assert trees.math_marks(r"\(σ^2\) `\(c\)`", marks=False) == r"σ^2 `\(c\)`"


@pytest.mark.parametrize("text", ["\\(" * 100_000, "\\[" * 100_000 + "\\]", "\\(" * 50_000 + "\n" + "\\)" * 50_000, "\\( $" * 40_000 + "\\)", "\\(   " * 40_000 + "\\)"])
def test_math_takes_linear_time(text):
    """195 KB and more in well under a second."""
    began = time.process_time()
    trees.math_marks(text)
    assert time.process_time() - began < 1


def item(text, x, y, width=10.0, eol=False, size=10.0):
    return {"str": text, "transform": [size, 0.0, 0.0, size, float(x), float(y)], "width": width, "has_eol": eol}


def test_assembly(spark):
    cases = [
        ([item("a", 0, 0), item("b", 11, 0)], "ab"),
        ([item("a", 0, 0), item("b", 20, 0)], "a b"),
        ([item("a", 0, 0), item("b", 0, 20)], "a\nb"),
        ([item("a", 0, 0), item("b", 10, 3)], "ab"),
        ([item("a", 0, 0, eol=True), item("b", 10, 0)], "a\nb"),
        ([item("a", 0, 0), item("", 0, 0, eol=True), item("b", 0, 20)], "a\n\nb"),
        ([item("", 0, 0, eol=True), item("a", 0, 0), item("", 0, 0), item("b", 10, 0)], "ab"),
        ([item("a", 0, 0), {"str": "b", "transform": None, "width": None, "has_eol": None}, item("", 0, 0, eol=True), item("c", 500, 500), item("d", 600, 500)], "a bc d"),
        ([item("a", 0, 0), item("", 0, 0, eol=True), {"str": "b", "transform": [1.0], "width": 1.0, "has_eol": False}], "a\n\nb"),
        ([item("ab", 0, 0, width=None), item("c", 12, 0), item("d", 40, 0, width=float("nan"))], "abc d"),  # two characters take one size
        ([{"str": None, "transform": None, "width": None, "has_eol": True}, {"str": "t", "transform": [0.0, 10.0, -10.0, 0.0, 0.0, 0.0], "width": 5.0, "has_eol": None}, {"str": "u", "transform": [0.0, 10.0, -10.0, 0.0, 0.0, 20.0], "width": 5.0, "has_eol": None}], "t u"),
        ([], ""),
        (None, ""),
    ]
    df = spark.createDataFrame([(1, i, c) for i, (c, _) in enumerate(cases)], f"doc_id long, page int, items {assembly.ITEM}")
    assert [r.text for r in assembly.page_texts(df).orderBy("page").collect()] == [t for _, t in cases]


def test_chapters(spark):
    def found(*texts):
        df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
        return [(r.start_page, r.end_page) for r in pages.detect_chapters(df).orderBy("chapter").collect()]

    assert found("제1장 서론\nx", "body", "제2장 본론") == [(1, 2), (3, 3)]
    assert found("preface", "제1장 서론", "y") == [(1, 3)]
    assert found(*["t"] * 12) == [(1, 10), (11, 12)]
    assert found("제1장 서론", "제1장 서론", "제2장 x ... 9") == [(1, 3)]


words = st.lists(st.text("ab 가.\n", min_size=0, max_size=90), max_size=12).map("\n\n".join)


@settings(max_examples=80, deadline=None)
@given(words, st.integers(100, 300))
def test_whole_chunks_lose_nothing(text, most):
    got = chunking.whole_chunks(text, most)
    assert all(c.strip() and (len(c) <= most) for c in got)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(got)) == squeeze(text)


@settings(max_examples=80, deadline=None)
@given(words, st.integers(50, 200))
def test_overlap_chunks_cover_the_text(text, most):
    got = chunking.overlap_chunks(text, most, most // 10)
    covered = set()
    for _, a, b in got:
        assert 0 <= a < b <= max(1, len(text))
        covered |= set(range(a, b))
    assert all(i in covered or not text[i].strip() for i in range(len(text)))


def test_chunk_pages(spark):
    df = spark.createDataFrame([(1, i + 1, "word " * 120) for i in range(6)] + [(2, 1, "")], "doc_id long, page int, text string")
    got = chunking.chunk_pages(df, 60).where("doc_id = 1").orderBy("chunk").collect()
    assert got[0].page_start == 1 and got[-1].page_end == 6 and len({r.page_start for r in got}) > 1


def naive_fill(lengths, budget):
    if sum(lengths) <= budget:
        return lengths
    out, left, open_ = [0] * len(lengths), budget, list(range(len(lengths)))
    while open_:
        share = left // len(open_)
        small = [i for i in open_ if lengths[i] <= share]
        if not small:
            for i in open_:
                out[i] = share
            break
        i = min(small, key=lambda i: (lengths[i], i))
        out[i], left = lengths[i], left - lengths[i]
        open_.remove(i)
    return out


def test_water_fill(spark):
    cases = [[5, 5, 5], [103] * 6, [9, 500], [0, 0, 70, 90], [60, 59, 58]]
    df = spark.createDataFrame([(k, i, "x" * n) for k, c in enumerate(cases) for i, n in enumerate(c)], "doc_id long, page int, text string")
    got = budgets.water_fill(df, "doc_id", "page", budget=120, gap=0).collect()
    for k, c in enumerate(cases):
        assert [r.allowed for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.page)] == naive_fill(c, 120)


def test_eviction(spark):
    df = spark.createDataFrame([("a", 1, 100), ("b", 3, 100), ("c", 2, 100)], "k string, last_accessed long, byte_size long")
    gone = lambda **kw: sorted(r.k for r in budgets.evict(df, "k", **kw).where("evicted").collect())
    assert gone(most=2, most_bytes=10**9) == ["a"]
    assert gone(most=9, most_bytes=150) == ["a", "c"]
    assert gone(most=1, most_bytes=10**9, pinned=df.where("k = 'a'")) == ["b", "c"]


def test_member_status(spark):
    members = spark.createDataFrame([(h, i) for i, h in enumerate("abcdef")], "doc_hash string, pos int")
    manifest = spark.createDataFrame([("a", 1, "A", "m", 3, 5), ("b", 2, "B", "o", 3, 5), ("c", 3, "C", "m", 2, 5), ("e", 4, "E", "m", 3, 0)], "doc_hash string, doc_id long, file_name string, embed_model string, embed_dim int, chunk_count int")
    tabs = spark.createDataFrame([("f", "F")], "doc_hash string, file_name string")
    got = {r.doc_hash: r.status for r in store.resolve_members(members, manifest, tabs, "m", 3).collect()}
    assert got == {"a": "ready", "b": "model-mismatch", "c": "model-mismatch", "d": "missing", "e": "no-index", "f": "no-index"}


def test_vectors(spark):
    assert one(spark, V.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8], abs=1e-6)
    assert one(spark, V.dot(F.array(F.lit(2.0)), F.array(F.lit(2.0)))) == 1.0
    assert not one(spark, V.valid(F.array().cast("array<float>")))


def test_top_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.7, 0.7, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0, 0.0],)], "q array<float>")
    assert [r.id for r in search.top(search.similar(df, q, least=0.0), 5, "id").collect()] == [1, 2, 3]


def test_keyword_scores(spark):
    p = spark.createDataFrame([(1, 1, "an apple"), (1, 2, "apple apple"), (2, 1, "none")], "doc_id long, page int, text string")
    d = spark.createDataFrame([(1, "x"), (2, "Apple.pdf"), (3, "z")], "doc_id long, file_name string")
    s = spark.createDataFrame([(3, "full", "of apples")], "doc_id long, kind string, content string")
    got = {r.doc_id: r for r in search.keyword_scores(p, d, s, "apple").collect()}
    assert {k: r.score for k, r in got.items()} == {1: 3, 2: 5, 3: 2}
    assert [x.page for x in got[1].snippets] == [1, 2] and got[2].snippets is None and got[3].snippets[0].page == 0
    assert search.keyword_scores(p, d, s, "a").count() == 0


def test_verdict(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.9), ("b", 0.1), ("b", 0.9), ("c", 0.6)], "k string, support double")
    assert {r.k: r.refine for r in search.verdict(df, "k").collect()} == {"a": False, "b": True, "c": True}


def test_prompts(spark):
    df = spark.createDataFrame([(1, "fr", "full", "One is here. Two is there. Three.")], "doc_id long, lang string, kind string, text string")
    got = prompts.ExtractiveGenerator(1).generate(prompts.build_prompts(df)).first()
    assert got.answer == "One is here."


def test_tokens(spark):
    lines = spark.createDataFrame([(1, "ollama", 1, '{"response":"a"}'), (1, "ollama", 2, '{"response":"b","done":true}'), (2, "openai", 1, "data: [DONE]"), (3, "gemini", 1, "broken")], "request_id long, provider string, seq long, line string")
    got = {r.request_id: (r.text, r.state) for r in tokens.concatenated(tokens.decode(lines)).collect()}
    assert got == {1: ("ab", "done"), 2: ("", "EMPTY_RESPONSE"), 3: ("", "open")}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}") for i in range(5)], "user_id long, t string").selectExpr("1L AS user_id", "to_timestamp(t) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    query = tokens.idle_windows(stream, "user_id", "ts").writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert query.exception() is None
    saved = tokens.start_persisting(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    saved.processAllAvailable()
    saved.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
