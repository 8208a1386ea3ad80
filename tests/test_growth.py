"""What large tables need: expressions that are computed once, batches of bounded size, steps that are not repeated."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.functions import vector as V
from quirelake.operators import chunking, prompts, search
from quirelake.plans import questions, retrieval


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keyword_score_is_computed_once(spark):
    """keywords once a row, not once a word of the text; the filter on the score doesn't compute it again."""
    df = spark.createDataFrame([(1, "Ai, ai [p. 3|ai] rain ai_x 요약과 요약", "ai ai, 요약?"), (2, "none", "ai"), (3, "", "b")], "id long, text string, q string")
    got = search.chunk_keyword_scores(df, T.keywords(F.col("q"))).where("score > 0")
    assert [(r.id, r.score) for r in got.collect()] == [(1, 6)]
    assert plan(got).count("regexp_replace(text") == 1 and plan(got).count("regexp_replace(q") == 1
    assert [r.score for r in search.chunk_keyword_scores(df, T.keywords(F.lit("!"))).collect()] == [0, 0, 0]


def test_chunk_batches_are_bounded():
    """chunks leave a batch of documents in batches of about a megabyte."""

    class Docs:
        mapInArrow = staticmethod(lambda fold, schema: fold)  # noqa: N815

    fold = chunking._folded(Docs, ("doc_id", "chunk", "text"), lambda d, t: ((d, i, t[i * 1000 : i * 1000 + 1000]) for i in range(len(t) // 1000)))
    out = list(fold(iter([pa.record_batch({"doc_id": pa.array(range(400)), "text": pa.array(["x" * 10_000] * 400)})])))
    assert sum(b.num_rows for b in out) == 4000 and max(b.num_rows for b in out) < 1100 and len(out) > 3


def test_index_needs_one_pass(spark):
    """documents are folded once, page ranges and vectors go with them, and a search computes neither again."""
    df = spark.createDataFrame([(1, i + 1, "word a b " * 60) for i in range(6)] + [(2, 1, "")], "doc_id long, page int, text string")
    index = retrieval.build_index(df, prompts.HashEmbedder())
    q = spark.createDataFrame([("a b",)], "text string")
    q = prompts.HashEmbedder().embed(q).select(F.col("embedding").alias("q"))
    found = plan(search.similar(index, q, least=0.0))
    assert found.count("MapInArrow") == 1 and found.count("ArrowEvalPython") == 2 and "Window" not in found  # index and question


def test_hash_embedding(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a B a  c", " ", "", None, "요약 b\tb b"])], "id long, text string")
    words = df.select("id", F.explode(F.split(F.lower("text"), r"(?U)\s+")).alias("w")).where("w <> ''").select("id", F.xxhash64("w").alias("h")).collect()
    want = np.zeros((5, 64))
    for r in words:
        want[r.id, r.h % 64] += 1 if r.h >> 62 & 1 == 0 else -1
    norm = np.sqrt((want**2).sum(1, keepdims=True))
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0).astype(np.float32)
    got = {r.id: r.embedding for r in chunking.hash_embedding(df).collect()}
    assert all(got[i] == want[i].tolist() for i in range(5))
    assert plan(df.select(V.normalize(F.array(F.length("text"), F.lit(2))).alias("v"))).count("length(text") == 1


class Counting(prompts.ExtractiveGenerator):
    """Counts the prompts that it answers."""

    def __init__(self, spark):
        super().__init__()
        self.calls = spark.sparkContext.accumulator(0)

    def generate(self, rows):
        calls = self.calls

        def seen(texts: pa.Array) -> pa.Array:
            calls.add(len(texts))
            return texts

        out = super().generate(rows)
        return out.withColumn("answer", F.arrow_udf(seen, "string")("answer"))


def test_each_answer_is_generated_once(spark):
    """a draft for each document, and a second try for each that is refined; no step runs again for a later one."""
    docs = spark.createDataFrame([(i, f"Where erat is and the tion of {i}. " * 3) for i in range(6)] + [(6, "")], "doc_id long, text string")
    pages = docs.select("doc_id", F.lit(1).alias("page"), "text")
    made = Counting(spark)
    got = questions.answer_question(retrieval.build_index(pages, prompts.HashEmbedder()), docs, "where is erat and the tion?", prompts.HashEmbedder(), made, least=0.1).collect()
    assert len(got) == 6 and made.calls.value == 6 + sum(r.refined for r in got)


def test_verify_meets_in_blocks(spark):
    """every pair in blocks of bounded size, no pair as a row; dimensions, nulls and values that are no numbers as in the dot product."""
    rng = np.random.default_rng(3)
    unit = lambda n: [(v / np.linalg.norm(v)).astype(np.float32).tolist() for v in rng.normal(size=(n, 8))]
    near = unit(70)
    rows = [(i, v) for i, v in enumerate([*near, [1.0], [], None, [float("nan")] * 3, [float("inf")] * 2, near[0], near[0]])]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [(i, v) for i, v in enumerate([*unit(25), [0.5], [], None, [0.0] * 3, [1.0, 0.0], [1.0] * 5, near[0]])]
    sentences = spark.createDataFrame(asked, "k long, embedding array<float>")
    pairs = sentences.withColumnRenamed("embedding", "q").crossJoin(chunks).where(F.size("embedding") == F.size("q"))
    want = {r.k: max(0.0, r.m) for r in pairs.groupBy("k").agg(F.max(V.dot(F.col("embedding"), F.col("q"))).alias("m")).collect()}
    for most in (10, 32_768):
        made = search.verify(sentences, chunks, keys=("k",), most=most)
        got = {r.k: r.support for r in made.collect()}
        assert len(got) == len(asked) and all(abs(got[k] - want.get(k, 0.0)) < 1e-12 for k in got), most
        assert "NestedLoop" not in made._jdf.queryExecution().sparkPlan().toString() and "FlatMapCoGroupsInArrow" in plan(made)
    assert search.verify(sentences, chunks.limit(0), keys=("k",)).where("support <> 0").count() == 0


def test_verdict_over_blocks(spark):
    """the verdict stands on the same blocks: each sentence counts once, however many blocks it met."""
    rows = spark.createDataFrame([(i, i % 3, [float(i % 5 == j) for j in range(5)]) for i in range(60)], "vec_id long, label long, embedding array<float>")
    support = search.verify(rows.where("vec_id < 12"), rows, keys=("vec_id", "label"), most=7)
    assert "FlatMapCoGroupsInArrow" in plan(support)
    got = search.verdict(support, "label").collect()
    assert [(r.n, r.n_weak, r.average, r.refine) for r in got] == [(4, 0, 1.0, False)] * 3


def test_verify_compares_little_in_double_precision(monkeypatch):
    """products of single precision leave few for double precision, and the scores are as exact as without them."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    v[2000:] = v[7] + rng.integers(0, 2, (1000, 16)) * 1e-7  # many that single precision can't tell apart
    table = lambda x: pa.table({"vec": pa.array(list(x), pa.list_(pa.float32()))})
    want = np.clip((v[:300].astype(np.float64) @ v.astype(np.float64).T).max(axis=1), -1, 1)
    done, clip = [], np.clip
    monkeypatch.setattr(np, "clip", lambda x, *a: done.append(len(x)) or clip(x, *a))
    got = search.best_scores(table(v[:300]), table(v), rows=100)
    assert np.abs(got - want).max() < 1e-15 and sum(done) < 3 * 300 + 30 * 100 < 300 * 30


def test_verify_deals_blocks_to_tasks_of_their_own(spark):
    """as many partitions as pairs of blocks, asked for by number, so that adaptive execution doesn't merge them."""
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "vec_id long, embedding array<float>")
    assert "REPARTITION_BY_NUM" in search.verify(rows, rows, keys=("vec_id",), most=10)._jdf.queryExecution().executedPlan().toString()
