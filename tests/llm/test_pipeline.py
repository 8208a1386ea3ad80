"""The pipeline's stages follow each other and take effect."""

import corpus_pipeline
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "mix":
            assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    con = duckdb.connect()
    norm = "regexp_replace(text, '[ \\x09-\\x0D]', '', 'g')"
    n, distinct, leaks, bad = con.sql(f"SELECT count(*), count(DISTINCT {norm}), (SELECT count(*) FROM '{tmp_path}/decontaminate/*.parquet' d, '{DATA}/benchmark.parquet' b WHERE contains(d.text, b.text)), (SELECT count(*) FROM '{tmp_path}/quality/*.parquet' d JOIN '{DATA}/labels.parquet' l USING (doc_id) WHERE quality = 0) FROM '{tmp_path}/decontaminate/*.parquet'").fetchall()[0]
    bad_before = con.sql(f"SELECT count(*) FROM '{DATA}/labels.parquet' WHERE quality = 0").fetchall()[0][0]
    assert n == distinct and leaks == 0 and bad <= bad_before / 2, (bad, bad_before)  # few labels here: see test_llm for accuracy
    ids = lambda df: sorted((r.doc_id, r.taken) for r in df.select("doc_id", "taken").collect())
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(docs)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
    assert set(entry.oracle_sql()) <= set(names)
    assert pytest is not None
