"""The pipeline as a whole on rows of every kind."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import toxicity


def through(spark, docs, sf_dir, last=False):
    """What the stages but the last, or all, make of docs."""
    stages = corpus_pipeline.STAGES if last else corpus_pipeline.STAGES[:-1]
    for _, stage in stages:
        docs = corpus_pipeline.keep(stage(spark, docs, sf_dir))
    return docs


@pytest.fixture(scope="module")
def prose(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars between 400 and 4000")


def test_rows_of_every_kind(spark, sf_dir, edge, prose):
    names = [c for c in edge.columns if c not in prose.columns]
    both = prose.select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), *[F.lit("own").alias(c) for c in names])
    docs = both.unionByName(edge.select(both.columns)).unionByName(both.orderBy("doc_id").limit(3)).unionByName(both.orderBy("doc_id").limit(9).withColumn("doc_id", F.col("doc_id") + 900_000))
    out = through(spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert not {1, 2, 3, 6} & set(ids) and max(i for i in ids if i) < 900_000  # no text without a letter, and no copy under another id
    again = {r.doc_id for r in both.orderBy("doc_id").limit(3).collect()} | {5}
    assert all(ids.count(i) == (2 if i in again else 1) for i in set(ids) - {None})
    assert all(r[c] in ("own", "z") for r in rows for c in names)
    assert all(r.n_chars == len(r.text) for r in rows)
    plain = {r.doc_id + 100_000 for r in through(spark, prose, sf_dir).collect()}
    assert plain <= {r.doc_id for r in rows}


def test_empty_tables(spark, sf_dir, empty):
    out = through(spark, empty, sf_dir, last=True)
    assert out.count() == 0 and out.columns[0] == "doc_id"


def test_documents_without_a_language(spark, sf_dir, prose):
    docs = prose.limit(30).withColumn("lang", F.lit(None).cast("string"))
    first = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert first.count() == 30


def test_rows_without_an_id(spark, sf_dir, prose):
    docs = prose.withColumn("doc_id", F.lit(None).cast("long"))
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir).count()
    assert 0.9 * docs.count() < kept


def test_a_long_text_takes_no_others_place(spark):
    texts = [(i, f"{w} words number {i}", 0) for i in range(200) for w in ("some",)] + [(1000 + i, f"bad{i} moron", 1) for i in range(200)] + [(5000, "moron " * 1_400_000, 1)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    for seed in range(3):  # whatever its place in the order
        moved = rows.withColumn("doc_id", F.col("doc_id") + seed * 10_000)
        got = {r.toxic: r["count"] for r in toxicity._sample(moved, moved.select("doc_id", "toxic")).groupBy("toxic").count().collect()}
        assert got == {0: 200, 1: 200}
