"""The vector index against the search over all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import retrieval, vectors


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)


def check(index, rows, queries, k, allowed=None):
    plain = retrieval.nearest(rows if allowed is None else rows.join(allowed, "chunk_id", "left_semi"), queries, k=k)
    line = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    want = line(plain)
    assert line(index.search(queries, k, allowed)) == want
    return want


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    return centres[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 16))


def test_equals_the_whole_search_and_skips_most(spark, clustered):
    rows = frame(spark, clustered, [(9001, None), (9002, [0.0] * 16), (9003, [float(v) for v in clustered[0]]), (9004, [float(v) for v in clustered[0]])])
    index = vectors.VectorIndex.build(rows)
    queries = rows.where("chunk_id % 50 = 0 or chunk_id = 9002").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = check(index, rows, queries, 7)
    assert len(want) == 7 * 61 and index.size == 3003
    near = queries.where("query_id <> 9002")
    index.search(near, 7).count()
    assert index.measured < 0.2 * 60 * index.size  # of all pairs
    check(index, rows, queries, 200, rows.where("chunk_id % 7 = 0").select("chunk_id"))
    check(index, rows, queries, 5, rows.limit(0).select("chunk_id"))
    check(index, rows, queries, 4000)


def test_vectors_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(2)
    rows = frame(spark, rng.normal(size=(800, 8)))
    queries = rows.where("chunk_id < 25").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    check(vectors.VectorIndex.build(rows), rows, queries, 10)


def test_few_and_no_vectors(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id int, vector array<float>")
    rows = frame(spark, [[1.0, 1.0], [0.0, 2.0], [0.0, 0.0]])
    check(vectors.VectorIndex.build(rows), rows, queries, 2)
    empty = vectors.VectorIndex.build(rows.limit(0))
    assert empty.size == 0 and empty.search(queries, 2).count() == 0
    assert vectors.VectorIndex.build(rows).search(queries.limit(0), 2).count() == 0


def test_cells_are_read_by_folder(spark, clustered):
    index = vectors.VectorIndex.build(frame(spark, clustered))
    block = retrieval.units(index.vectors.limit(1).select("embedding").toArrow()["embedding"])
    wanted = np.zeros((1, len(index.cells)), bool)
    wanted[0, 0] = True
    import pyarrow as pa

    plan = index._scan(index.vectors, pa.array([1]), block, wanted, 3, "query_id long, chunk_id long, score double")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "PartitionFilters: [cell" in plan
