"""What a task passes on in a vector search: the k best of each query, however its vectors are cut."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.operators import retrieval, vectors


def plain(names, x, block, k, of):
    """(query, name, score) by sorting all."""
    scores = np.round(block @ x.T, 6) + 0.0
    return sorted((q, names[j], scores[q, j]) for q in range(len(block)) for j in sorted((j for j in range(len(names)) if q in of[j]), key=lambda j: (-scores[q, j], names[j]))[:k])


@pytest.mark.parametrize("chunk", (1, 7, 1024))
@pytest.mark.parametrize("held", (1, 4))
def test_best_equals_sorting_all(monkeypatch, chunk, held):
    """Grouped vectors with many ties, named against their order, in parts that not every query asks for."""
    monkeypatch.setattr(retrieval, "CHUNK", chunk)
    monkeypatch.setattr(retrieval, "HELD", held)
    rng = np.random.default_rng(4)
    x = rng.integers(-1, 2, (300, 3)).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    block, names = x[[0, 5, 9, 77]], [f"n{i:03}" for i in rng.permutation(300)]
    for k in (1, 5, 400):
        top, of = retrieval.Best(pa.array([0, 1, 2, 3]), block, k), {}
        for i in range(0, 300, 50):
            part = np.flatnonzero(rng.random(4) < 0.7)
            of |= {j: set(part.tolist()) for j in range(i, i + 50)}
            top.add(pa.array(names[i : i + 50]), x[i : i + 50], part)
        got = [r for b in top.hits("name") for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == plain(names, x, block, k, of)


def test_least_scores_hold_and_nothing_gives_nothing():
    x = np.eye(3)
    top = retrieval.Best(pa.array([7, 8]), x[:2], 2, np.array([0.5, -2.0]))
    top.add(pa.array([1, 2, 3]), x)
    assert sorted(r for b in top.hits("c") for r in zip(*(c.to_pylist() for c in b.columns))) == [(7, 1, 1.0), (8, 1, 0.0), (8, 2, 1.0)]
    assert list(retrieval.Best(pa.array([7]), x[:1], 2).hits("c")) == []


def test_a_task_passes_on_k_hits_of_a_query(spark, monkeypatch):
    """Whatever the number of cells and batches; a small cell is one file."""
    x = np.random.default_rng(5).normal(size=(2000, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id long, embedding array<float>")
    index = vectors.VectorIndex.build(rows)
    assert len(index.cells) > 20 and len(index.vectors.inputFiles()) == len(index.cells)
    queries = rows.where("chunk_id < 30").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    part = next(retrieval.query_blocks(queries))
    ids, block = part["query_id"].combine_chunks(), retrieval.units(part["vector"])
    hits = index._scan(index.vectors.coalesce(1), ids, block, np.ones((30, len(index.cells)), bool), 5, "query_id long, chunk_id long, score double")
    assert hits.count() == 30 * 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert index.search(queries, 5).count() == 30 * 5
        monkeypatch.setattr(retrieval, "rank", lambda scored, *a: scored)
        assert retrieval.nearest(rows.coalesce(1), queries, k=5).count() == 30 * 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_large_cell_is_several_files(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SPREAD", 100)
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1000)] + [(i, [0.0, 0.0]) for i in range(1000, 1500)], "chunk_id long, embedding array<float>")
    # Spark would write tables as small as this in one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = vectors.VectorIndex.build(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = index.vectors.select("cell", F.input_file_name().alias("f")).distinct().groupBy("cell").count().collect()
    assert index.size == 1500 and {r["cell"]: r["count"] > 1 for r in files} == {r["cell"]: True for r in files}
