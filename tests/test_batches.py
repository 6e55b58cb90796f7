"""Operators on whole texts hand them to Python in small batches."""

import pytest

from tarn.operators import assess, evaluation

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("which", ["rerank", "silver"])
def test_small_batches(spark, which):
    spark.conf.unset(BATCH)
    rows = spark.createDataFrame([(1, "a", "a b")], "item long, query string, passage string")
    if which == "rerank":
        assess.rerank(rows, lambda query, passages: [0.0] * len(passages))
    else:
        evaluation.silver(rows.selectExpr("item", "passage as text"), spark.createDataFrame([(1, "a")], "query_id int, term string"))
    assert spark.conf.get(BATCH) == "2000"
