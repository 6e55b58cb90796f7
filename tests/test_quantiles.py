"""Exact quantiles against the built-in percentile."""

import pytest
from pyspark.sql import functions as F

from tarn.operators.quantiles import quantiles
from tarn.operators import stats

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}


def check(df, keys):
    got = {tuple(r[k] for k in keys): [r[n] for n in PROBS] for r in quantiles(df, keys, "v", PROBS).collect()}
    want = df.groupBy(*keys).agg(F.percentile("v", list(PROBS.values())).alias("p")).collect()
    assert len(got) == len(want)
    for r in want:
        mine = got[tuple(r[k] for k in keys)]
        assert mine == pytest.approx(r.p, abs=1e-9) if r.p is not None else mine == [None] * len(PROBS)


def test_groups_of_every_kind(spark):
    rows = [("x", 1, float(i % 7)) for i in range(50)] + [("x", 2, 3.0)] * 40 + [("y", 1, None)] * 3 + [(None, 1, -1.5), (None, 1, 2.5), (None, None, 1e300), (None, None, -1e300), ("z", 9, 0.1)]
    df = spark.createDataFrame(rows, "k string, q_value int, v double").repartition(5)
    check(df, ["k", "q_value"])
    check(df, ["k"])
    check(df, [])
    check(df.limit(0), [])
    assert quantiles(df.limit(0), ["k"], "v", PROBS).count() == 0


def test_a_million_different_values_of_one_group(spark):
    n = 1_000_000
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        df = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("k"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
        check(df, ["k"])
        plan = quantiles(df, ["k"], "v", PROBS)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_summary_of_requests(spark):
    cols = "status string, total_ms double, cache_hit boolean, refused boolean, no_result boolean, retrieval_ms double, llm_ms double, prompt_tokens int, completion_tokens int, estimated_cost_usd double, pipeline_version string"
    log = spark.createDataFrame([("ok", 100.0, False, False, False, 40.0, 60.0, 10, 15, 0.25, "v1"), ("ok", 50.0, True, False, True, 50.0, 0.0, None, 0, None, "v2"), ("error", 10.0, False, True, False, None, None, 0, 0, None, None)], cols)
    r = stats.requests(log).first()
    assert (r.total, r.successful, r.failed, r.error_rate, r.cache_hits, r.refusals, r.no_results) == (3, 2, 1, 33.33, 1, 1, 1)
    assert (r.retrieval_average, r.calls, r.llm_average, r.total_tokens, r.cost_usd, r.cost_configured, r.p50, r.p95) == (30.0, 1, 60.0, 25, 0.25, True, 50.0, 95.0)
    empty = stats.requests(log.limit(0)).first()
    assert (empty.total, empty.p50, empty.llm_average, empty.cost_usd, empty.cost_configured, empty.error_rate) == (0, 0.0, 0.0, None, False, 0.0)
    plain = stats.requests(log.drop("no_result", "retrieval_ms", "llm_ms", "estimated_cost_usd")).first()
    assert (plain.no_results, plain.calls, plain.cost_configured) == (0, 1, False)
