"""Silver labels against counting term by term."""

import random

import pytest

from tarn.operators import evaluation


@pytest.mark.parametrize("block", [50_000, 2])
def test_occurrences(spark, monkeypatch, block):
    monkeypatch.setattr(evaluation, "TERM_BLOCK", block)
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("aab C日") for _ in range(rng.randrange(80)))) for i in range(60)] + [(100, None), (101, "")]
    questions = [(1, "a"), (1, "AA"), (2, "aba"), (2, "b c"), (3, "日"), (4, "none"), (5, ""), (5, None), (1, "a")]
    df = spark.createDataFrame(texts, "item long, text string")
    got = {(r.query_id, r["item"]): (r.score, r.place) for r in evaluation.silver(df, spark.createDataFrame(questions, "query_id int, term string"), limit=5).collect()}
    want = {}
    for q in {q for q, _ in questions}:
        sums = {i: sum((t or "").lower().count(x.lower()) for p, x in questions if p == q and x) for i, t in texts}
        best = sorted((-n, i) for i, n in sums.items() if n)[:5]
        want |= {(q, i): (-n, place) for place, (n, i) in enumerate(best, 1)}
    assert got == want
