"""A tuning run reads the grades once, however many points its grid has."""

from tarn.operators import evaluation


def test_grades_are_not_repeated_for_the_points(spark, monkeypatch):
    hits = spark.createDataFrame([(q, i, i, 1.0, i) for q in "abc" for i in range(1, 200)], "query_id string, chunk_id int, job_id int, score double, rank int")
    grades = spark.createDataFrame([(q, i, i % 3) for q in "abcd" for i in range(1, 300)], "query_id string, item int, grade int")
    held, plain = [], evaluation.metrics

    def counted(ranking, grades, *rest):
        held.append(grades.count())
        return plain(ranking, grades, *rest)

    monkeypatch.setattr(evaluation, "metrics", counted)
    out = evaluation.tune(hits, hits, grades).collect()
    assert len(out) == len(evaluation.configs()) and held == [grades.count()]
    # six of the best eight are among a question's 200 positives; d has no hit
    assert {r.recall for r in out} == {0.0225} and {r.rr for r in out} == {0.75}
