"""The quality run of an engine, the benchmark of its modes, and layers without rows."""

import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import quality
from tarn.plans import quality as runs
from tarn.plans.engine import Engine
from tarn.sources import files

JOBS = "id string, site string, title string, company string, location string, job_url string, description string, date_posted string, job_type string, is_remote boolean"
NOTES = "query_id string, should_refuse boolean"
GRADES = "query_id string, item string, grade int"
ALL_ONE = {"minimum_questions": 2, "minimum_annotated_answerable_questions": 1, "minimum_recall_at_8": 1.0, "minimum_graded_ndcg_at_8": 1.0}


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        ("li-1", "linkedin", "RAG Engineer", "Example", "Singapore", "https://example/1", "Requirements\n\nPython, RAG, and vector databases.", "2026-09-01", None, None),
        ("li-2", "linkedin", "Java Developer", "Other", "Berlin", "https://example/2", "Requirements\n\nJava and Docker.", "2026-09-01", None, None),
    ]
    e = Engine(spark)
    e.ingest(spark.createDataFrame(rows, JOBS), "2026-09-02")
    e.index("2026-09-02")
    return e


@pytest.fixture(scope="module")
def questions(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("q") / "questions.jsonl"
    rows = [
        {"id": "skills-1", "category": "skills", "query": "What skills does the RAG Engineer require?", "filters": {"location": "Singapore"}, "expected_terms": ["python"], "should_refuse": False},
        {"id": "refuse-1", "category": "insufficient_evidence", "query": "今天天气如何？", "filters": {}, "should_refuse": True},
    ]
    path.write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    return files.questions(spark, str(path)).cache()


def test_run(engine, questions, spark, tmp_path):
    job = engine.jobs.where("title = 'RAG Engineer'").first().job_id
    notes = spark.createDataFrame([("skills-1", False)], NOTES)
    grades = spark.createDataFrame([("skills-1", job, 2)], GRADES)
    path = tmp_path / "report.json"
    out = runs.run(engine, questions, notes, grades, "2026-09-10", limits=ALL_ONE, report_path=str(path))
    assert out["passed"] and len(out["gates"]) == 11
    assert json.loads(path.read_text(encoding="utf-8"))["gates"] == out["gates"]
    assert {r["query_id"]: (r["refused"], r["refusal_correct"], r["citation_valid"]) for r in out["layers"]["answer"]["rows"]} == {"skills-1": (False, True, True), "refuse-1": (True, True, True)}
    assert [(p["part"], p["recall"], p["mrr"]) for p in out["layers"]["retrieval"]["parts"]] == [("all", 1.0, 1.0), ("evaluation", 1.0, 1.0)]


def test_failing_gates(engine, questions, spark):
    """A grade of no job, evidence of no chunk, an answer that cites nothing, and a question that should have been refused."""
    job = engine.jobs.where("title = 'RAG Engineer'").first().job_id
    notes = spark.createDataFrame([("skills-1", False), ("gone", False), ("refuse-1", False)], NOTES)
    grades = spark.createDataFrame([("skills-1", job, 2), ("skills-1", "nobody", 1)], GRADES)
    evidence = spark.createDataFrame([("skills-1", "no chunk")], "query_id string, chunk_id string")
    splits = spark.createDataFrame([("test", "skills-1")], "split string, query_id string")
    out = runs.run(engine, questions, notes, grades, "2027-09-10", evidence, splits, ALL_ONE)
    failed = {g["gate"] for g in out["gates"] if not g["passed"]}
    # nothing was to be refused, so there is no accuracy of refusals; both jobs are stale a year later
    assert failed == {"refusal_accuracy", "active_stale_jobs"}
    found = out["layers"]["dataset"]
    assert (found["unknown_questions"], found["unknown_items"], found["unknown_chunks"], found["inactive_positives"]) == (1, 1, 1, 0)
    assert out["layers"]["retrieval"]["gate_part"] == "test"


def test_modes(engine, questions, spark):
    """Without grades the jobs with the expected terms are the right ones."""
    rows = {r["mode"]: r for r in runs.modes(engine, questions, spark.createDataFrame([], GRADES)).collect()}
    assert set(rows) == set(runs.MODES)
    assert all((r.questions, r.recall, r.mrr, r.ndcg) == (1, 1.0, 1.0, 1.0) for r in rows.values())


def test_answers(spark):
    asked = spark.createDataFrame([(n, n == "f") for n in "abcdefg"], NOTES)
    told = [("a", False, True, 2, [(1, 50.0)]), ("b", False, True, 2, [(1, 49.0)]), ("c", False, True, 1, [(1, 100.0)]), ("d", False, False, None, None), ("e", False, True, 0, []), ("f", True, False, None, None)]
    answers = spark.createDataFrame(told, "query_id string, refused boolean, citation_passed boolean, total int, counts array<struct<jobs:long,percentage:double>>")
    sources = spark.createDataFrame([(q, j) for q in "abc" for j in "xy"] + [("d", "x"), ("d", "x")], "query_id string, job_id string")
    none = spark.createDataFrame([], "query_id string, filter_accuracy double")
    notes = spark.createDataFrame([("e", True)], NOTES)
    got = {r.query_id: (r.refusal_correct, r.citation_valid, r.analysis_valid, r.source_count) for r in quality.answered(asked, notes, answers, sources, none).collect()}
    # b: a wrong percentage; c: a total that is not that of the sources; d: one source twice, no citation; e: a refusal is due; g: no answer
    assert got == {"a": (True, True, True, 2), "b": (True, True, False, 2), "c": (True, True, False, 2), "d": (True, False, False, 2), "e": (False, True, True, 0), "f": (True, True, True, 0), "g": (True, False, True, 0)}


def test_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    notes, grades, jobs = empty(NOTES), empty(GRADES), empty("job_id string, is_active boolean, date_posted date, last_seen_at timestamp")
    chunks, acc = empty("chunk_id string, job_id string, embedding array<float>"), empty("query_id string, filter_accuracy double")
    found = quality.issues(notes, notes, grades, empty("query_id string, chunk_id string"), jobs, chunks)
    parts = quality.retrieval(empty("query_id string, item string, place int"), notes, notes, grades, jobs, acc, empty("split string, query_id string"))
    rows = quality.answered(notes, notes, empty("query_id string, refused boolean, citation_passed boolean, total int, counts array<struct<jobs:long,percentage:double>>"), empty("query_id string, job_id string"), acc)
    values = quality.dataset(notes, notes, grades, found, jobs).join(quality.gated(parts)).join(quality.answer_layers(rows)).join(quality.operations(jobs, chunks, F.lit("2026-09-01").cast("date")))
    assert {r.gate for r in quality.gates(values).collect() if r.passed} == {"index_coverage", "active_stale_jobs", "inactive_chunks"}


def test_limits_and_configuration(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"version": 1, "minimum_questions": 3}))
    assert files.limits(spark, str(path)) == quality.LIMITS | {"minimum_questions": 3}
    config = {"mode": "hybrid", "candidate_k": 50, "max_chunks_per_job": 1, "rrf_k": 20, "vector_weight": 1.0, "keyword_weight": 1.0}
    lock = tmp_path / "c.json"
    lock.write_text(json.dumps({"status": "locked_for_holdout", "config": config}))
    from tarn.operators import evaluation

    assert evaluation.config_name(files.locked(spark, str(lock))) in {evaluation.config_name(g) for g in evaluation.configs()}
    path.write_text(json.dumps({"minimum_luck": 1}))
    lock.write_text(json.dumps({"status": "open", "config": config}))
    for read, p in ((files.limits, path), (files.locked, lock)):
        with pytest.raises(ValueError):
            read(spark, str(p))
