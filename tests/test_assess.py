"""Files of an evaluation, the contract, and cases of the evaluation runs that the tables do not hold."""

import copy
import hashlib
import json

import duckdb
import pytest

from tarn.operators import assess
from tarn.plans import catalogue, contract
from tarn.sources import files

VALID = {
    "contract_version": "1",
    "default_mode": "a",
    "modes": {"a": {"status": "active"}},
    "chunking_contract": {"strategy": "section_paragraph_list", "relevant_sections": ["x"], "ignored_sections": ["y"], "context_fields": ["z"], "max_chars": 10, "overlap_chars": 2},
    "retrieval_contract": {"unit": "job", "deduplicate_by": "job_id", "candidate_jobs": {"minimum": 1, "target": 2, "maximum": 3}, "top_relevant_jobs": {"minimum": 1, "target": 1, "maximum": 1}},
    "answer_contract": {"required_sections": ["s"], "citation": {"required": True}, "refusal": {"triggers": ["t"]}},
    "quality_contract": {"retrieval_metrics": ["m"], "answer_metrics": ["m"], "release_requirements": ["r"]},
    "delivery_workflow": {"phase_confirmation_required": True, "sequence": ["s"]},
}


def test_contract(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(VALID))
    assert contract.read(str(path)) == VALID
    for keys, bad in [("default_mode", "b"), ("modes.a.status", "odd"), ("chunking_contract.overlap_chars", 10), ("chunking_contract.max_chars", True), ("chunking_contract.context_fields", [" "]), ("retrieval_contract.candidate_jobs.target", 9), ("retrieval_contract.unit", "chunk"), ("answer_contract.citation.required", 1), ("quality_contract.answer_metrics", []), ("contract_version", " ")]:
        one = copy.deepcopy(VALID)
        *way, last = keys.split(".")
        node = one
        for k in way:
            node = node[k]
        node[last] = bad
        assert len(contract.faults(one)) == 1, keys
    assert contract.faults([]) and contract.faults({})
    path.write_text("{")
    for p in (path, tmp_path / "none.json"):
        with pytest.raises(ValueError):
            contract.read(str(p))


def test_files(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"development": ["a"], "test": [1], "refusal": []}))
    assert sorted(map(tuple, files.splits(spark, str(path)).collect())) == [("development", "a"), ("test", "1")]
    assert files.digests(spark, str(path)).first().sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    for bad in ({"development": [], "test": []}, {"development": ["a"], "test": ["a"], "refusal": []}, {"development": "a", "test": [], "refusal": []}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.splits(spark, str(path))
    rows = [("good", [("j", 2), ("k", 0)], [1]), ("none", [], []), ("bad", [("j", 3), (" ", 1), ("j", None)], [0])]
    got = files.annotation_faults(spark.createDataFrame(rows, "query_id string, job_judgments array<struct<job_id:string,relevance:int>>, evidence_chunk_ids array<int>"))
    assert sorted(r.fault for r in got.where("query_id = 'bad'").collect()) == ["chunk id below 1", "grade outside 0 to 2", "job judged twice", "job without id"] and got.count() == 4


def test_runs_without_rows(spark):
    pairs = spark.createDataFrame([(1, "j", "q", None), (1, "j", "q", "long text"), (2, "k", None, "text")], "query_id int, job_id string, query string, passage string")
    scored = assess.rerank(pairs, lambda q, ps: [len(p) / 10 for p in ps], batch=1)
    assert sorted((r.query_id, r.job_id, r.score, r.place) for r in assess.job_scores(scored).collect()) == [(1, "j", 0.9, 1)]
    wanted = spark.createDataFrame([(1, "S", "", None, "")], "query_id int, source string, location string, title string, job_type string")
    assert assess.filter_accuracy(wanted.limit(0), wanted).first().filter_accuracy == 1.0
    rows = spark.createDataFrame([(1, None, "e", 2)], "query_id int, claims array<struct<claim:string,verdict:string,source_numbers:array<int>,evidence_quote:string>>, evidence string, source_count int")
    assert [(r.claim_count, r.groundedness) for r in assess.judged(rows).collect()] == [(0, None)]


def test_judge(spark):
    cases = spark.createDataFrame([(q, q == "r", "We use Python daily", 1) for q in "abrn"], "query_id string, expected_refusal boolean, evidence string, source_count int")
    claim = {"claim": "x", "verdict": "supported", "source_numbers": [1, 4], "evidence_quote": "use  python"}
    told = {"evaluations": [{"id": "a", "claims": [claim, claim | {"verdict": "odd"}], "answer_relevance": 9, "completeness": "much"}, {"id": "r", "refusal_correct": True}, {"id": None}]}
    texts = [f"```json\n{json.dumps(told)}\n```", json.dumps({"evaluations": [{"id": "b", "claims": None, "answer_relevance": 0, "completeness": 3}]}), "no JSON", None]
    got = assess.replies(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.query_id: (r.relevance, r.completeness, r.refusal_correct) for r in got.collect()} == {"a": (5, None, False), "b": (1, 3, False), "r": (None, None, True)}
    assert tuple(assess.response_summary(cases, got).first()) == (2, 0.5, 3.0, 3.0, 1, 1.0, 1)
    assert tuple(assess.response_summary(cases.limit(0), got.limit(0)).first()) == (0, None, None, None, 0, None, 0)


def test_quotes_with_sharp_s_and_edge_blanks_as_in_the_sql(spark, tmp_path):
    texts = {1: ["St geßch das", "xxgeßch ver"], 2: ["Des chä. es", "xxs chä yy"], 3: ["a \n\tb c", "xx \n\tb cd"], 4: ["ab", "xx"], 5: ["Es ssen", "xxßen es"], 6: ["DU darfst", "xxu darf"]}
    rows = [(i, n, "user", t) for i, two in texts.items() for n, t in enumerate(two)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.query_id: tuple(r) for r in catalogue.QUERIES["judged_claims"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == {r[0]: r for r in con.execute(catalogue.SQL["judged_claims"]).fetchall()}
    assert [got[i][3] for i in texts] == [2, 1, 2, 0, 1, 2]


def in_spark_and_sql(spark, folder, rows):
    """What judged_claims returns over conversations of these rows, by Spark and by its SQL."""
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    return sorted(map(tuple, catalogue.QUERIES["judged_claims"](spark, str(folder)).collect())), sorted(con.execute(catalogue.SQL["judged_claims"]).fetchall())


def test_all_claims_count(spark, tmp_path):
    got, want = in_spark_and_sql(spark, tmp_path, [(1, t, "user", f"xx{t % 2}claim") for t in range(9)] + [(2, t, "user", "xxabcdef") for t in range(400)])
    assert got == want == [(1, 9, 0.3333, 5, 6), (2, 400, 0.3, 400, 397)]


def test_claims_without_text_or_turn(spark, tmp_path):
    got, want = in_spark_and_sql(spark, tmp_path, [(1, t, "user", "xxabcdef") for t in range(-3, 4)] + [(3, 1, "user", None), (3, None, "user", "xxabc"), (4, None, "user", "xx")])
    assert got == want and [r[1] for r in got] == [7, 2, 1]


def test_judged_takes_any_number_of_claims(spark):
    claims = [("c", "supported", [1, 9], "b")] * 3
    one = spark.createDataFrame([(1, claims, "a b", 2)], "query_id int, claims array<struct<claim:string,verdict:string,source_numbers:array<int>,evidence_quote:string>>, evidence string, source_count int")
    assert [r.claim_count for f in (assess.judged(one), assess.judged(one, 2)) for r in f.collect()] == [3, 2]
