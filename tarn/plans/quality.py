"""Evaluation runs of an engine: the quality report with its gates, and the benchmark of the three modes.

Questions are asked one after the other, since each is a search of the whole collection; what they return is scored in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import assess, evaluation, quality
from tarn.operators.filters import Filters
from tarn.operators.retrieval import CANDIDATES, TOP
from tarn.plans.answer import Answer
from tarn.plans.engine import PIPELINE, Engine
from tarn.sources.files import write_report

FIELDS = ("source", "location", "title", "job_type")
MODES = ("keyword", "vector", "hybrid")
#: Questions of one run, which are asked from the driver.
MOST_QUESTIONS = 1000
_LISTED = "query_id string, job_id string, place int"


def cite_first(question: str, context: str) -> str:
    """A stand-in for a model: an answer that rests on the first source."""
    return "This answer rests on the best posting found. [1]"


def asked(questions: DataFrame) -> list[tuple[str, str, Filters, bool]]:
    """(id, query, conditions, whether a refusal is due) of questions as files.questions reads them."""
    rows = questions.orderBy("id").limit(MOST_QUESTIONS + 1).collect()
    if len(rows) > MOST_QUESTIONS:
        raise ValueError(f"a run takes at most {MOST_QUESTIONS} questions")
    return [(r["id"], r["query"], Filters(**{k: v for k, v in (r["filters"] or {}).items() if k in FIELDS and v}), bool(r["should_refuse"])) for r in rows]


def _accuracy(engine: Engine, listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, filter_accuracy of jobs listed for questions."""
    return assess.filter_accuracy(listed.join(engine.jobs.select("job_id", *FIELDS), "job_id"), wanted)


def _answer_row(name: str, a: Answer) -> tuple:
    counts = [(r["jobs"], float(r["percentage"])) for r in a.statistics or []] if a.intent == "aggregate" else None
    return (name, a.intent == "refusal", bool(a.validation and a.validation["passed"]), None if counts is None else len(a.sources), counts)


def run(engine: Engine, questions: DataFrame, annotations: DataFrame, grades: DataFrame, as_of: str, evidence: DataFrame | None = None, splits: DataFrame | None = None, limits: dict[str, float] = quality.LIMITS, generate=cite_first, report_path: str | None = None) -> dict:
    """The report of a quality run: layers, gates and whether all pass; it is written to report_path if there is one.

    annotations (query_id, should_refuse) and grades (query_id, item, grade) are those that people made, evidence (query_id, chunk_id) the
    chunks they named. Nothing is cached, so the answers are those of the engine as it stands.
    """
    spark = engine.spark
    evidence = spark.createDataFrame([], "query_id string, chunk_id string") if evidence is None else evidence
    splits = spark.createDataFrame([], "split string, query_id string") if splits is None else splits
    all_ = asked(questions)
    plain = spark.createDataFrame([(i, due) for i, _, _, due in all_], "query_id string, should_refuse boolean")
    wanted = spark.createDataFrame([(i, f.source, f.location, f.title, f.job_type) for i, _, f, _ in all_], "query_id string, source string, location string, title string, job_type string")
    due = {r["query_id"] for r in plain.join(assess.answerable(annotations, grades, engine.jobs), "query_id", "left_semi").collect()}
    ranked, told, sources = [], [], []
    for name, query, filters, _ in all_:
        found = engine.ask(query, filters, generate)
        told.append(_answer_row(name, found))
        sources += [(name, j["job_id"], n) for n, j in enumerate(found.sources, 1)]
        if name in due:
            jobs = found.sources or engine.ranked(query, filters, top=TOP, candidates=CANDIDATES)
            ranked += [(name, j["job_id"], n) for n, j in enumerate(jobs, 1)]
    listed, shown = spark.createDataFrame(ranked, _LISTED), spark.createDataFrame(sources, _LISTED)
    answers = spark.createDataFrame(told, "query_id string, refused boolean, citation_passed boolean, total int, counts array<struct<jobs:long,percentage:double>>")
    chunks = engine.chunks.withColumn("chunk_id", F.concat_ws(":", "job_id", "content_hash"))

    issues = quality.issues(plain, annotations, grades, evidence, engine.jobs, chunks)
    parts = quality.retrieval(listed.withColumnRenamed("job_id", "item"), plain, annotations, grades, engine.jobs, _accuracy(engine, listed, wanted), splits)
    rows = quality.answered(plain, annotations, answers, shown, _accuracy(engine, shown, wanted))
    layers = {"dataset": quality.dataset(plain, annotations, grades, issues, engine.jobs), "retrieval": quality.gated(parts), "answer": quality.answer_layers(rows), "operations": quality.operations(engine.jobs, chunks, F.lit(as_of).cast("date"))}
    values = {name: df.first().asDict() for name, df in layers.items()}
    flat = {k: v for one in values.values() for k, v in one.items()}
    gates = [r.asDict() for r in quality.gates(spark.createDataFrame([tuple(float(flat[g]) for g, _, _ in quality.GATES)], ", ".join(f"{g} double" for g, _, _ in quality.GATES)), limits).collect()]
    values["analysis"] = {"cases": values["answer"]["answer_cases"], "rate": values["answer"].pop("analysis_rate")}
    values["retrieval"]["parts"] = [r.asDict() for r in parts.orderBy("part").collect()]
    values["answer"]["rows"] = [r.asDict() for r in rows.orderBy("query_id").collect()]
    out = {"report_version": 1, "as_of": as_of, "corpus_version": engine.version().first()["digest"], "model": engine.model, "pipeline_version": PIPELINE, "top": TOP, "candidates": CANDIDATES, "limits": dict(limits), "layers": values, "gates": gates, "passed": all(g["passed"] for g in gates)}
    if report_path:
        write_report(report_path, out)
    return out


def modes(engine: Engine, questions: DataFrame, grades: DataFrame, top: int = TOP) -> DataFrame:
    """mode, questions, recall, mrr, ndcg of the keyword, vector and hybrid search over the questions that are to be answered.

    A question without grades takes those of the texts with most of its expected_terms.
    """
    spark = engine.spark
    hits = {m: [] for m in MODES}
    to_answer = [(name, query, filters) for name, query, filters, due in asked(questions) if not due]
    for name, query, filters in to_answer:
        for mode in MODES:
            rows = engine.retrieve(query, filters, mode, top).orderBy("place").select("job_id", "place").collect()
            hits[mode] += [(name, r["job_id"], r["place"]) for r in rows]
    terms = questions.where(~F.coalesce("should_refuse", F.lit(False))).select(F.col("id").alias("query_id"), F.explode("expected_terms").alias("term")).join(grades, "query_id", "left_anti")
    texts = engine.jobs.where("is_active").select(F.col("job_id").alias("item"), F.concat_ws("\n", "title", "description").alias("text"))
    silver = evaluation.silver(texts, terms).select("query_id", "item", F.lit(1).alias("grade"))
    gold = grades.join(spark.createDataFrame([(n,) for n, _, _ in to_answer], "query_id string"), "query_id", "left_semi")
    every = gold.select("query_id", "item", F.col("grade").cast("int").alias("grade")).unionByName(silver)
    ranked = {m: spark.createDataFrame(rows, _LISTED).withColumnRenamed("job_id", "item") for m, rows in hits.items()}
    return assess.benchmark(ranked, every, top)
