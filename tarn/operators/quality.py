"""A quality run's five layers (dataset, retrieval, analysis, answers, operations) and its eleven gates.

The run is given as tables, so that any number of questions is scored in one plan:

questions (query_id, should_refuse), annotations (query_id, should_refuse), grades (query_id, item, grade), evidence (query_id,
chunk_id), ranking (query_id, item, place), splits (split, query_id), answers (query_id, refused, citation_passed, total, counts) with
their sources (query_id, job_id), jobs (job_id, is_active, date_posted, last_seen_at) and chunks (chunk_id, job_id, embedding).
Layers without questions have means of 0, as a gate must not pass on nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.assess import answerable
from tarn.operators.evaluation import metrics
from tarn.operators.filters import stale

# What each gate compares, the name of its limit in a configuration, and the limit that holds without one.
GATES = (
    ("questions", "minimum_questions", 25),
    ("answerable", "minimum_annotated_answerable_questions", 8),
    ("recall", "minimum_recall_at_8", 0.7),
    ("graded_ndcg", "minimum_graded_ndcg_at_8", 0.65),
    ("filter_accuracy", "minimum_filter_accuracy", 1.0),
    ("analysis_rate", "minimum_analysis_invariant_rate", 1.0),
    ("citation_rate", "minimum_citation_validity_rate", 1.0),
    ("refusal_accuracy", "minimum_refusal_accuracy", 1.0),
    ("index_coverage", "minimum_index_coverage", 1.0),
    ("active_stale_jobs", "maximum_active_stale_jobs", 0),
    ("inactive_chunks", "maximum_inactive_chunks", 0),
)
LIMITS = {name: limit for _, name, limit in GATES}
ISSUES = ("unknown question", "unknown item", "inactive positive", "unknown chunk")
_MEANS = {"recall": "recall", "rr": "mrr", "condensed_ndcg": "graded_ndcg", "filter_accuracy": "filter_accuracy"}


def _mean(c: Column) -> Column:
    # ten digits first, so that the order of a sum decides no half
    return F.coalesce(F.bround(F.round(F.avg(c), 10), 4), F.lit(0.0))


def issues(questions: DataFrame, annotations: DataFrame, grades: DataFrame, evidence: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """issue, query_id, ref: annotations of no question, grades of no job, positives of jobs that are not active, evidence of no chunk."""
    known = jobs.select(F.col("job_id").alias("item"), "is_active")
    ref = lambda c: F.col(c).cast("string").alias("ref")
    parts = (
        annotations.join(questions, "query_id", "left_anti").select("query_id", F.lit(None).cast("string").alias("ref")),
        grades.join(known, "item", "left_anti").select("query_id", ref("item")),
        grades.where("grade > 0").join(known.where("not is_active"), "item", "left_semi").select("query_id", ref("item")),
        evidence.join(chunks, "chunk_id", "left_anti").select("query_id", ref("chunk_id")),
    )
    return reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("issue"), "query_id", "ref") for name, p in zip(ISSUES, parts)])


def dataset(questions: DataFrame, annotations: DataFrame, grades: DataFrame, found: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: questions, annotations, answerable, and how many of each of ISSUES were found."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    each = found.agg(*[F.count_if(F.col("issue") == i).alias(f"{i.replace(' ', '_')}s") for i in ISSUES])
    return count(questions, "questions").join(count(annotations, "annotations")).join(count(answerable(annotations, grades, jobs), "answerable")).join(each)


def retrieval(ranking: DataFrame, questions: DataFrame, annotations: DataFrame, grades: DataFrame, jobs: DataFrame, accuracy: DataFrame, splits: DataFrame, k: int = 8) -> DataFrame:
    """part, asked, recall, mrr, graded_ndcg (condensed), filter_accuracy of the answerable questions: of all, and of each split.

    Only grades of active jobs count. A question in no split is of the part evaluation; one without hits has an accuracy of 1.
    """
    active = grades.join(jobs.where("is_active").select(F.col("job_id").alias("item")), "item", "left_semi")
    asked = questions.select("query_id").join(answerable(annotations, grades, jobs), "query_id", "left_semi")
    rows = asked.join(metrics(ranking, active, k), "query_id", "left").join(accuracy, "query_id", "left").join(splits, "query_id", "left")
    parts = F.explode(F.array(F.lit("all"), F.coalesce("split", F.lit("evaluation"))))
    rows = rows.withColumn("filter_accuracy", F.coalesce("filter_accuracy", F.lit(1.0))).select("*", parts.alias("part"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("asked"), *[_mean(F.coalesce(c, F.lit(0.0))).alias(name) for c, name in _MEANS.items()])


def gated(parts: DataFrame) -> DataFrame:
    """One row with the means that the gates judge: those of the split test if it has questions, else of all."""
    row = F.struct(F.col("part").alias("gate_part"), "asked", *_MEANS.values())
    none = F.struct(F.lit("all").alias("gate_part"), F.lit(0).cast("long").alias("asked"), *[F.lit(0.0).alias(n) for n in _MEANS.values()])
    one = parts.agg(F.max(F.when(F.col("part") == "test", row)).alias("test"), F.max(F.when(F.col("part") == "all", row)).alias("whole"))
    return one.select(F.coalesce("test", "whole", none).alias("x")).select("x.*")


def answered(questions: DataFrame, annotations: DataFrame, answers: DataFrame, sources: DataFrame, accuracy: DataFrame) -> DataFrame:
    """query_id, expected_refusal, refused, refusal_correct, citation_valid, analysis_valid, source_count for each question.

    An annotation decides over its question whether a refusal is due. Sources must differ and meet the question's conditions (accuracy 1),
    and where counts over a total of sources are given they must lie within it and their percentages follow from it. A
    question without an answer counts as answered without sources and citations.
    """
    marked = annotations.groupBy("query_id").agg(F.bool_or("should_refuse").alias("marked"))
    of = sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("source_count"), F.count_distinct("job_id").alias("differ"))
    rows = questions.join(marked, "query_id", "left").join(answers, "query_id", "left").join(of, "query_id", "left").join(accuracy, "query_id", "left")
    n, total = F.coalesce("source_count", F.lit(0)).cast("long"), F.col("total")
    right = lambda c: F.coalesce((c["jobs"] >= 0) & (c["jobs"] <= total) & (c["percentage"] == F.bround(F.try_divide(c["jobs"] * 100, total), 1)), F.lit(False))
    counted = total.isNull() | ((total == n) & F.coalesce(F.forall("counts", right), F.lit(True)))
    expected = F.coalesce("marked", "should_refuse", F.lit(False))
    rows = rows.select("query_id", expected.alias("expected_refusal"), F.coalesce("refused", F.lit(False)).alias("refused"), F.coalesce("citation_passed", F.lit(False)).alias("passed"), (F.coalesce(n == F.col("differ"), F.lit(True)) & (F.coalesce("filter_accuracy", F.lit(1.0)) == 1) & counted).alias("analysis_valid"), n.alias("source_count"))
    return rows.select("query_id", "expected_refusal", "refused", (F.col("refused") == F.col("expected_refusal")).alias("refusal_correct"), (F.col("refused") | F.col("passed")).alias("citation_valid"), "analysis_valid", "source_count")


def answer_layers(rows: DataFrame) -> DataFrame:
    """One row over answered(): the analysis and citation rates of questions to be answered, and how well refusals are told."""
    rate = lambda c, of: _mean(F.when(of, F.col(c).cast("double")))
    due = F.col("expected_refusal")
    return rows.agg(F.count_if(~due).alias("answer_cases"), F.count_if(due).alias("refusal_cases"), rate("analysis_valid", ~due).alias("analysis_rate"), rate("citation_valid", ~due).alias("citation_rate"), rate("refusal_correct", due).alias("refusal_accuracy"))


def operations(jobs: DataFrame, chunks: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    """One row: active_jobs, active_stale_jobs, active_chunks, indexed_chunks, inactive_chunks, index_coverage (1 without active chunks)."""
    live = jobs.agg(F.count_if("is_active").alias("active_jobs"), F.count_if(F.col("is_active") & stale(as_of, days)).alias("active_stale_jobs"))
    own = chunks.select("job_id", F.col("embedding").isNotNull().alias("indexed")).join(jobs.select("job_id", "is_active"), "job_id")
    held = own.agg(F.count_if("is_active").alias("active_chunks"), F.count_if(F.col("is_active") & F.col("indexed")).alias("indexed_chunks"), F.count_if(~F.col("is_active")).alias("inactive_chunks"))
    return live.join(held).withColumn("index_coverage", F.coalesce(F.bround(F.try_divide("indexed_chunks", "active_chunks"), 4), F.lit(1.0)))


def gates(values: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """gate, actual, expected, passed: one row of GATES each for a one-row table of all layers' values."""
    rows = []
    for value, name, default in GATES:
        limit, least = float(limits.get(name, default)), name.startswith("minimum")
        actual = F.col(value).cast("double")
        rows.append(F.struct(F.lit(value).alias("gate"), actual.alias("actual"), F.lit(f"{'>=' if least else '<='}{limit:g}").alias("expected"), F.coalesce(actual >= limit if least else actual <= limit, F.lit(False)).alias("passed")))
    return values.select(F.inline(F.array(*rows)))
