"""The reranker experiment: a pool of scored chunks against a baseline ranking and people's grades, split by split.

scored has (query_id, job_id, chunk_id, score), baseline (query_id, item, place), grades (query_id, item, grade 0 to 2), splits
(split, query_id). Questions without a positive grade do not count. A job's score is that of its best chunk; of equal
ones the least chunk_id stands for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.evaluation import calibrate, first_places, macro_f1, metrics

PARTS = ("development", "test")


@dataclass
class Experiment:
    """summary (split, ranking, questions, recall_at_5, recall, mrr, graded_ndcg), coverage (split, coverage: the share of a
    question's positives that the pool holds, its mean), thresholds (low, high, macro_f1; no row if there is nothing to learn
    from), agreement (split, samples, accuracy, macro_f1, disagreements) and queue (split, query_id, job_id, chunk_id, score,
    predicted, actual): what people should look at again."""

    summary: DataFrame
    coverage: DataFrame
    thresholds: DataFrame
    agreement: DataFrame
    queue: DataFrame


def _mean(c: str) -> Column:
    # ten digits first, so that the order of a sum decides no half
    return F.bround(F.round(F.avg(F.coalesce(c, F.lit(0.0))), 10), 4)


def _summary(rankings: dict[str, DataFrame], grades: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    named = F.struct("ranking", "query_id").alias("query_id")
    rows = None
    for name, r in rankings.items():
        part = r.select(F.lit(name).alias("ranking"), "query_id", "item", "place").select(named, "item", "place")
        rows = part if rows is None else rows.unionByName(part)
    rows = first_places(rows)
    judged = grades.join(asked, "query_id").select(F.explode(F.array(*map(F.lit, rankings))).alias("ranking"), "query_id", "item", "grade").select(named, "item", "grade")
    early = metrics(rows, judged, 5).select("query_id", F.col("recall").alias("recall_at_5"))
    scored = metrics(rows, judged, k).join(early, "query_id").select("query_id.*", "recall_at_5", "recall", "rr", "graded_ndcg").join(asked, "query_id")
    return scored.groupBy("split", "ranking").agg(F.count(F.lit(1)).alias("questions"), _mean("recall_at_5").alias("recall_at_5"), _mean("recall").alias("recall"), _mean("rr").alias("mrr"), _mean("graded_ndcg").alias("graded_ndcg"))


def run(scored: DataFrame, baseline: DataFrame, grades: DataFrame, splits: DataFrame, parts: tuple[str, ...] = PARTS, k: int = 8) -> Experiment:
    """The experiment over the questions of these splits; thresholds are learned from all of them."""
    grades = grades.groupBy("query_id", "item").agg(F.max("grade").alias("grade"))
    positive = grades.where("grade > 0")
    asked = splits.where(F.col("split").isin(*parts)).select("split", "query_id").distinct().join(positive, "query_id", "left_semi")

    best = F.min(F.struct((-F.col("score")).alias("down"), "chunk_id"))
    jobs = scored.where("score is not null").groupBy("query_id", "job_id").agg(best.alias("best"))
    jobs = jobs.join(asked, "query_id").select("split", "query_id", "job_id", F.col("best.chunk_id").alias("chunk_id"), (-F.col("best.down")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "job_id"))
    reranked = jobs.select("query_id", F.col("job_id").alias("item"), place.alias("place"))

    samples = jobs.join(grades.select("query_id", F.col("item").alias("job_id"), F.col("grade").alias("actual")), ["query_id", "job_id"])
    different = samples.agg(F.count_distinct("actual").alias("labels")).where("labels > 1").select()
    thresholds = calibrate(samples.select("score", "actual")).join(different)
    # one row at most on the right
    level = F.when(F.col("score") < F.col("low"), 0).when(F.col("score") < F.col("high"), 1).otherwise(2)
    told = samples.join(F.broadcast(thresholds.select("low", "high"))).select("split", "query_id", "job_id", "chunk_id", "score", level.alias("predicted"), "actual")

    held = positive.join(asked, "query_id").join(jobs.select("query_id", F.col("job_id").alias("item"), F.lit(1).alias("held")), ["query_id", "item"], "left")
    share = held.groupBy("split", "query_id").agg((F.count("held") / F.count(F.lit(1))).alias("share"))
    return Experiment(
        _summary({"baseline": baseline, "reranked": reranked}, grades, asked, k),
        share.groupBy("split").agg(_mean("share").alias("coverage")),
        thresholds,
        macro_f1(told, "split"),
        told.where("predicted <> actual"),
    )
