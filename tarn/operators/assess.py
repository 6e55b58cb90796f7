"""Evaluation runs: which questions count, the modes' benchmark, the holdout, reranking, judged answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import lexicon as L
from tarn.functions import scalar as S
from tarn.operators.evaluation import first_places, metrics
from tarn.session import small_batches

# Least means over a holdout's questions.
HOLDOUT = {"recall": 0.75, "graded_ndcg": 0.75, "filter_accuracy": 1.0}
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens")


def answerable(annotations: DataFrame, grades: DataFrame, jobs: DataFrame) -> DataFrame:
    """The annotations (query_id, should_refuse) that ask for no refusal and have a positive grade on an active job."""
    good = grades.where("grade > 0").join(jobs.where("is_active").select(F.col("job_id").alias("item")), "item", "left_semi")
    return annotations.where(~F.coalesce("should_refuse", F.lit(False))).join(good, "query_id", "left_semi")


def filter_accuracy(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, filter_accuracy: the part of a question's hits that meet its conditions, 1 without hits.

    wanted has one row for each query_id. A source must be equal, the other fields must contain the wanted text, whatever the case; an empty
    or missing condition is none.
    """
    fields = ("source", "location", "title", "job_type")
    low = lambda c, name: F.lower(F.coalesce(c, F.lit(""))).alias(name)
    want = wanted.select("query_id", *[low(F.col(c), f"want_{c}") for c in fields])
    own = hits.select("query_id", F.lit(1.0).alias("hit"), *[low(F.col(c), f"own_{c}") for c in fields])
    meets = lambda c: F.col(f"own_{c}") == F.col(f"want_{c}") if c == "source" else F.col(f"own_{c}").contains(F.col(f"want_{c}"))
    ok = reduce(lambda a, b: a & b, [(F.col(f"want_{c}") == "") | meets(c) for c in fields])
    share = F.avg(F.when(ok, F.col("hit")).when(F.col("hit").isNotNull(), F.lit(0.0)))
    return want.join(own, "query_id", "left").groupBy("query_id").agg(F.coalesce(share, F.lit(1.0)).alias("filter_accuracy"))


def benchmark(rankings: dict[str, DataFrame], grades: DataFrame, k: int = 8) -> DataFrame:
    """mode, questions, recall, mrr, ndcg: means over all graded questions, for the rankings (query_id, item, place) of each mode."""
    asked = F.struct("mode", "query_id").alias("query_id")
    ranked = reduce(DataFrame.unionByName, [r.select(F.struct(F.lit(m).alias("mode"), "query_id").alias("query_id"), "item", "place") for m, r in rankings.items()])
    named = grades.select(F.explode(F.array(*map(F.lit, rankings))).alias("mode"), "query_id", "item", "grade").select(asked, "item", "grade")
    mean = lambda c, name: F.bround(F.avg(c), 4).alias(name)
    rows = metrics(first_places(ranked), named, k).groupBy(F.col("query_id.mode").alias("mode"))
    return rows.agg(F.count(F.lit(1)).alias("questions"), mean("recall", "recall"), mean("rr", "mrr"), mean("ndcg", "ndcg"))


def holdout(ranking: DataFrame, annotations: DataFrame, grades: DataFrame, splits: DataFrame, accuracy: DataFrame, split: str = "test", expected: dict[str, float] = HOLDOUT) -> DataFrame:
    """One row: split, status, how many of its questions are in each state, their means and whether all gates pass.

    A question without annotation is missing; one to be answered without a positive grade is invalid; either makes the run
    invalid, and then nothing passes. Means are taken over answerable questions.
    """
    known = annotations.groupBy("query_id").agg(F.coalesce(F.bool_or("should_refuse"), F.lit(False)).alias("refuse"))
    positive = grades.where("grade > 0").select("query_id").distinct().withColumn("positive", F.lit(True))
    rows = splits.where(F.col("split") == split).select("query_id").distinct().join(known, "query_id", "left").join(positive, "query_id", "left")
    state = F.when(F.col("refuse").isNull(), "missing").when(F.col("refuse"), "refusal").when(F.col("positive").isNull(), "invalid").otherwise("answerable")
    scored = rows.select("query_id", state.alias("state")).join(metrics(ranking, grades), "query_id", "left").join(accuracy, "query_id", "left")
    mean = lambda c, empty: F.bround(F.avg(F.when(F.col("state") == "answerable", F.coalesce(c, F.lit(empty)))), 4).alias(c)
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("missing", "invalid", "refusal", "answerable")]
    out = scored.agg(*states, mean("recall", 0.0), mean("graded_ndcg", 0.0), mean("filter_accuracy", 1.0))
    valid = F.col("missing") + F.col("invalid") == 0
    passed = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= e, F.lit(False)) for c, e in expected.items()], valid)
    return out.select(F.lit(split).alias("split"), F.when(valid, "complete").otherwise("invalid").alias("status"), *out.columns, passed.alias("passed"))


def rerank(pairs: DataFrame, score: Callable[[str, list[str]], list[float]], batch: int = 16) -> DataFrame:
    """pairs (query, passage, …) with score, which score(query, passages) gives for batches of one query's passages; null for a null query."""
    def scored(query: pd.Series, passage: pd.Series) -> pd.Series:
        out = pd.Series(float("nan"), index=query.index)
        for q, at in passage.groupby(query).groups.items():
            for i in range(0, len(at), batch):
                part = at[i : i + batch]
                out.loc[part] = score(q, passage.loc[part].fillna("").tolist())
        return out

    return small_batches(pairs).withColumn("score", F.pandas_udf(scored, "double")("query", "passage"))


def job_scores(scored: DataFrame) -> DataFrame:
    """query_id, job_id, score, place: a job's score is that of its best chunk; chunks without a score do not count."""
    best = scored.groupBy("query_id", "job_id").agg(F.max("score").alias("score")).where("score is not null")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "job_id")))


def _judgment(c: Column, found: Column, source_count: Column) -> Column:
    """A claim (struct<claim, verdict, source_numbers, evidence_quote>) put in order: an unknown verdict is unsupported; numbers beyond the sources are listed apart."""
    numbers = F.coalesce(c["source_numbers"], F.array().cast("array<int>"))
    inside = lambda n: (n >= 1) & (n <= source_count)
    verdict = F.when(c["verdict"].isin(*[v for v, _ in L.VERDICTS]), c["verdict"]).otherwise("unsupported")
    return F.struct(
        c["claim"].alias("claim"), verdict.alias("verdict"), F.filter(numbers, inside).alias("source_numbers"), F.filter(numbers, lambda n: ~inside(n)).alias("invalid_source_numbers"),
        c["evidence_quote"].alias("evidence_quote"), found.alias("evidence_quote_found"),
    )


def _weights() -> Column:
    return F.create_map(*[F.lit(x) for pair in L.VERDICTS for x in pair])


def _groundedness(total: Column, claims: Column) -> Column:
    """Mean weight to four places, halves to the even one; null without claims."""
    return F.rint(F.try_divide(total, claims) * 10000) / 10000


def judged(rows: DataFrame, kept: int | None = None) -> DataFrame:
    """rows (claims, evidence, source_count, …) with judged, the claims put in order, claim_count and groundedness.

    claims is array<struct<claim, verdict, source_numbers, evidence_quote>>; with kept only so many of the first count. A quote is found if the evidence contains it, whatever the
    case and the blanks. Groundedness is null without claims.
    """
    found = lambda c: F.coalesce(S.quote_found(c["evidence_quote"], S.quote_words(F.col("evidence"))), F.lit(False))
    claims = F.coalesce("claims", F.array().cast(rows.schema["claims"].dataType))
    claims = claims if kept is None else F.slice(claims, 1, kept)
    out = rows.withColumn("judged", F.transform(claims, lambda c: _judgment(c, found(c), F.col("source_count")))).withColumn("claim_count", F.size("judged"))
    total = F.aggregate("judged", F.lit(0.0), lambda s, c: s + _weights()[c["verdict"]])
    return out.withColumn("groundedness", _groundedness(total, F.col("claim_count")))


def claim_summary(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, claim_count, groundedness, quotes, invalid_numbers of all claims, which are rows of their own: a question may have any number.

    claims (query_id, claim, verdict, source_numbers, evidence_quote); answers (query_id, evidence, source_count), one row for each question.
    quotes is null if of none it is known whether it was found, and invalid_numbers if all numbers are null.
    """
    told = claims.select("query_id", F.struct("claim", "verdict", "source_numbers", "evidence_quote").alias("c"))
    asked = answers.select(F.col("query_id").alias("of"), S.quote_words(F.col("evidence")).alias("evidence"), "source_count")
    rows = told.join(asked, F.col("query_id").eqNullSafe(F.col("of"))).select("query_id", _judgment(F.col("c"), S.quote_found(F.col("c.evidence_quote"), F.col("evidence")), F.col("source_count")).alias("j"), "c.source_numbers")
    count = lambda c: F.sum(c).cast("int")
    numbered = F.coalesce(F.size("source_numbers") == 0, F.lit(True)) | F.exists("source_numbers", lambda n: n.isNotNull())
    return rows.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("claim_count"), _groundedness(F.sum(_weights()[F.col("j.verdict")]), F.count(F.lit(1))).alias("groundedness"),
        count(F.col("j.evidence_quote_found").cast("int")).alias("quotes"), count(F.when(numbered, F.size("j.invalid_source_numbers"))).alias("invalid_numbers"),
    )


def replies(texts: DataFrame, text: str = "text") -> DataFrame:
    """query_id, claims, relevance, completeness (1 to 5, null if no number), refusal_correct of a judge's answers: JSON, fenced or
    amid other words, with a list of evaluations; an answer that is no such JSON has none. The first evaluation of a question by its text counts."""
    kind = "struct<evaluations:array<struct<id:string,claims:array<struct<claim:string,verdict:string,source_numbers:array<int>,evidence_quote:string>>,answer_relevance:string,completeness:string,refusal_correct:boolean>>>"
    rows = texts.select(F.from_json(S.fenced_json(F.col(text)), kind).alias("j")).select(F.explode("j.evaluations").alias("e")).where("e.id is not null")
    one = rows.groupBy(F.col("e.id").alias("query_id")).agg(F.min("e").alias("e"))
    return one.select("query_id", "e.claims", S.bounded(F.col("e.answer_relevance")).alias("relevance"), S.bounded(F.col("e.completeness")).alias("completeness"), F.coalesce("e.refusal_correct", F.lit(False)).alias("refusal_correct"))


def response_summary(cases: DataFrame, evaluations: DataFrame, kept: int = 2) -> DataFrame:
    """One row: answerable, groundedness, relevance, completeness, refusals, refusal_accuracy, unjudged, over cases (query_id,
    expected_refusal, evidence, source_count) and replies(), of which the first kept claims count. Cases that no evaluation names are unjudged and count nowhere else; means over nothing are null."""
    rows = judged(cases.join(evaluations.withColumn("told", F.lit(True)), "query_id", "left"), kept)
    due, told = F.col("expected_refusal"), F.col("told").isNotNull()
    mean = lambda c, of: F.bround(F.round(F.avg(F.when(told & of, c)), 10), 4)
    return rows.agg(
        F.count_if(told & ~due).alias("answerable"), *[mean(F.col(c), ~due).alias(c) for c in ("groundedness", "relevance", "completeness")],
        F.count_if(told & due).alias("refusals"), mean(F.col("refusal_correct").cast("double"), due).alias("refusal_accuracy"), F.count_if(~told).alias("unjudged"),
    )


def usage_totals(rows: DataFrame) -> DataFrame:
    """One row with the sum of each counter of USAGE; a counter that is null or absent counts 0."""
    return rows.agg(*[F.coalesce(F.sum(c) if c in rows.columns else F.lit(None), F.lit(0)).cast("long").alias(c) for c in USAGE])


def chunk_signature(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row (n, first, last) that tells whether a keyword index still belongs to these chunks."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
