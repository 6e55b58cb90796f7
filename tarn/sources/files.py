"""Question sets, annotations and reports as files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import scalar as S
from tarn.operators.quality import LIMITS

# Parts of a question set, categories of questions, state and fields of a locked configuration.
SPLITS = ("development", "test", "refusal")
CATEGORIES = ("skills", "experience", "comparison", "filters", "insufficient_evidence")
LOCKED = "locked_for_holdout"
CONFIG = {"mode": "mode", "candidate_k": "candidate_k", "max_chunks_per_job": "per_job", "rrf_k": "rrf_k", "vector_weight": "vw", "keyword_weight": "kw"}
QUESTION = "id string, category string, query string, filters map<string,string>, expected_terms array<string>, relevant_job_ids array<string>, should_refuse boolean, notes string"


def questions(spark: SparkSession, path: str, categories: tuple | None = None) -> DataFrame:
    """Questions from JSON lines; comments (#) and blank lines are skipped.

    Raises ValueError for an empty set, a repeated id, and, with categories, an unknown one.
    """
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    rows = lines.select(F.from_json("value", QUESTION).alias("q")).select("q.*")
    faults = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("category").alias("category"))
    bad = faults.where("n > 1 or id is null").limit(5).collect()
    if bad:
        raise ValueError(f"repeated or missing ids: {[r['id'] for r in bad]}")
    if categories and (odd := faults.where(~F.col("category").isin(*categories)).limit(5).collect()):
        raise ValueError(f"unknown categories: {[r['category'] for r in odd]}")
    if rows.isEmpty():
        raise ValueError(f"no questions in {path}")
    return rows


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """query_id, item, grade from a JSON object of question id -> judgments."""
    kind = "map<string,struct<job_judgments:array<struct<job_id:string,relevance:int>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("query_id", "a"))
    rows = rows.select("query_id", F.inline("a.job_judgments")).select("query_id", F.col("job_id").alias("item"), F.col("relevance").alias("grade"))
    return rows.where("grade in (0, 1, 2) and item <> ''").dropDuplicates(["query_id", "item"])


def annotation_faults(rows: DataFrame) -> DataFrame:
    """query_id, fault of annotations (query_id, job_judgments array<struct<job_id, relevance>>, evidence_chunk_ids) that may not be stored."""
    ids = F.transform("job_judgments", lambda j: F.trim(j["job_id"]))
    faults = F.array(
        F.when(F.exists(ids, lambda i: F.coalesce(i, F.lit("")) == ""), "job without id"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "job judged twice"),
        F.when(F.exists("job_judgments", lambda j: ~F.coalesce(j["relevance"].isin(0, 1, 2), F.lit(False))), "grade outside 0 to 2"),
        F.when(F.exists("evidence_chunk_ids", lambda i: i < 1), "chunk id below 1"),
    )
    return rows.select("query_id", F.explode(F.array_compact(faults)).alias("fault"))


def _object(spark: SparkSession, path: str) -> dict:
    """A JSON object, by a path that Spark reads."""
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold an object")
    return found


def splits(spark: SparkSession, path: str) -> DataFrame:
    """split, query_id from a JSON object with a list of ids for each of SPLITS. Raises ValueError for other keys or a repeated id."""
    lists = _object(spark, path)
    if set(lists) != set(SPLITS) or not all(isinstance(ids, list) for ids in lists.values()):
        raise ValueError(f"{path} must have a list for each of {', '.join(SPLITS)}")
    rows = [(name, str(i)) for name in SPLITS for i in lists[name]]
    if len({i for _, i in rows}) < len(rows):
        raise ValueError(f"{path} names a question twice")
    return spark.createDataFrame(rows, "split string, query_id string")


def limits(spark: SparkSession, path: str) -> dict[str, float]:
    """The limits of the quality gates from a JSON object; those it lacks keep their defaults. Raises ValueError for an unknown one or no number."""
    given = _object(spark, path)
    given.pop("version", None)
    bad = [k for k, v in given.items() if k not in LIMITS or isinstance(v, bool) or not isinstance(v, int | float)]
    if bad:
        raise ValueError(f"{path} has unknown limits or no numbers: {', '.join(bad)}")
    return LIMITS | given


def locked(spark: SparkSession, path: str) -> dict:
    """The retrieval configuration that a file locks for the holdout, as a point of the tuning grid. Raises ValueError if it locks none."""
    found = _object(spark, path)
    config = found.get("config")
    if found.get("status") != LOCKED or not isinstance(config, dict) or set(config) != set(CONFIG):
        raise ValueError(f"{path} locks no configuration")
    return {CONFIG[k]: v for k, v in config.items()}


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """path, sha256 of whole files, for the snapshot that goes with a report."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"))


def records(df: DataFrame) -> DataFrame:
    """df for JSON: NaN becomes null, dates and times become ISO text."""
    as_json = {"float": lambda c: F.when(~F.isnan(c), c), "double": lambda c: F.when(~F.isnan(c), c), "date": lambda c: c.cast("string"), "timestamp": S.iso_text, "timestamp_ntz": S.iso_text}
    return df.select(*[as_json.get(kind, lambda c: c)(F.col(name)).alias(name) for name, kind in df.dtypes])


def write_report(path: str, report: dict) -> None:
    """A report as JSON; it replaces the former one in one step."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(part, path)


def read_report(path: str) -> dict | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)
