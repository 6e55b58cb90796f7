"""Skills that postings ask for, by place and month: `python -m jobs.skill_report LANDED OUT [--config FILE]`.

LANDED is a path or pattern of files of postings. A text that several boards or rows of a place repeat within a month is one
posting. For each place and month the report has the postings that show each skill of the config's lexicon, their
share, the skill's rank, and the change of the share in points against the month before.

    OUT/month=YYYY-MM/location=L    a row for each skill

The config may name `filters` (source, location, title, job_type, date_after) and `months`, a list of YYYY-MM: then only
those months' folders are replaced, and one month before each is read for the change. Without it OUT is
replaced whole. Either way a rerun leaves the same rows.

Rows without a date or place are counted under the month or place `unknown`; a row without text is a posting without a skill,
and all such rows of a place and month are one; an empty table gives an empty report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import counted, log, main
from tarn.functions import scalar as S
from tarn.operators import stats
from tarn.operators.filters import Filters, both, matches

REPORT = "skill string, jobs long, total long, percentage double, rank int, change double, month string, location string"
UNKNOWN = "unknown"


def report(postings: DataFrame, lexicon: tuple) -> DataFrame:
    """month, location, skill, jobs, total, percentage, rank, change for postings (month, location, description).

    What is shuffled to find repeated texts is their hash and one flag for each skill.
    """
    keys = ["month", "location"]
    flagged = postings.select(*keys, F.sha2(F.coalesce("description", F.lit("")), 256).alias("digest"), stats.skill_flags(F.col("description"), lexicon).alias("flags"))
    counts = stats.skill_counts_by(flagged.dropDuplicates([*keys, "digest"]), keys, lexicon)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("jobs"), "skill"))
    before = counts.select(F.col("location"), "skill", F.date_format(F.add_months(F.try_to_date("month", "yyyy-MM"), 1), "yyyy-MM").alias("month"), F.col("percentage").alias("was")).where("month is not null")
    known = counts.join(before, [*keys, "skill"], "left")
    return known.withColumns({"rank": rank, "change": F.bround(F.col("percentage") - F.col("was"), 1)}).drop("was")


def read(spark: SparkSession, out: str, conf: dict) -> DataFrame:
    return spark.read.schema(REPORT).format(conf["write_format"]).load(out)


def run(spark: SparkSession, landed: str, out: str, conf: dict) -> None:
    raw, seen = counted(spark.read.format(conf["format"]).load(landed).select(*[F.expr(e).alias(n) for n, e in conf["columns"].items()]))
    rows = raw.where(matches(Filters(**conf["filters"]), active=False))
    rows = rows.withColumns({"month": F.coalesce(F.date_format("date_posted", "yyyy-MM"), F.lit(UNKNOWN)), "location": F.coalesce(S.empty_to_null(F.col("location")), F.lit(UNKNOWN))})
    months, mode = list(conf["months"]), "static"
    if months:
        wanted = F.col("month").isin(months)
        after = F.date_format(F.add_months(F.try_to_date("month", "yyyy-MM"), 1), "yyyy-MM").isin(months)
        rows, mode = rows.where(both(wanted | F.coalesce(after, F.lit(False)))), "dynamic"
    found = report(rows, tuple(conf["skills"].items()))
    found = found.where(F.col("month").isin(months)) if months else found
    new, wrote = counted(found.select(*[f.split()[0] for f in REPORT.split(", ")]).repartition("month", "location"))
    new.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month", "location").format(conf["write_format"]).save(out)
    log.info("%s: read %s rows from %s, wrote %s rows of %s", out, seen.get["rows"], landed, wrote.get["rows"], ", ".join(months) or "all months")


if __name__ == "__main__":
    main("skill_report", "Counts skills of postings by place and month.", run, "landed", "out")
