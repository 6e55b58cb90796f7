"""The jobs as queries: each runs twice over the whole tables into one new folder, and gives what stands there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import posting_intake, skill_report
from jobs.common import config
from tarn.session import shared_dir


def job1_posting_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, conf = shared_dir(spark), config("posting_intake")
    for _ in range(2):  # the second run finds no new file; the pattern stands for a file as well as for a folder
        posting_intake.run(spark, f"{sf_dir}/documents.parquet*", out, conf)
    rows = posting_intake.current(spark, out)
    return rows.select("source", "source_job_id", "title", "location", "change", "n_versions", "n_chars", "piece", F.col("content_hash").alias("digest"))


def job2_skill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, conf = shared_dir(spark), config("skill_report")
    for _ in range(2):
        skill_report.run(spark, f"{sf_dir}/documents.parquet", out, conf)
    return skill_report.read(spark, out, conf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_posting_intake, job2_skill_report)}

_TITLE = "coalesce(nullif(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')), ''), 'Untitled')"
_SKILLS = [(n, p) for n, p in config("skill_report")["skills"].items()]

SQL = {
    "job1_posting_intake": f"""
        select source, doc_id::varchar as source_job_id, {_TITLE} as title, lang as location, 'inserted' as change, 1::bigint as n_versions,
               coalesce(length(text), 0) as n_chars, cast(s // 1620 as int) as piece, sha256(substring(text, s + 1, 1800)) as digest
        from (select *, unnest(case when length(text) > 0 then range(0, length(text), 1620) else [null] end) as s from documents)""",
    "job2_skill_report": f"""
        with d as (select distinct strftime(date '2026-01-01' + cast(doc_id % 200 as int), '%Y-%m') as month, lang as location, text from documents),
        t as (select month, location, count(*) as total from d group by all),
        h as ({" union all ".join(f"select month, location, '{n}' as skill, count_if(regexp_matches(text, '(?i){p}')) as jobs from d group by all" for n, p in _SKILLS)}),
        c as (select *, round_even(jobs * 100.0 / total, 1) as percentage, strftime(strptime(month || '-01', '%Y-%m-%d') - interval 1 month, '%Y-%m') as was from h join t using (month, location) where jobs > 0)
        select c.month, c.location, c.skill, c.jobs, c.total, c.percentage,
               cast(row_number() over (partition by c.month, c.location order by c.jobs desc, c.skill) as int) as rank, round_even(c.percentage - b.percentage, 1) as change
        from c left join c b on b.month = c.was and b.location = c.location and b.skill = c.skill""",
}
