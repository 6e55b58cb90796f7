"""The bounded sample that models are fitted on."""

from pyspark.sql import functions as F

from tarn.llm.common import bounded_sample


def test_every_label_is_sampled(spark):
    rows = spark.range(0, 12_000, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") / 400).cast("int").cast("string")).alias("lang"))
    got = bounded_sample(rows, "lang", 400, 2000).collect()
    assert len({r.lang for r in got}) == 30 and 1600 < len(got) < 2000
    again = bounded_sample(rows.orderBy(F.desc("doc_id")), "lang", 400, 2000).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in again)
    # few labels: per_label of each
    assert 700 < bounded_sample(rows.where("doc_id < 1600"), "lang", 200, 2000).count() < 900
