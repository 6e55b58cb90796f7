"""What a collection wants of the boards' rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tarn.functions import scalar as S
from tarn.sources import boards

DAY = "2026-09-20"


def ids(spark, rows, **options):
    df = spark.createDataFrame(rows, "site string, id string, date_posted date, job_type string, location string, is_remote boolean")
    return [r.id for r in boards.wanted(df, boards.Options(**options), F.lit(DAY).cast("date")).orderBy("id").collect()]


ROWS = [
    ("indeed", "a", datetime.date(2026, 9, 20), "fulltime, internship", "Berlin, Germany", True),
    ("indeed", "b", datetime.date(2026, 9, 19), "Vollzeit", "Austin, TX, USA", None),
    ("indeed", "c", datetime.date(2026, 9, 10), None, None, False),
    ("bayt", "d", None, "Part-Time", "London, United Kingdom", False),
    ("bayt", "e", datetime.date(2026, 9, 18), "plný úvazek", "Remote", True),
]


def test_options(spark):
    assert ids(spark, ROWS) == list("abcde")
    assert ids(spark, ROWS, job_type="full time") == ["a", "b", "e"] and ids(spark, ROWS, job_type="Praktikum") == ["a"]
    assert ids(spark, ROWS, hours_old=24) == ["a", "b"] and ids(spark, ROWS, hours_old=0) == ["a"]
    assert ids(spark, ROWS, country="us") == ["b", "c", "e"] and ids(spark, ROWS, country=" UK ") == ["c", "d", "e"]
    assert ids(spark, ROWS, country="worldwide") == list("abcde")
    assert ids(spark, ROWS, is_remote=True) == ["a", "e"] and ids(spark, ROWS, sites=("bayt",)) == ["d", "e"]
    assert ids(spark, ROWS, results_wanted=1) == ["a", "e"] and ids(spark, ROWS, offset=1) == ["b", "c", "d"]
    assert ids(spark, ROWS, results_wanted=1, offset=1) == ["b", "d"] and ids(spark, ROWS[:0], results_wanted=3) == []
    for bad in ({"job_type": "king"}, {"country": "atlantis"}, {"sites": ("nowhere",)}):
        with pytest.raises(ValueError):
            boards.Options(**bad)


def test_names(spark):
    got = spark.createDataFrame([("Turkey", "OJT (on the job training)"), ("türkiye", "FULL_TIME"), ("x", "x"), (None, None)], "c string, j string").select(S.country(F.col("c")), S.job_type(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [("türkiye", "internship"), ("türkiye", "fulltime"), (None, None), (None, None)]


def test_collection_with_options(spark, tmp_path):
    jobs = [{"listing_key": str(i), "name": f"n{i}", "posted_time": f"2026-09-{i:02d}", "employment_type": "FULL_TIME" if i % 2 else "CONTRACT", "job_city": "Austin", "job_state": "TX", "job_country": "US"} for i in range(1, 9)]
    path = tmp_path / "zip_recruiter.json"
    path.write_text(json.dumps({"payload": json.dumps({"jobs": jobs})}) + "\n")
    options = boards.Options(job_type="fulltime", results_wanted=2, offset=1, country="usa", sites=("zip_recruiter",))
    rows = boards.collect(spark, {"zip_recruiter": str(path), "indeed": str(tmp_path / "none.json")}, F.lit(DAY).cast("date"), options=options).collect()
    assert [r.id for r in rows] == ["zr-5", "zr-3"] and tuple(rows[0].asDict()) == boards.FLAT
