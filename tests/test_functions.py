import datetime

from pyspark.sql import functions as F

from tarn.functions import scalar as S
from tarn.operators import retrieval
from tarn.sources import html


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_urls_and_identity(spark):
    assert value(spark, S.canonical_url(F.lit(" HTTPS://Ex.com/Jobs/1/?a=b#c "))) == "https://ex.com/Jobs/1"
    assert value(spark, S.canonical_url(F.lit(None).cast("string"))) == ""
    one = [F.lit(x) for x in ("LinkedIn", "li-1", "https://a/1", "T", "C", "L")]
    two = [F.lit(x) for x in ("linkedin", " li-1", "https://b/2", "U", "D", "M")]
    assert value(spark, S.fingerprint(*one)) == value(spark, S.fingerprint(*two))


def test_salary(spark):
    got = value(spark, S.salary_range(F.lit("$120k - $150k a year")))
    assert got.asDict() == {"interval": "yearly", "min_amount": 120000, "max_amount": 150000, "currency": "USD"}
    assert value(spark, S.salary_range(F.lit("$20 - $30 an hour"), annual=True)).min_amount == 41600
    assert value(spark, S.salary_range(F.lit("$300 - $400"))) is None
    assert value(spark, S.salary_range(F.lit("none"))) is None
    assert value(spark, S.lakh_salary(F.lit("3-6 Lacs P.A."))).max_amount == 600000


def test_numbers_and_dates(spark):
    assert value(spark, S.currency(F.lit("EUR 1.234,50"))) == 1234.5
    assert value(spark, S.currency(F.lit("12"))) == 12.0
    assert value(spark, S.currency(F.lit("abc"))) is None
    assert value(spark, S.iso_date(F.lit("2026-07-01T10:00"))) == datetime.date(2026, 7, 1)
    assert value(spark, S.iso_date(F.lit("soon"))) is None
    as_of = F.lit("2026-09-20").cast("date")
    assert value(spark, S.days_ago(F.lit("3 days ago"), as_of)) == datetime.date(2026, 9, 17)
    assert value(spark, S.days_ago(F.lit("Just now"), as_of)) == datetime.date(2026, 9, 20)


def test_places(spark):
    p = value(spark, S.location_parts(F.lit("Austin, TX, USA")))
    assert (p.city, p.state, p.country) == ("Austin", "TX", "USA")
    assert value(spark, S.location_parts(F.lit("Remote"))) is None
    assert value(spark, S.location_display(F.lit("Austin"), F.lit("TX"), F.lit("usa"))) == "Austin, TX, USA"
    assert value(spark, S.work_place(F.lit("Hybrid or remote"))) == "Hybrid"


def test_headings(spark):
    for line, section in (("What you'll do:", "responsibilities"), ("Requirements", "required_qualifications"), ("任职要求", "required_qualifications"), ("We have requirements.", None), ("", None), ("skills " * 20, None)):
        assert value(spark, S.heading_section(F.lit(line))) == section, line


def test_families_and_terms(spark):
    a = value(spark, S.title_family(F.lit("ML Engineer (Ph.D.) - 2026 Start"), F.lit("Acme")))
    assert a == value(spark, S.title_family(F.lit("ml engineer"), F.lit("ACME"))) == "acme|ml engineer"
    assert value(spark, S.contains_term(F.lit("Go and C++"), "c++")) and not value(spark, S.contains_term(F.lit("storage"), "rag"))
    assert retrieval.query_terms("RAG 深度学习") == ["deep learning", "rag", "学习", "度学", "深度"]
    assert retrieval.scope_query("How many requirements for Python Engineer", "intern") == "intern for Python Engineer"
    assert retrieval.scope_query("有哪些") == "有哪些"


def test_answers_columns(spark):
    c = value(spark, S.citation_check(F.lit("a [1] b [4] c [1]"), F.lit(3)))
    assert (c.valid, c.invalid, c.status) == ([1], [4], "failed")
    assert value(spark, S.route(F.lit("统计全库的天气"))) == "refusal"
    assert value(spark, S.has_amount(F.lit("Pay: SGD 3,000 monthly")))
    assert value(spark, S.fenced_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, S.fenced_json(F.lit("no"))) is None
    assert value(spark, S.bounded(F.lit("9"))) == 5


def test_html(spark):
    raw = "<h2>Role</h2><script>x</script><p>a&amp;b<br>c</p>"
    assert html.clean_html(raw).split() == ["Role", "a&b", "c"]
    assert html.clean_html("<h2>Role</h2><li>x</li>", markdown=True) == "## Role\n\n* x"
    assert html.clean_html(None) == ""
    assert value(spark, html.plain(F.lit(raw))) == "Role a&b c"
    assert value(spark, html.labelled(F.lit("<h3>Seniority level</h3> <span>Entry</span>"), "Seniority level")) == "Entry"
