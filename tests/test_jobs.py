"""The jobs on copies of small tables: growing input, repeated batches, failures, rows of every kind."""

import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import posting_intake, registry, skill_report
from jobs.common import config
from test_catalogue import plain, TABLES

ROW = "doc_id long, source string, text string, lang string, url string"


def conf(**more):
    out = config("posting_intake")
    out["columns"] = out["columns"] | {"job_url": "url"}
    return out | {"schema": ROW, "chunk_chars": 10, "chunk_overlap": 2, "files_per_batch": 1} | more


def land(spark, folder, name, *rows):
    path = f"{folder}/landing-{name}"
    spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(path)
    os.makedirs(f"{folder}/landed", exist_ok=True)
    (part,) = glob.glob(f"{path}/part-*")
    os.rename(part, f"{folder}/landed/{name}.parquet")


def state(spark, out):
    rows = posting_intake.current(spark, out).collect()
    return {(r.source, r.source_job_id, r.title, r.change, r.n_versions, r.piece, r.content, r.batch) for r in rows}


def files(out):
    return sorted(p for p in glob.glob(f"{out}/**/part-*", recursive=True))


FIRST = [(1, "a", "title one\nlong text of the first", "en", "http://e.com/1"), (2, "a", "two", "de", None), (3, "b", None, None, None), (3, "b", None, None, None)]
SECOND = [(1, "a", "title one\nother text", "en", "http://e.com/1"), (2, "a", "two", "de", None), (4, "a", "title one\nother text", "en", "http://e.com/1?x=2"), (5, "c", "new", "fr", None)]


def test_intake_of_growing_input(spark, tmp_path):
    out = str(tmp_path / "out")
    land(spark, tmp_path, "a", *FIRST)
    posting_intake.run(spark, f"{tmp_path}/landed", out, conf())
    first = state(spark, out)
    assert {x[:6] for x in first} == {("a", "1", "title one", "inserted", 1, i) for i in range(4)} | {("a", "2", "two", "inserted", 1, 0), ("b", "3", "Untitled", "inserted", 1, None)}
    before = files(out)
    land(spark, tmp_path, "b", *SECOND)
    posting_intake.run(spark, f"{tmp_path}/landed", out, conf())
    got = state(spark, out)
    # 1 has another text; 4 stands at 1's URL with 1's text; 2 and 3 are as they were, with the chunks of batch 0
    assert {x for x in got if x[7] == 0} == {x for x in first if x[1] != "1"}
    assert {x[:6] for x in got if x[7] == 1} == {("a", "1", "title one", "updated", 2, i) for i in range(3)} | {("c", "5", "new", "inserted", 1, 0)}
    assert set(before) <= set(files(out))
    again = files(out)
    posting_intake.run(spark, f"{tmp_path}/landed", out, conf())
    assert files(out) == again and state(spark, out) == got
    # the last batch again, as if it had ended before Spark noted so
    for name in (f"{out}/_checkpoint/commits/1", f"{out}/_checkpoint/commits/.1.crc"):
        os.path.exists(name) and os.remove(name)
    posting_intake.run(spark, f"{tmp_path}/landed", out, conf())
    assert state(spark, out) == got
    assert posting_intake.versions(spark, out).count() == 5


def test_intake_ends_where_it_failed(spark, tmp_path, monkeypatch):
    land(spark, tmp_path, "a", *FIRST)
    land(spark, tmp_path, "b", *SECOND)
    clean, out = str(tmp_path / "clean"), str(tmp_path / "out")
    posting_intake.run(spark, f"{tmp_path}/landed", clean, conf())
    calls = []

    def fail(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost between two writes")
        return stride(*a)

    stride = posting_intake.chunking.stride
    monkeypatch.setattr(posting_intake.chunking, "stride", fail)
    with pytest.raises(Exception, match="lost between"):
        posting_intake.run(spark, f"{tmp_path}/landed", out, conf())
    posting_intake.run(spark, f"{tmp_path}/landed", out, conf())
    assert state(spark, out) == state(spark, clean) and posting_intake.versions(spark, out).count() == posting_intake.versions(spark, clean).count()


def test_intake_of_an_empty_file(spark, tmp_path):
    land(spark, tmp_path, "a")
    land(spark, tmp_path, "b", *FIRST)
    out = str(tmp_path / "out")
    posting_intake.run(spark, f"{tmp_path}/landed", out, conf())
    assert len(state(spark, out)) == 6


def postings(spark, path, *rows):
    spark.createDataFrame(rows, "t string, location string, source string, description string, day date, month string, rank string").write.parquet(path)


def test_report_of_months(spark, tmp_path):
    import datetime

    day = lambda m, d=1: datetime.date(2026, m, d)
    rows = [("x", "de", "s1", "python and SQL", day(1), "z", "z"), ("x", "de", "s2", "python and SQL", day(1, 9), "z", "z"), ("x", "de", "s1", "python", day(1), "z", "z"), ("x", "de", "s1", "sql", day(2), "z", "z"), ("x", "de", "s1", "Python", day(2), "z", "z"), ("x", None, "s1", None, None, "z", "z"), ("x", " ", "s1", "python", None, "z", "z"), ("x", "a/b=c", "s1", "sql", day(3), "z", "z")]
    landed, out = f"{tmp_path}/in", f"{tmp_path}/out"
    postings(spark, landed, *rows)
    own = config("skill_report") | {"columns": {"title": "t", "location": "location", "source": "source", "description": "description", "date_posted": "day"}, "skills": {"Python": r"\bpython\b", "SQL": r"\bsql\b"}}
    want = {("2026-01", "de", "Python", 2, 2, 100.0, 1, None), ("2026-01", "de", "SQL", 1, 2, 50.0, 2, None), ("2026-02", "de", "Python", 1, 2, 50.0, 1, -50.0), ("2026-02", "de", "SQL", 1, 2, 50.0, 2, 0.0), ("2026-03", "a/b=c", "SQL", 1, 1, 100.0, 1, None), ("unknown", "unknown", "Python", 1, 2, 50.0, 1, None)}
    read = lambda c=own: {(r.month, r.location, r.skill, r.jobs, r.total, r.percentage, r["rank"], r.change) for r in skill_report.read(spark, out, c).collect()}
    for _ in range(2):
        skill_report.run(spark, landed, out, own)
        assert read() == want
    # one month alone: the others' files stay, its own are replaced
    kept = {p: os.path.getmtime(p) for p in files(out)}
    setting = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    skill_report.run(spark, landed, out, own | {"months": ["2026-02"]})
    assert read() == want and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == setting
    now = set(files(out))
    assert {p for p in kept if "2026-02" not in p} <= now and not {p for p in kept if "2026-02" in p} & now
    skill_report.run(spark, landed, out, own | {"filters": {"location": "DE", "title": "x"}})
    assert read() == {x for x in want if x[1] == "de"}
    postings(spark, f"{tmp_path}/none")
    skill_report.run(spark, f"{tmp_path}/none", out, own)
    assert read() == set()


def test_command_line(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    env = dict(os.environ, PYTHONPATH=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), SPARK_MASTER="local[2]")
    done = subprocess.run([sys.executable, "-m", "jobs.skill_report", f"{sf_dir}/documents.parquet", out], capture_output=True, text=True, env=env, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 rows" in done.stderr
    rows = skill_report.read(spark, out, config("skill_report"))
    assert rows.count() > 0 and rows.where(F.col("rank") == 1).count() == rows.select("month", "location").distinct().count()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, sf_dir, name):
    import duckdb

    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_texts_are_written_once_besides_the_chunks(spark, tmp_path, monkeypatch):
    """Of the tables that a batch keeps on its way, only the rows that it read have texts."""
    kept, keep = [], posting_intake.keep
    monkeypatch.setattr(posting_intake, "keep", lambda df: kept.append(df.columns) or keep(df))
    rows = spark.createDataFrame([(i, "some text", "en", "src", 9) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    posting_intake.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config("posting_intake"))
    assert [("description" in c) for c in kept].count(True) == 1 and posting_intake.current(spark, f"{tmp_path}/out").count() == 5
