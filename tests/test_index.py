"""The keyword index against SQLite's full-text index, and its segments against one made anew."""

import random
import sqlite3

import pytest

from tarn.operators import index

COLUMNS = "chunk_id long, job_id string, title string, company string, location string, section_type string, content string"
NAMES = ("title", "company", "location", "section_type", "content")


def sqlite_scores(rows, questions):
    """(question, chunk) -> score of SQLite's bm25 with its `unicode61` words."""
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5({', '.join(NAMES)}, tokenize='unicode61')")
    for r in rows:
        con.execute(f"insert into t(rowid, {', '.join(NAMES)}) values (?, ?, ?, ?, ?, ?)", (r[0], *[x or "" for x in r[2:]]))
    out = {}
    for q, terms in questions.items():
        wanted = " or ".join('"' + t.replace('"', '""') + '"' for t in terms).replace(" or ", " OR ")
        for i, score in con.execute(f"select rowid, bm25(t, {', '.join(str(w) for w in index.FIELDS.values())}) from t where t match ?", (wanted,)):
            out[q, i] = -score
    return out


def asked(spark, questions):
    return spark.createDataFrame([(q, t) for q, terms in questions.items() for t in terms], "query_id int, term string")


def check(df, want):
    got = {(r.query_id, r.chunk_id): r.score for r in df.collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)
    return got


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocabulary = ["Python", "python.", "machine", "learning", "c++", "node.js", "the", "the", "the", "Café", "MÜNCHEN", "naïve", "x1", "日本語", "data-driven", "a_b", "ñandú", "Ünïcode;", "R&D", "(sql)"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, f"j{i % 40}", text(3), text(1), rng.choice(["Berlin", None, ""]), rng.choice(["skills", "general"]), text(rng.randrange(0, 60))) for i in range(150)]
    rows += [(150, "j0", "", "", "", "", ""), (151, "j1", None, None, None, None, None), (152, "j2", "machine", "learning", "", "", "x" * 50_000), (153, "j2", "", "", "", "", "the " * 20_000)]
    return rows


QUESTIONS = {1: ["python"], 2: ["machine learning"], 3: ["the the the", "c++"], 4: ["node.js", "data driven", "cafe"], 5: ["munchen", "nandu", "unicode"], 6: ["日本語"], 7: ["learning machine the", "sql", "berlin", "skills"], 8: ["nothing at all"], 9: ["a b"]}


def test_equals_sqlite(spark, corpus):
    rows = spark.createDataFrame(corpus, COLUMNS).repartition(5)
    want = sqlite_scores(corpus, QUESTIONS)
    assert {q for q, _ in want} == set(QUESTIONS) - {8}
    check(index.bm25(rows, index.FIELDS, asked(spark, QUESTIONS)), want)
    check(index.Index(spark).repair(rows, rows.select("job_id")).search(asked(spark, QUESTIONS)), want)


def test_very_many_words_are_joined(spark, corpus, monkeypatch):
    monkeypatch.setattr(index, "FEW_WORDS", 3)
    monkeypatch.setattr(index, "FEW_PHRASES", 2)
    rows = spark.createDataFrame(corpus, COLUMNS)
    check(index.bm25(rows, index.FIELDS, asked(spark, QUESTIONS)), sqlite_scores(corpus, QUESTIONS))
    check(index.Index(spark).repair(rows, rows.select("job_id")).search(asked(spark, QUESTIONS)), sqlite_scores(corpus, QUESTIONS))


def test_terms_without_words_and_empty_tables(spark, corpus):
    rows = spark.createDataFrame(corpus, COLUMNS)
    nothing = asked(spark, {1: ["?!", "", " "]})
    assert index.bm25(rows, index.FIELDS, nothing).count() == 0
    assert index.bm25(rows.limit(0), index.FIELDS, asked(spark, QUESTIONS)).count() == 0
    empty = index.Index(spark)
    assert empty.search(["python"]).count() == 0
    assert empty.repair(rows.limit(0), rows.select("job_id").limit(0)).search(["python"]).count() == 0


def test_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, "j", "", r.source, r.lang, "", r.text) for r in docs.collect()]
    questions = {1: ["licensed under the", "que"], 2: ["über", "de la", "en"], 3: ["in the", "src1"]}
    check(index.bm25(spark.createDataFrame(rows, COLUMNS), index.FIELDS, asked(spark, questions)), sqlite_scores(rows, questions))


def test_segments(spark, corpus, tmp_path, monkeypatch):
    """Repairs add segments, searches leave the dead out, merges bound the segments and drop the dead."""
    monkeypatch.setattr(index, "SEGMENTS", 3)
    rng = random.Random(9)
    live = {r[0]: r for r in corpus}
    frame = lambda rows: spark.createDataFrame(list(rows), COLUMNS)
    idx = index.Index(spark).repair(frame(live.values()), frame(live.values()).select("job_id"))
    first, counts = idx.segments[0], []
    for step in range(5):
        jobs = {f"j{rng.randrange(40)}" for _ in range(4)}
        old = [r for r in live.values() if r[1] in jobs]
        for r in old:
            del live[r[0]]
        for r in old[: len(old) // 2]:  # one half comes back with other texts, the rest is gone
            live[r[0]] = (*r[:6], f"rewritten {step} python machine learning")
        new = [r for r in live.values() if r[1] in jobs]
        idx.repair(frame(new), spark.createDataFrame([(j,) for j in jobs], "job_id string"))
        counts.append(len(idx.segments))
        want = sqlite_scores(list(live.values()), QUESTIONS)
        check(idx.search(asked(spark, QUESTIONS)), want)
    assert max(counts) == 3 and first in idx.segments  # the large segment was never written again
    assert {r.segment for r in idx.dead.collect()} <= {s.number for s in idx.segments}
    idx.save(f"{tmp_path}/index")
    again = index.Index.load(spark, f"{tmp_path}/index")
    check(again.search(asked(spark, QUESTIONS)), want)
    # everything is rewritten once the small segments outgrow the large one
    touched = frame(live.values()).select("job_id")
    for _ in range(3):
        again.repair(frame(live.values()), touched)
    assert len(again.segments) <= 3
    check(again.search(asked(spark, QUESTIONS)), want)


def test_the_scan_gets_the_words_as_a_filter(spark, corpus):
    rows = spark.createDataFrame(corpus, COLUMNS)
    plan = index.Index(spark).repair(rows, rows.select("job_id")).search(["python"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(term,python)]" in plan or "In(term, [python])" in plan or "IsNotNull(term), EqualTo(term,python)" in plan
    python_free = index.scan(rows, index.FIELDS, ["python"], "chunk_id")[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in python_free and "Arrow" not in python_free


def test_accents_come_from_the_rule():
    fold = dict(zip(index.ACCENTED, index.PLAIN))
    assert len(fold) > 100 and fold["é"] == "e" and fold["ñ"] == "n" and fold["ü"] == "u" and "ß" not in fold and "ø" not in fold


def test_one_pass_gives_postings_and_lengths(spark):
    rows = [("c1", "j1", "A b", None, "", "x", "b a b"), ("c2", "j1", "", "", "", "", ""), ("c3", "j2", None, None, None, None, "?!")]
    df = spark.createDataFrame(rows, "chunk_id string, job_id string, " + ", ".join(f"{f} string" for f in index.FIELDS))
    both = index.postings(df, sizes=True).cache()
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(both.where("term is not null")) == key(index.postings(df))
    assert key(both.where("term is null").select("chunk_id", "job_id", "dl")) == key(index.lengths(df))
