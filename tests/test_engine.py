"""Ingestion, chunks, retrieval, answers and state on small inline tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import chunking, evaluation, index, ingest, retrieval, state, stats
from tarn.operators.filters import Filters
from tarn.plans import answer
from tarn.plans.engine import Engine
from tarn.sources import boards, files

RAW = "id string, site string, title string, company string, location string, job_url string, description string, date_posted string, job_type string, is_remote boolean"
TEXT = "Responsibilities\n- Build RAG retrieval with Python\n- Serve models\n\nRequirements\nPython and SQL\n\nBenefits\nFree lunch"


def raw(spark, *rows):
    return spark.createDataFrame(rows, RAW)


def job(i, title="RAG Engineer", text=TEXT, url=None, place="Singapore", day="2026-09-01"):
    return (f"li-{i}", "linkedin", title, "Acme", place, url or f"https://x.com/j/{i}?t=1", text, day, "fulltime", None)


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.ingest(raw(spark, job(1), job(2, "Java Developer", "Responsibilities\nWrite Java services\n\nRequirements\nJava, Docker", place="Berlin")), "2026-09-02")
    e.index("2026-09-02")
    return e


def test_upsert_versions(spark):
    e = Engine(spark)
    first = e.ingest(raw(spark, job(1)), "2026-09-01").first()
    assert (first.inserted, first.updated, first.unchanged) == (1, 0, 0)
    assert e.ingest(raw(spark, job(1)), "2026-09-02").first().unchanged == 1
    assert e.ingest(raw(spark, job(1, text="new text")), "2026-09-03").first().updated == 1
    assert e.ingest(raw(spark, job(1)), "2026-09-04").first().updated == 1
    assert (e.jobs.count(), e.snapshots.count()) == (1, 2)


def test_url_identity(spark):
    e = Engine(spark)
    e.ingest(raw(spark, job(1, url="https://X.com/j/9/")), "2026-09-01")
    assert e.ingest(raw(spark, job(5, url="https://x.com/j/9?q=2")), "2026-09-02").first().unchanged == 1
    assert e.jobs.count() == 1


def test_expiry_and_return(spark):
    e = Engine(spark)
    e.ingest(raw(spark, job(1, day="2026-07-01"), job(2, day="2026-09-01")), "2026-09-01")
    e.expire("2026-09-20")
    assert e.jobs.where("is_active").count() == 1
    assert e.chunks.select("job_id").distinct().count() == 1
    assert e.ingest(raw(spark, job(1, day="2026-07-01")), "2026-09-21").first().reactivated == 1
    assert e.chunks.select("job_id").distinct().count() == 2


def test_sections(spark):
    rows = chunking.sections(spark.createDataFrame([("a", TEXT), ("b", "x " * 700 + "\nSkills\nGo"), ("c", None), ("d", "")], "job_id string, text string")).collect()
    got = {(r.job_id, r.section_type): r.body for r in rows}
    assert got["a", "responsibilities"] == "Build RAG retrieval with Python\n\nServe models"
    assert ("a", "benefits") not in got and ("b", "general") not in got and got["b", "skills"] == "Go"


def fold(text, size=1800, overlap=180):
    """The packing rule, one paragraph at a time."""
    if len(text) <= size:
        return [text]
    done, open_ = [], ""
    for p in (q.strip(" ") for q in text.split("\n\n")):
        if not p:
            continue
        if len(p) > size:
            done += ([open_] if open_ else []) + [p[i : i + size] for i in range(0, len(p), size - overlap)]
            open_ = ""
        elif open_ and len(f"{open_}\n\n{p}") > size:
            done.append(open_)
            open_ = f"{open_[-overlap:].lstrip()}\n\n{p}".strip()
        else:
            open_ = f"{open_}\n\n{p}".strip()
    return done + ([open_] if open_ else [])


def test_packing(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("w" * rng.choice((3, 400, 900, 2500, 5000)) for _ in range(rng.randint(1, 9))) for _ in range(25)] + ["", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.pack(F.col("t")).alias("p")).collect()
    assert all(r.p == fold(texts[r.i]) for r in rows)


def test_resync_keeps_unchanged(spark):
    old = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 2), ("c", "h3", 3)], "job_id string, content_hash string, v int")
    new = spark.createDataFrame([("a", "h1", 9), ("b", "h9", 9)], "job_id string, content_hash string, v int")
    out = chunking.resync(old, new, old.select("job_id"))
    assert sorted(map(tuple, out.collect())) == [("a", "h1", 1), ("b", "h9", 9)]


def test_retrieve(engine):
    hits = engine.retrieve("Python RAG retrieval", Filters(location="singapore")).collect()
    assert hits and {h.title for h in hits} == {"RAG Engineer"}
    assert engine.retrieve("Python", Filters(job_type="internship"), "vector").count() == 0
    assert engine.retrieve("检索增强 岗位", mode="keyword").orderBy("place").first().title == "RAG Engineer"
    with pytest.raises(ValueError):
        engine.retrieve("x", mode="other")
    with pytest.raises(ValueError):
        engine.retrieve("x", top=0)


def test_ranked_and_ask(engine):
    jobs = engine.ranked("Python RAG", top=1)
    assert len(jobs) == 1 and jobs[0]["title"] == "RAG Engineer" and jobs[0]["chunks"]
    a = engine.ask("Which jobs need Python?")
    assert a.intent == "evidence" and a.validation["passed"]
    counts = engine.ask("most common skill for RAG Engineer")
    assert counts.intent == "aggregate" and any(r["skill"] == "Python" for r in counts.statistics)
    assert engine.ask("weather today").intent == "refusal"
    assert engine.ask("salary of RAG Engineer").intent == "refusal"
    bad = engine.ask("Which jobs need Python?", generate=lambda q, c: "see [99]")
    assert bad.validation["fallback"] and "[1]" in bad.text
    assert {r.skill for r in engine.skills().collect()} >= {"Python", "SQL", "Docker"}


def test_save_and_load(engine, spark, tmp_path):
    engine.save(str(tmp_path / "v1"))
    again = Engine(spark).load(str(tmp_path / "v1"))
    assert again.version().first() == engine.version().first()
    engine.export(str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').count() >= 2


def test_failed_embeddings(spark):
    e = Engine(spark, embed=lambda texts: 1 / 0)
    e.ingest(raw(spark, job(1)), "2026-09-02")
    for _ in range(4):
        state_row = e.index("2026-09-03").first()
    assert state_row.indexed == 0 and state_row.failed == state_row.exhausted == state_row.total
    assert {r.embedding_attempts for r in e.chunks.collect()} == {3}


def test_pay_refusal():
    assert answer.pay_refusal("What skills?", [""]) is None
    assert answer.pay_refusal("highest salary", ["Pay $100"]) is not None
    assert answer.pay_refusal("highest salary", ["Pay $100", "SGD 500"]) is None


def ndcg(ranking, grades, k):
    import math

    gain = lambda xs: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(xs[:k]))
    best = gain(sorted((g for g in grades.values() if g), reverse=True))
    return gain([grades.get(x, 0) for x in ranking]) / best if best else 0.0


def test_metrics(spark):
    rng = random.Random(4)
    ranks, grades, want = [], [], {}
    for q in range(12):
        items = [f"i{j}" for j in rng.sample(range(30), 15)]
        g = {f"i{j}": rng.randint(0, 2) for j in rng.sample(range(30), 10)}
        ranks += [(f"q{q}", x, p) for p, x in enumerate(items, 1)]
        grades += [(f"q{q}", x, v) for x, v in g.items()]
        pos = {x for x, v in g.items() if v}
        want[f"q{q}"] = (len(pos & set(items[:8])) / len(pos), next((1 / p for p, x in enumerate(items[:8], 1) if x in pos), 0.0), ndcg(items, g, 8), ndcg([x for x in items if x in pos], g, 8))
    rows = evaluation.metrics(spark.createDataFrame(ranks, "query_id string, item string, place int"), spark.createDataFrame(grades, "query_id string, item string, grade int")).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r.recall, r.rr, r.graded_ndcg, r.condensed_ndcg) == pytest.approx(want[r.query_id])


def test_capped_is_greedy(spark):
    rng = random.Random(5)
    rows = [(q, f"c{q}-{i}", f"j{rng.randint(0, 4)}", rng.randint(1, 9) / 10, i, i) for q in range(20) for i in range(20)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, job_id string, rrf double, vector_rank int, keyword_rank int")
    got = {}
    for r in retrieval.capped(df, top=6).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q in range(20):
        taken, out = {}, []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[4])):
            if taken.get(r[2], 0) < 2 and len(out) < 6:
                taken[r[2]] = taken.get(r[2], 0) + 1
                out.append(r[1])
        assert got[q] == out


def test_grid_and_calibration(spark):
    assert len(evaluation.configs()) == 40
    samples = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.5, 1), (0.6, 1), (0.9, 2), (0.95, 2)], "score double, actual int")
    best = evaluation.calibrate(samples).first()
    assert best.macro_f1 == 1.0 and (best.low, best.high) == (0.5, 0.9)
    assert evaluation.calibrate(samples.limit(0)).count() == 0


def test_state(spark):
    now = F.lit("2026-09-20 01:30:00").cast("timestamp")
    slot = spark.range(1).select(state.next_slot(now).alias("s")).first().s
    assert str(slot) == "2026-09-21 01:00:00"
    runs = spark.createDataFrame([("2026-09-20", "running", "2026-09-19 20:00:00")], "scheduled_for string, status string, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp"))
    assert state.recover(runs, now).first().status == "failed"
    assert state.claim(runs, runs).count() == 0
    log = spark.createDataFrame([("secret query",)], "query string")
    assert set(state.private(log).columns) == {"query_hash", "query_length"}
    one = stats.requests(spark.createDataFrame([("ok", 123.4, False, False, 10, 15, "v1")], "status string, total_ms double, cache_hit boolean, refused boolean, prompt_tokens int, completion_tokens int, pipeline_version string")).first()
    assert (one.total, one.p50, one.prompt_tokens + one.completion_tokens) == (1, 123.4, 25)


def test_boards(spark, tmp_path):
    data = {
        "indeed": {"results": [{"job": {"key": "k1", "title": "Remote Dev", "datePublished": 1788220800000, "description": {"html": "<p>hi a@b.co</p>"}, "employer": {"name": "Acme"}, "location": {"city": "Austin", "admin1Code": "TX", "countryCode": "USA"}, "compensation": {"baseSalary": {"unitOfWork": "HOUR", "range": {"min": 20.5, "max": 30}}, "currencyCode": "USD"}}}]},
        "naukri": {"jobDetails": [{"jobId": "7", "title": "Dev", "companyName": "B", "jdURL": "/j", "jobDescription": "Hybrid", "footerPlaceholderLabel": "2 days ago", "tagsAndSkills": "a,b", "placeholders": [{"type": "salary", "label": "3-6 Lacs PA"}, {"type": "location", "label": "Pune"}]}]},
        "glassdoor": {"jobListings": [{"jobview": {"header": {"jobTitleText": "X", "locationName": "Paris, FR", "payPeriod": "ANNUAL"}, "job": {"listingId": 5, "description": "$50k - $60k"}}}]},
    }
    for site, payload in data.items():
        (tmp_path / f"{site}.json").write_text(json.dumps({"payload": json.dumps(payload)}) + "\n")
    page = '<li data-js-job><h2>Engineer</h2><a href="/en/1">x</a><div class="t-nowrap">C</div><div class="t-mute">Dubai</div></li>'
    (tmp_path / "bayt.json").write_text(json.dumps({"payload": page}) + "\n")
    rows = {r.site: r for r in boards.collect(spark, {s: str(tmp_path / f"{s}.json") for s in (*data, "bayt")}, F.lit("2026-09-20").cast("date")).collect()}
    assert tuple(next(iter(rows.values())).asDict()) == boards.FLAT
    i = rows["indeed"]
    assert (i.location, i.interval, i.min_amount, i.emails, i.is_remote, str(i.date_posted)) == ("Austin, TX, USA", "hourly", 20.0, "a@b.co", True, "2026-09-01")
    assert (rows["naukri"].max_amount, str(rows["naukri"].date_posted), rows["naukri"].work_from_home_type) == (600000.0, "2026-09-18", "Hybrid")
    assert rows["glassdoor"].date_posted is None and rows["glassdoor"].salary_source == "description" and rows["glassdoor"].min_amount == 50000
    assert (rows["bayt"].title, rows["bayt"].location) == ("Engineer", "Dubai")


def board(spark, tmp_path, site, payload):
    (tmp_path / f"{site}.json").write_text(json.dumps({"payload": payload}) + "\n")
    return boards.collect(spark, {site: str(tmp_path / f"{site}.json")}, F.lit("2026-09-20").cast("date")).orderBy("title").collect()


def test_linkedin_cards(spark, tmp_path):
    card = lambda n, title, time="", pay="": f'<li><div class="base-card base-search-card x"><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/dev-at-a-{n}?ref=1"></a><div class="base-search-card__info"><span class="sr-only">{title}</span><h4 class="base-search-card__subtitle"><a href="https://x.com/c?z=1">Acme</a></h4><div class="base-search-card__metadata"><span class="job-search-card__location">Austin, TX, United States</span>{pay}{time}</div></div></div></li>'
    page = card(11, "A") + card(12, "B", '<time class="job-search-card__listdate" datetime="2026-09-01">x</time>', '<span class="job-search-card__salary-info">$100,000 - $120,000</span>') + card(11, "C")
    a, b = board(spark, tmp_path, "linkedin", page)
    assert (a.id, a.title, a.date_posted, a.company, a.company_url) == ("li-11", "A", None, "Acme", "https://x.com/c")
    assert (b.id, b.title, str(b.date_posted), b.min_amount, b.max_amount, b.job_url) == ("li-12", "B", "2026-09-01", 100000.0, 120000.0, "https://www.linkedin.com/jobs/view/dev-at-a-12")
    ids = spark.createDataFrame([("li-7", None), (None, "https://x/jobs/view/a-99/?q=1"), ("x", "y")], "i string, u string").select(scalar.numeric_id(F.col("i"), F.col("u")).alias("n")).collect()
    assert [r.n for r in ids] == ["7", "99", None]


def test_google_pages(spark, tmp_path):
    job = ["Dev", "Acme", "Pune, MH, India", [["https://j.example/1"]], *[None] * 8, "3 days ago", *[None] * 6, "Work from home, remote", *[None] * 8, "k9"]
    page = 'x {"520084652":' + json.dumps([*job[:28], "k9", [[1]], [2]]) + "}]]]]] y"
    r = board(spark, tmp_path, "google", page)[0]
    assert (r.id, r.title, r.company, r.location, r.job_url, str(r.date_posted), r.is_remote) == ("go-k9", "Dev", "Acme", "Pune, MH, India", "https://j.example/1", "2026-09-17", True)


def test_bdjobs_and_bayt_cards(spark, tmp_path):
    page = '<div class="norm-jobs-wrapper"><a href="jobdetails.asp?id=3&jobid=77&x=1">Clerk</a><div class="comp-name-text">B Ltd</div><div class="locon-text-d">Dhaka</div></div><div class="norm-jobs-wrapper">no link</div>'
    (r,) = board(spark, tmp_path, "bdjobs", page)
    assert (r.id, r.title, r.company, r.location, r.job_url) == ("bd-77", "Clerk", "B Ltd", "Dhaka", "https://jobs.bdjobs.com/jobdetails.asp?id=3&jobid=77&x=1")
    (r,) = board(spark, tmp_path, "bdjobs", '<p><a href="https://b/jobdetail?jobid=5">Only link</a></p>')
    assert (r.id, r.title) == ("bd-5", "Only link")
    (r,) = board(spark, tmp_path, "bayt", '<li data-js-job><h2>E</h2><a href="/en/j-12/">x</a></li>')
    assert (r.id, r.job_url) == ("ba-12", "https://www.bayt.com/en/j-12/")


def test_ziprecruiter(spark, tmp_path):
    job = {"listing_key": "z1", "name": "Dev", "hiring_company": {"name": "Acme"}, "job_city": "Austin", "job_state": "TX", "job_country": "US", "posted_time": "2026-09-01T10:00:00Z", "job_description": "<p>x</p>", "employment_type": "FULL_TIME", "compensation_interval": "annual", "compensation_min": 10.9, "compensation_max": 20, "compensation_currency": "USD"}
    (r,) = board(spark, tmp_path, "zip_recruiter", json.dumps({"jobs": [job]}))
    assert (r.id, r.title, r.company, r.location, str(r.date_posted), r.job_type, r.interval, r.min_amount, r.max_amount, r.currency) == ("zr-z1", "Dev", "Acme", "Austin, TX, USA", "2026-09-01", "fulltime", "yearly", 10.0, 20.0, "USD")


def test_batch_order_and_urls(spark):
    """Two new rows of one URL are one job: the first founds it, the second is its new version."""
    e = Engine(spark)
    url = "https://x.com/j/9"
    n = e.ingest(raw(spark, job(1, title="First", url=url), job(2, title="Second", url=url), job(3), job(3)), "2026-09-01").first()
    assert (n.received, n.inserted, n.updated, n.unchanged) == (4, 2, 1, 1)
    assert sorted(r.title for r in e.jobs.collect()) == ["RAG Engineer", "Second"] and e.snapshots.count() == 3
    n = e.ingest(raw(spark, job(1, title="Third", url="https://x.com/other")), "2026-09-02").first()
    assert (n.inserted, n.updated) == (0, 1) and e.jobs.count() == 2


def test_embedding_run(spark):
    """A failing batch ends the run of its task; a limit takes the first chunks in order; a manual run takes failed ones again."""
    from tarn.operators.filters import pending

    rows = [("j", i, "bad" if i == 2 else "good") for i in range(6)]
    extra = "embedding array<float>, embedding_model string, embedding_provider string, embedding_attempts int, embedding_failed_at timestamp, embedding_error string"
    chunks = spark.createDataFrame([(*r, None, None, None, 0, None, None) for r in rows], f"job_id string, chunk_index int, content string, {extra}").coalesce(1)

    def embed(texts):
        if "bad" in texts:
            raise ValueError("down")
        return [[1.0, 2.0]] * len(texts)

    now = F.lit("2026-09-01").cast("timestamp")
    for n in (1, 4):
        out = {r.chunk_index: r for r in state.embed_pending(chunks.repartition(n, "chunk_index"), embed, "m", "p", now, size=2).collect()}
        done = [out[i].embedding is not None for i in range(6)]
        first = next(i for i in range(6) if out[i].embedding_attempts)
        # all before the first failing batch, nothing of it or after it
        assert done == [i < first for i in range(6)] and out[first].embedding_error == "down" and out[2].embedding_attempts == 1
        assert all(out[i].embedding_attempts == 0 and out[i].embedding_error is None for i in range(4, 6))
    some = state.embed_pending(chunks, embed, "m", "p", now, limit=2)
    assert some.count() == 6 and some.where(~pending("m", "p")).count() == 2
    dims = state.embed_pending(chunks.where("content = 'good'"), embed, "m", "p", now, dims=3, size=2)
    assert dims.where("embedding is not null").count() == 0 and 1 <= dims.where("embedding_error is not null").count() <= 2
    nothing = state.embed_pending(chunks.limit(0), embed, "m", "p", now)
    assert nothing.count() == 0 and nothing.columns == chunks.columns
    failed = chunks.withColumn("embedding_attempts", F.when(F.col("chunk_index") == 1, 3).otherwise(0))
    again = state.embed_pending(failed, lambda texts: [[1.0]] * len(texts), "m", "p", now, manual=True)
    assert [r.chunk_index for r in again.where("embedding is not null").collect()] == [1]


def test_stored_index_is_repaired(engine, spark):
    """After any step a search gives what an index made anew over all chunks gives."""
    e = Engine(spark)
    e.ingest(raw(spark, job(1), job(2, "Java Developer", "Requirements\nJava, Docker", place="Berlin"), job(3, day="2026-06-01")), "2026-09-01")
    e.ingest(raw(spark, job(2, "Kotlin Developer", "Requirements\nKotlin and Docker. Docker", place="Berlin")), "2026-09-02")
    e.expire("2026-09-20")
    asked = ["kotlin", "docker", "java", "retrieval with python", "rag"]
    have = sorted((r.chunk_id, round(r.score, 9)) for r in e.keyword.search(asked).collect())
    assert len(e.keyword.segments) == 3
    e.reindex()
    assert len(e.keyword.segments) == 1 and have and have == sorted((r.chunk_id, round(r.score, 9)) for r in e.keyword.search(asked).collect())


def test_chinese_question_finds_a_phrase_before_a_full_stop(spark):
    e = Engine(spark)
    e.ingest(raw(spark, job(1, "ML Engineer", "Requirements\nWe use Python. We run machine learning."), job(2, "Other", "Requirements\nmachine for learning")), "2026-09-01")
    hits = {r.title: r.keyword_score for r in e.retrieve("这个岗位需要哪些机器学习技能？", mode="keyword").collect()}
    assert hits["ML Engineer"] is not None and hits["ML Engineer"] > hits.get("Other", 0.0)
    (best,) = e.keyword.search(["machine learning"]).collect()
    assert best.score > 0 and [r.chunk_id for r in e.keyword.search(["python"]).collect()] == [best.chunk_id]


def test_many_terms_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(30))) for i in range(40)] + [(99, None), (98, "")], "chunk_id int, text string")
    terms = spark.createDataFrame([(1, f"w{j}") for j in range(6)] + [(2, "w3"), (2, "none")], "query_id int, term string")
    one = sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in index.bm25(rows, {"text": 1.0}, terms).collect())
    monkeypatch.setattr(index, "FEW_WORDS", 2)
    assert one and one == sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in index.bm25(rows, {"text": 1.0}, terms).collect())


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    queries = vectors.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) + 0.0 if n else 0.0

    want = set()
    for q, v in rows[::10]:
        best = sorted(((-cosine(v, x), i) for i, x in rows if x is not None))[:7]
        want |= {(q, i, -s + 0.0, p) for p, (s, i) in enumerate(best, 1)}
    for block in (2048, 3):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        assert {(r.query_id, r.chunk_id, r.score, r.rank) for r in retrieval.nearest(vectors, queries, k=7).collect()} == want


def test_cache_and_log(spark):
    e = Engine(spark)
    e.ingest(raw(spark, job(1)), "2026-09-02")
    first = e.ask("Which jobs need Python?", now="2026-09-02 10:00:00")
    assert e.ask("Which jobs need Python?", now="2026-09-02 10:10:00").text == first.text
    assert e.ask("weather today", now="2026-09-02 10:11:00").intent == "refusal"
    assert e.ask("Which jobs need Python?", now="2026-09-02 10:30:00").text == first.text
    log = e.log.orderBy("created_at").collect()
    assert [(r.cache_hit, r.refused, r.status) for r in log] == [(False, False, "ok"), (True, False, "ok"), (False, True, "ok"), (True, False, "ok")]
    assert first.telemetry["source_count"] == log[0].source_count == 1 and log[0].retrieval_ms > 0 == log[1].retrieval_ms
    assert "query" not in e.log.columns and log[0].query_length == 23
    assert sorted(r.kind for r in e.cache.collect()) == ["answer", "ranked"] and e.operations("2026-09-03").first().total == 4
    called = []
    told = e.ask("Which jobs need Python?", generate=lambda q, c: called.append(1) or "Acme [1]", now="2026-09-02 10:40:00").telemetry
    assert called and not told["cache_hit"] and not told["retrieval_cache_hit"] and told["completion_tokens"] == 2  # ranked 15 minutes at most
    assert not e.ask("Which jobs need Python?", now="2026-09-02 11:05:00").telemetry["cache_hit"]  # answers an hour
    e.ingest(raw(spark, job(2, text="Requirements\nGo")), "2026-09-02")
    e.ask("Which jobs need Python?", now="2026-09-02 11:06:00")
    assert not e.log.orderBy(F.desc("created_at")).first().cache_hit  # another corpus, so another entry


def test_backfill(spark):
    e = Engine(spark)
    e.ingest(raw(spark, job(1), job(2, text=None), job(3, text=" "), job(4, text=None)), "2026-09-02")
    calls = []

    def fetch(number):
        calls.append(number)
        if number == "3" and calls.count("3") < 3:
            raise OSError("busy")
        return None if number == "4" else f"Requirements\nRust {number}"

    n = e.backfill(fetch, "2026-09-03").first()
    assert (n.received, n.updated, n.inserted) == (2, 2, 0) and calls.count("3") == 3
    assert sorted(r.source_job_id for r in e.jobs.where("description like '%Rust%'").collect()) == ["li-2", "li-3"]
    assert e.chunks.where("content like '%Rust%'").count() == 2


def test_files(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    line = lambda i: json.dumps({"id": i, "category": "skills", "query": "q"})
    path.write_text("# note\n\n" + line("a") + "\n" + line("b") + "\n")
    assert files.questions(spark, str(path), files.CATEGORIES).count() == 2
    path.write_text(line("a") + "\n" + line("a") + "\n")
    with pytest.raises(ValueError):
        files.questions(spark, str(path))
    path.write_text("# nothing\n")
    with pytest.raises(ValueError):
        files.questions(spark, str(path))
    notes = tmp_path / "a.json"
    notes.write_text(json.dumps({"q1": {"job_judgments": [{"job_id": "x", "relevance": 2}, {"job_id": "x", "relevance": 2}, {"job_id": "y", "relevance": 7}]}}))
    assert [tuple(r) for r in files.annotations(spark, str(notes)).collect()] == [("q1", "x", 2)]
    files.write_report(str(tmp_path / "r.json"), {"a": 1})
    assert files.read_report(str(tmp_path / "r.json")) == {"a": 1} and files.read_report(str(tmp_path / "no")) is None


def test_stream(spark, tmp_path, sf_dir):
    from tarn.streaming import flows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select("event_id", "ts", "event_type", "value").repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        stream = flows.read_files(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, event_type string, value double")
        flows.run_available(stream, lambda b, n: seen.append(b.count()), str(tmp_path / "ck")).awaitTermination(60)
    assert sum(seen) == events.count()


def test_empty(spark):
    e = Engine(spark)
    assert e.stats().first().coverage == 0.0
    assert e.ranked("anything") == [] and e.ask("which jobs?").intent == "refusal"
    assert ingest.counters(ingest.upsert(e.jobs, e.snapshots, ingest.canonical(raw(spark).limit(0)), F.current_timestamp())[2]).first().received == 0
