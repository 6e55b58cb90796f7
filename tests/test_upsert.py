"""The upsert of a batch against a model that takes one record after the other."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import groups, ingest

FIELDS = "site string, id string, job_url string, description string, arrival long"


def day(n):
    return F.lit(f"2026-09-0{n}").cast("timestamp")


def stored(spark, rows):
    """(jobs, snapshots) of rows (site, id, url, description, is_active)."""
    base = ingest.canonical(spark.createDataFrame([(s, i, u, d, n, a) for n, (s, i, u, d, a) in enumerate(rows)], FIELDS + ", is_active boolean"))
    active = spark.createDataFrame([(n, r[4]) for n, r in enumerate(rows)], "arrival long, is_active boolean")
    jobs = base.join(active, "arrival").select(F.substring("fingerprint", 1, 32).alias("job_id"), *[c for c in base.columns if c != "arrival"], F.lit(0).cast("long").alias("arrival"), day(1).alias("first_seen_at"), day(1).alias("last_seen_at"), "is_active")
    return jobs, jobs.select("job_id", "content_hash", "description", day(1).alias("created_at"))


def model(old, batch):
    """(jobs, changes): id -> [id, url, description, active, founder] by source; what each row did."""
    jobs, changes = {}, []
    for s, i, u, d, a in old:
        jobs[s, i] = {"id": i, "url": u, "text": d, "active": a}
    for s, i, u, d, _ in sorted(batch, key=lambda r: r[4]):
        key = (s, i) if (s, i) in jobs else None
        if key is None and u:
            holders = [k for k, j in jobs.items() if k[0] == s and j["url"] == u]
            key = min(holders, key=print_of) if holders else None
        if key is None:
            jobs[s, i] = {"id": i, "url": u, "text": d, "active": True}
            changes.append(("inserted", False))
            continue
        job = jobs[key]
        changed = job["text"] != d
        changes.append(("updated" if changed else "unchanged", not job["active"]))
        job["active"] = True
        if changed:
            job.update(id=i, url=u, text=d)
    return jobs, changes


def print_of(key):
    import hashlib

    return hashlib.sha256(f"{key[0]}:id:{key[1]}".encode()).hexdigest()[:32]


def outcome(spark, old, batch):
    jobs, snapshots = stored(spark, old)
    new, history, changes = ingest.upsert(jobs, snapshots, ingest.canonical(spark.createDataFrame(batch, FIELDS)), day(2))
    rows = {r.job_id: (r.source, r.source_job_id, r.job_url, r.description, r.is_active) for r in new.collect()}
    seen = {(r.job_id, r.description) for r in history.collect()}
    return rows, seen, sorted((r.change, r.reactivated) for r in changes.collect()), {r.job_id: r.last_seen_at.day for r in new.collect()}


def test_a_row_keeps_the_identity_of_its_batch(spark):
    # a stored job at u2; x comes at u1 and then at u2: x is a job of its own, and j stays
    rows, _, changes, _ = outcome(spark, [("s", "j", "http://e.com/u2", "old", True)], [("s", "x", "http://e.com/u1", "one", 0), ("s", "x", "http://e.com/u2", "two", 1)])
    assert changes == [("inserted", False), ("updated", False)]
    assert sorted(r[1:4] for r in rows.values()) == [("j", "http://e.com/u2", "old"), ("x", "http://e.com/u2", "two")]


def test_a_job_that_moves_leaves_its_url(spark):
    rows, _, changes, _ = outcome(spark, [("s", "j", "http://e.com/u0", "old", True)], [("s", "j", "http://e.com/u1", "one", 0), ("s", "c", "http://e.com/u0", "two", 1)])
    assert changes == [("inserted", False), ("updated", False)]
    assert sorted(r[1:4] for r in rows.values()) == [("c", "http://e.com/u0", "two"), ("j", "http://e.com/u1", "one")]


def test_random_batches(spark):
    """2,000 batches side by side, each on a board of its own."""
    rng = random.Random(11)
    old, batch = [], []
    for b in range(2000):
        ids, urls = "abcd"[: rng.randrange(2, 5)], ["", *[f"http://e.com/{b}/{u}" for u in range(rng.randrange(1, 4))]]
        for i in ids:
            if rng.random() < 0.4:
                old.append((f"s{b}", i, rng.choice(urls), rng.choice("pq"), rng.random() < 0.7))
        batch += [(f"s{b}", rng.choice(ids), rng.choice(urls), rng.choice("pqr"), n) for n in range(rng.randrange(1, 9))]
    rng.shuffle(batch)
    want, want_changes = model(old, batch)
    rows, seen, changes, days = outcome(spark, old, batch)
    assert changes == sorted(want_changes)
    assert rows == {print_of(k): (k[0], j["id"], j["url"], j["text"], j["active"]) for k, j in want.items()}
    assert {(i, r[3]) for i, r in rows.items()} <= seen
    touched = {s for s, *_ in batch}
    assert all(d == 1 for i, d in days.items() if rows[i][0] not in touched)


def test_repeated_rows_and_no_rows(spark):
    same = [("s", "a", "http://e.com/1", "t", 5)] * 3 + [("s", "a", "http://e.com/1", None, 6)]
    rows, seen, changes, days = outcome(spark, [], same)
    assert changes == [("inserted", False), ("unchanged", False), ("unchanged", False), ("updated", False)] and len(rows) == 1 and len(seen) == 2
    rows, seen, changes, days = outcome(spark, [("s", "a", "http://e.com/1", "t", False)], [])
    assert changes == [] and list(days.values()) == [1] and not list(rows.values())[0][4]


def test_one_url_of_very_many_rows(spark):
    n = 20_000
    batch = ingest.canonical(spark.range(n).select(F.lit("s").alias("site"), F.col("id").cast("string").alias("id"), F.lit("http://e.com/x").alias("job_url"), F.concat(F.lit("t"), (F.col("id") / 2).cast("int")).alias("description"), F.col("id").alias("arrival")))
    jobs, snapshots = stored(spark, [("s", "other", "http://e.com/y", "t", True)])
    new, _, changes = ingest.upsert(jobs, snapshots, batch, day(2))
    got = ingest.counters(changes).first()
    assert (got.received, got.inserted, got.updated, got.unchanged) == (n, 1, n // 2 - 1, n // 2)
    assert sorted((r.source_job_id, r.description) for r in new.collect()) == [("19998", "t9999"), ("other", "t")]


@pytest.mark.parametrize("shape", ["chain", "star", "pairs", "none"])
def test_components(spark, shape):
    n = 300
    links = {"chain": [(f"{i:04d}", f"v{j}") for i in range(n) for j in (i, i + 1)], "star": [(f"{i:04d}", "v") for i in range(n)], "pairs": [(f"{i:04d}", f"v{i // 2}") for i in range(n)], "none": []}[shape]
    random.Random(1).shuffle(links)
    got = {r.n: r.component for r in groups.components(spark.createDataFrame([*links, (None, "v1"), ("lone", None)], "n string, v string"), "n", "v").collect()}
    of = {"chain": lambda i: 0, "star": lambda i: 0, "pairs": lambda i: i - i % 2, "none": None}[shape]
    assert got == {k: f"{of(int(k)):04d}" for k, _ in links}


def test_only_linked_values_take_part_in_the_rounds(spark, monkeypatch):
    """Two nodes of two values each link four values; the star and the rows without a value take no part."""
    rows = [("a", "u"), ("a", "v"), ("b", "v"), ("c", "w"), ("c", "x"), ("c", None), ("d", None), *[(f"s{i}", "star") for i in range(50)], ("d", None), ("c", "w")]
    kept, keep = [], groups.keep
    monkeypatch.setattr(groups, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    got = groups.grouped(spark.createDataFrame(rows, "n string, v string"), "n", "v").collect()
    assert sorted((r.n, r.v or "") for r in got) == sorted((n, v or "") for n, v in rows)
    of = {}
    for r in got:
        of.setdefault(r.component, set()).add(r.n)
    assert sorted(map(sorted, of.values())) == [["a", "b"], ["c"], ["d"], sorted(f"s{i}" for i in range(50))]
    assert max(df.count() for df in kept) == 4


def test_packed_texts_come_back(spark):
    texts = ["ab" * 32, "AB" * 32, "ab" * 31, "", "é" * 40, "0" * 64 + "\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(ingest.packed("x"))
    assert sorted(len(r.x) for r in df.collect() if r.x is not None) == [1, 33, 63, 65, 66, 81]
    assert sorted(map(str, (r.x for r in df.select(ingest.unpacked("x")).collect()))) == sorted(map(str, texts))
