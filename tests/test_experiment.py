"""The reranker experiment against plain Python, and without grades."""

import random

from tarn.operators import evaluation, experiment

SCORED, PLACES, GRADES, SPLITS = "query_id string, job_id string, chunk_id int, score double", "query_id string, item string, place int", "query_id string, item string, grade int", "split string, query_id string"


def level(score, t):
    return 0 if score < t[0] else 1 if score < t[1] else 2


def f1(pairs):
    total = 0.0
    for v in (0, 1, 2):
        tp = sum(a == v == p for a, p in pairs)
        wrong = sum((a == v) != (p == v) for a, p in pairs)
        total += 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0
    return total / 3


def test_experiment(spark):
    rng = random.Random(8)
    scored, places, grades, splits = [], [], [], []
    for q in (f"q{i}" for i in range(9)):
        splits.append((rng.choice(("development", "test", "refusal")), q))
        jobs = [f"j{i}" for i in range(12)]
        places += [(q, j, n) for n, j in enumerate(rng.sample(jobs, 9), 1)]
        scored += [(q, j, 10 * n + c, rng.randint(0, 20) / 20) for n, j in enumerate(rng.sample(jobs, 8)) for c in range(rng.randint(1, 3))]
        grades += [(q, j, 0 if q == "q8" else rng.randint(0, 2)) for j in rng.sample(jobs, 6)]
    scored.append(("q0", "j0", 99, None))
    done = experiment.run(spark.createDataFrame(scored, SCORED), spark.createDataFrame(places, PLACES), spark.createDataFrame(grades, GRADES), spark.createDataFrame(splits, SPLITS))

    grade = {(q, j): g for q, j, g in grades}
    part = {q: s for s, q in splits if s != "refusal" and any(g for (x, _), g in grade.items() if x == q)}
    best = {}
    for q, j, c, s in scored:
        if s is not None and q in part and (s, -c) > best.get((q, j), (-1, 0)):
            best[q, j] = (s, -c)
    samples = {k: (v[0], grade[k]) for k, v in best.items() if k in grade}
    values = sorted({s for s, _ in samples.values()})
    points = sorted({values[min(len(values) - 1, i * (len(values) - 1) // 12)] for i in range(13)})
    t = max(((low, high) for low in points for high in points if low < high), key=lambda t: (round(f1([(a, level(s, t)) for s, a in samples.values()]), 4), -t[0], -t[1]))
    assert tuple(done.thresholds.first())[:2] == t
    assert {(r.query_id, r.job_id, r.chunk_id, r.predicted, r.actual) for r in done.queue.collect()} == {(*k, -best[k][1], level(s, t), a) for k, (s, a) in samples.items() if level(s, t) != a}
    for r in done.coverage.collect():
        shares = []
        for q in (q for q, s in part.items() if s == r.split):
            good = [j for (x, j), g in grade.items() if x == q and g]
            shares.append(sum((q, j) in best for j in good) / len(good))
        assert abs(r.coverage - sum(shares) / len(shares)) < 1e-4
    ranks = {"baseline": {(q, j): n for q, j, n in places}, "reranked": {}}
    for q in part:
        order = sorted((j for x, j in best if x == q), key=lambda j: (-best[q, j][0], j))
        ranks["reranked"] |= {(q, j): n for n, j in enumerate(order, 1)}
    got = {(r.split, r.ranking): r for r in done.summary.collect()}
    assert set(got) == {(s, n) for s in set(part.values()) for n in ranks}
    for (split, name), r in got.items():
        queries = [q for q, s in part.items() if s == split]
        good = {q: [j for (x, j), g in grade.items() if x == q and g] for q in queries}
        mean = lambda f: sum(map(f, queries)) / len(queries)
        assert r.questions == len(queries)
        for k, value in ((5, r.recall_at_5), (8, r.recall)):
            assert abs(value - mean(lambda q: sum(ranks[name].get((q, j), 99) <= k for j in good[q]) / len(good[q]))) < 1e-4
        first = lambda q: min((ranks[name].get((q, j), 99) for j in good[q]), default=99)
        assert abs(r.mrr - mean(lambda q: 1 / first(q) if first(q) <= 8 else 0.0)) < 1e-4


def test_without_labels(spark):
    empty = [spark.createDataFrame([], s) for s in (SCORED, PLACES, GRADES, SPLITS)]
    done = experiment.run(*empty)
    assert [df.count() for df in (done.summary, done.coverage, done.thresholds, done.agreement, done.queue)] == [0] * 5
    # one grade alone teaches no thresholds
    one = experiment.run(spark.createDataFrame([("q", "a", 1, 0.5), ("q", "b", 2, 0.7)], SCORED), empty[1], spark.createDataFrame([("q", "a", 2), ("q", "b", 2)], GRADES), spark.createDataFrame([("test", "q")], SPLITS))
    assert one.thresholds.count() == 0 and one.queue.count() == 0 and one.coverage.first().coverage == 1.0


def test_tuning_sees_one_split(spark):
    lists = "query_id string, chunk_id string, job_id string, score double, rank int"
    found = spark.createDataFrame([(f"q{q}", f"c{j}", f"j{j}", 1.0, j + 1) for q in range(8) for j in range(4)], lists)
    # the development questions want the first job, those of the test split another
    grades = spark.createDataFrame([(f"q{q}", "j0" if q < 5 else "j3", 2) for q in range(8)], GRADES)
    splits = lambda n: spark.createDataFrame([("development" if q < n else "test", f"q{q}") for q in range(8)], SPLITS)
    best = evaluation.tune_split(found, found, grades, splits(5)).first()
    assert (best.recall, best.rr, best.graded_ndcg) == (1.0, 1.0, 1.0)
    assert evaluation.tune_split(found, found, grades, splits(4)).count() == 0
