"""Operators over groups of texts, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import jaccard, linededup, suffix
from tarn.llm.components import components


def key(order):
    i = order[0]
    return (i is None, i if i is not None else 0, *order[1:])


def plain_lines(docs, min_words=5):
    """{(doc_id, place)} of lines that an earlier one within one word edit, or an equal one, drops."""
    lines = []
    for i, t in docs:
        for p, x in enumerate((t or "").split("\n")):
            w = x.lower().split()
            if w:
                lines.append((key((i, p)), i, p, w))
    lines.sort(key=lambda x: x[0])

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < min_words or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    return {(i, p) for k, (_, i, p, w) in enumerate(lines) if any(near(w, v) for _, _, _, v in lines[:k])}


def dropped(docs, **options):
    return {(r.doc_id, p) for r in linededup.report(docs, **options).collect() for p in r.gone}


def test_lines(spark, edge, empty):
    rng = random.Random(1)
    bank = ["".join(rng.choice("abc") for _ in range(2)) for _ in range(6)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13))
            w = [bank[j % 6] + str(j) for j in range(n)]
            for _ in range(rng.randint(0, min(2, n - 1))):
                kind, at = rng.randint(0, 2), rng.randrange(len(w))
                w = w[:at] + [[rng.choice(bank)], [], [w[at], rng.choice(bank)]][kind] + w[at + 1 :]
            lines.append(rng.choice((" ", "  ", "\t")).join(w))
        rows.append((i, "\n".join([*lines, ""])))
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    for least in (5, 1, 2, 8):
        assert dropped(docs, min_words=least) == plain_lines([*rows, (None, rows[0][1])], least)
    assert dropped(docs) == plain_lines([*rows, (None, rows[0][1])])
    out = linededup.report(edge)
    assert out.count() == edge.count() and linededup.report(empty).count() == 0
    repeated = [r.gone for r in out.where("doc_id = 5").collect()]
    assert repeated == [[1, 2], [1, 2]]  # equal rows are one document
    kept = linededup.dedup(edge)
    assert kept.columns == edge.columns and linededup.dedup(empty).count() == 0
    assert [r.text for r in kept.where("doc_id = 5").collect()] == ["same line of eight words stands here twice\n"] * 2


def test_short_lines(spark):
    rows = [(1, "Terms of use apply here\nTotal: 5"), (2, "Terms of service apply here\nTotal: 6"), (3, "Terms of use apply\none two three four five six"), (4, "one two three five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert dropped(docs) == {(2, 0), (4, 0)} == plain_lines(rows)
    assert dropped(docs, min_words=1) == plain_lines(rows, 1) == {(2, 0), (2, 1), (3, 0), (4, 0)}


def test_lines_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()][:60]
    assert dropped(spark.createDataFrame(rows, "doc_id long, text string")) == plain_lines(rows)


def plain_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    inv, up = defaultdict(list), {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, own in sets.items():
        shared = defaultdict(int)
        for s in own:
            for j in inv[s]:
                shared[j] += 1
            inv[s].append(i)
        for j, c in shared.items():
            if 100 * c >= 80 * (len(own) + len(sets[j]) - c):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(rng, groups, copies, size, edits):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, monkeypatch, small):
    if small:  # so that regions are divided by pivots, over several rounds, and blocks meet
        for name, value in {"LEAF": 6, "BLOCK": 4, "PIVOTS": 3}.items():
            monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(2)
    rows = near_copies(rng, 6, 40, 90, 5)
    rows += [(1000 + i, " ".join(f"x{rng.randint(0, 5)}" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(docs).collect()}
    assert got == plain_components(rows)


def chained(rng, chains, size, steps):
    """Texts of which each differs from the next by so little that they link, and from all others by more."""
    rows = []
    for _ in range(chains):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        for _ in range(steps):
            rows.append((len(rows), " ".join(w)))
            for _ in range(2):
                w[rng.randrange(size)] = f"v{rng.randint(0, 10**6)}"
    return rows


def test_jaccard_regions_decide(spark, monkeypatch):
    """Chains link through classes that are no pivots, so without the join of regions components fall apart."""
    rows = chained(random.Random(12), 12, 100, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(docs).collect()} == want
    monkeypatch.setattr(jaccard, "_candidates", lambda cells, some, wanted: spark.createDataFrame([], "cell long, a long, b long"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(docs).collect()} != want


def test_jaccard_family_without_links(spark, monkeypatch):
    """Many texts near one base that hardly link with each other."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        w = list(base)
        for at in rng.sample(range(24), 5):
            w[5 * at] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "LEAF", 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(docs).collect()}
    assert got == plain_components(rows)


def test_jaccard_rows_of_a_family(spark, monkeypatch):
    """A large family of near copies, of which many link with none, stands in no more rows of cells than it has texts."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(27), rng.randint(0, 7)):
            w[5 * at] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    for name, value in {"LEAF": 64, "BLOCK": 32, "PIVOTS": 4}.items():
        monkeypatch.setattr(jaccard, name, value)
    held, plain = [], jaccard._candidates

    def counted(cells, some, wanted):
        held.append(cells.count())
        return plain(cells, some, wanted)

    monkeypatch.setattr(jaccard, "_candidates", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(docs).collect()} == plain_components(rows)
    assert held[0] <= len(rows), held


def test_jaccard_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(docs).collect()}
    assert got == plain_components([tuple(r) for r in docs.collect()])


def test_jaccard_edges(spark, edge, empty):
    out = jaccard.report(edge)
    assert out.count() == edge.count() and jaccard.report(empty).count() == 0
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (8, 5, 8), (None, 5, 8)} <= got
    kept = jaccard.representatives(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8]


def test_cell_join_is_exact():
    rng = random.Random(3)
    rows = near_copies(rng, 3, 60, 60, 6)
    sets = [jaccard.shingles(t, jaccard._Hashes()) for _, t in rows]
    sizes, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    found = {(i, j) for i, j, _ in jaccard.join_cell([jaccard.sketch(s) for s in sets], sizes, label, np.ones(len(sets), bool))}
    for i in range(len(sets)):
        for j in range(i):
            both, union = jaccard.distance(sets[i], sets[j])
            if 100 * both >= 80 * union:
                assert (i, j) in found or (j, i) in found


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 420)]
    up = {x: x for p in pairs for x in p}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def plain_removal(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = hashlib.blake2b(data[p : p + 100], digest_size=16).digest()
            if s in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for j in range(len(data)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("split, hot", [(2000, 1000), (3, 1000), (2000, 3)])
def test_suffix(spark, monkeypatch, split, hot):
    monkeypatch.setattr(suffix, "SPLIT", split)
    monkeypatch.setattr(suffix, "HOT_FROM", hot)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(200):
        parts = [x[(a := rng.randint(0, 300)) : a + rng.randint(0, 250)] + rng.choice(["", "!", "é", "z" * rng.randint(0, 300)]) for x in rng.sample(base, rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(301, None), (302, ""), (303, "!" * 3000), (304, "ab" * 1500), (305, "abc" * 500 + "x" + "abc" * 400), (306, base[0][:99])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(docs).collect()}
    assert got == plain_removal(rows)


def test_suffix_rows_without_an_id_of_their_own(spark):
    """Each row stands for itself: a repeat costs bytes only of the row it stands in."""
    rng = random.Random(9)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 300, 250))
    docs = spark.createDataFrame([(1, a), (None, a), (None, b), (7, a), (7, c)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.report(docs).collect())
    assert got == [(0, 300, 0), (0, 300, 300), (1, 300, 0), (7, 250, 0), (7, 300, 300)]


def test_suffix_repeated_ids(spark):
    """Rows that share an id, or have none, come in the order of their texts' hashes; equal rows are one document."""
    rng = random.Random(10)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    rows = []
    for _ in range(80):
        text = "".join(x[(s := rng.randint(0, 200)) : s + rng.randint(50, 250)] for x in rng.sample(base, rng.randint(1, 3)))
        rows.append((rng.choice((None, 1, 2, 3, (1 << 63) - 1)), text))
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    place = {x: ((1 << 63) - 1 if x[0] is None else x[0], order[x[1]]) for x in rows}
    want = plain_removal([(place[x], x[1]) for x in set(rows)])
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(docs).collect())
    assert got == sorted((x[0] or 0, *want[place[x]]) for x in rows)


def test_suffix_needs_the_sort(spark, monkeypatch):
    """Strings in different contexts are found by the sorted order alone."""
    rng = random.Random(11)
    shared = "".join(rng.choice("abcd") for _ in range(160))
    rows = [(i, "".join(rng.choice("efgh") for _ in range(150)) + shared + "".join(rng.choice("efgh") for _ in range(150))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(docs).collect()}
    assert found() == plain_removal(rows)
    monkeypatch.setattr(suffix, "_common", lambda strings: (np.arange(len(strings)), np.zeros(len(strings), np.int64)))
    assert found() != plain_removal(rows)


def test_suffix_takes_an_anchor_of_many_texts_once(spark, monkeypatch):
    """A context goes to one sort, however many contexts its anchor has, and pairs of them are not formed."""
    rng = random.Random(12)
    shared = "".join(rng.choice("abcd") for _ in range(90))
    texts = ["".join(rng.choice("efgh") for _ in range(120)) for _ in range(40)]
    rows = [(i, rng.choice(texts)[rng.randint(0, 9) :] + shared + "".join(rng.choice("efgh") for _ in range(120))) for i in range(3000)]
    monkeypatch.setattr(suffix, "HOT_FROM", 1 << 40)
    seen, compare = [], suffix._compare_all

    def counted(contexts, buckets):
        seen.append(contexts.groupBy("anchor", "doc", "ver", "first").count().agg(F.max("count"), F.count("*")).first())
        return compare(contexts, buckets)

    monkeypatch.setattr(suffix, "_compare_all", counted)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removal(rows)
    assert seen[0][0] == 1 and seen[0][1] > 3000


def test_suffix_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 512)
    rng = random.Random(6)
    shared = "".join(rng.choice("abcd") for _ in range(1500))
    rows = [(i, "".join(rng.choice("efgh") for _ in range(rng.randint(0, 900))) + shared[rng.randint(0, 300) :]) for i in range(12)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removal(rows)


def test_suffix_edges(spark, sf_dir, edge, empty):
    out = suffix.dedup(edge)
    assert out.count() == edge.count() and suffix.dedup(empty).count() == 0
    assert {r.n_removed for r in out.where("doc_id = 6").collect()} == {4999}  # all but the first byte of 5,000 equal ones
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(docs).collect()}
    assert got == plain_removal([tuple(r) for r in docs.collect()])


def test_deep_shallow():
    rng = random.Random(7)
    for _ in range(60):
        xs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 60))]
        order = suffix.deep_shallow(xs, rng.choice((0, 2, 16)))
        assert [xs[i] for i in order] == sorted(xs) and sorted(order) == list(range(len(xs)))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from tarn.llm.common import keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = keep(stage(spark, docs, sf_dir))
        after = {r.doc_id: r["text"] for r in docs.collect()} if n < 5 else {}
        assert n == 5 or docs.columns == columns
        if name == "line_dedup":
            gone = plain_lines(list(before.items()))
            left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in before.items()}
            assert after == {i: t for i, t in left.items() if t.strip() or t == before[i]}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "jaccard_join":
            assert set(after) == {c for _, c in plain_components(list(before.items())).values()}
        elif name == "decontamination":
            assert not any(b in t for t in after.values() for b in bench if len(b.split()) >= 12) and len(after) >= 0.9 * len(before)
        elif name == "language_id":
            assert len(after) >= 0.99 * len(before)
        else:
            assert docs.count() == len(before)
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
    assert len(corpus_pipeline.STAGES) == 5 and F is not None
