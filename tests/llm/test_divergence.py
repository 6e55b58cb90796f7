"""The source divergence audit against integers of Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import divergence
from tarn.llm.queries import op12_source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least):
    """(lang, source, part, item) -> (value, rank) for rows (text, lang, source)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOW))
        count[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = {}
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        v = len(kept)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 50)):
                for rank, (value, item) in enumerate(sorted(found)[:top], 1):
                    out[lang, s, part, item.decode()] = (-value, rank)
    return out


def result(df):
    rows = df.collect()
    out = {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(params=[(1 << 20, 256, 400_000), (64, 2, 20)], ids=["one tile", "many tiles"])
def tiles(request, monkeypatch):
    for name, value in zip(("CELLS", "STRIP", "ENTRIES"), request.param):
        monkeypatch.setattr(divergence, name, value)


def test_documents(spark, sf_dir, tiles, monkeypatch):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(op12_source_divergence(spark, sf_dir)) == plain(rows, 30)


def test_special_rows(spark, tiles, monkeypatch):
    monkeypatch.setattr(divergence, "MIN_DOCS", 2)
    rows = [(f"tie{i} tie{i} É é ABC-abc z\u00e9ro1x \u0085\u00a0 日本" + " pad" * (i % 3), lang, f"s{i % 4}") for i in range(24) for lang in ("aa", "bb")]
    rows += [(None, "aa", "no text"), ("", "aa", None), (None, None, None), ("only once", "cc", "x"), ("twice no more", "cc", "y"), ("1 2 3", "dd", "x"), ("w " * 100_000, "aa", "s1"), ("tie1 tie1", "aa", "s1"), ("tie1 tie1", "aa", "s1")]
    name = lambda i: "t" + "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    rows += [(f"{name(i)} " * (i % 7 + 1) + name(i + 1), "ee", "big" if i % 3 else "small") for i in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    want = plain(rows, 2)
    assert result(divergence.audit(df)) == want
    assert max(r for (_, _, part, _), (_, r) in want.items() if part == "term") == 50
    assert ("cc", "x", "pair", "y") in want and want["cc", "x", "pair", "y"] == (0, 1)
    more = df.withColumns({c: F.lit("z") for c in ("term", "n", "d", "block", "strip", "total", "kept", "first", "value", "item", "part", "rank", "doc_id")})
    assert result(divergence.audit(more)) == want


def test_many_languages_are_joined(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LANGS", 1)
    monkeypatch.setattr(divergence, "MIN_DOCS", 1)
    rows = [(f"a b{i} c", f"l{i % 5}", f"s{i % 3}") for i in range(40)]
    assert result(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))) == plain(rows, 1)


def test_edges(edge, empty):
    assert divergence.audit(empty).count() == 0
    assert divergence.audit(edge).count() == 0  # one source, so no pair, and no term in 30 documents


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9_000_000_000_000_000, 2000)
    n = (rng.random(2000) * total).astype(np.int64)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]
    assert divergence.shares(total, total).tolist() == [10**9 + 1] * 2000
