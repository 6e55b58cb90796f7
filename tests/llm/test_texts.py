"""Operators that judge each text by itself, against plain versions."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarn.llm import bpe, decontaminate, langid, lattice, licence, quality, toxicity
from tarn.llm.queries import op2_subword_lattice

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    for c in WS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_measures(text):
    text = text or ""
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    rep = {i + j for i, t in enumerate(tri) if n[t] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def test_quality(spark, sf_dir, edge, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    book = quality.report(docs).collect()
    assert len(book) == len(texts)
    for r in book:
        want = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.report(edge).count() == edge.count() and quality.report(empty).count() == 0


def test_ablation(spark, edge, empty):
    book = quality.ledger(edge).persist()
    mask, _ = quality.POLICIES["v1"]
    rows = [r.fail_bits & mask for r in book.collect()]
    for a, rule in zip(quality.ablation(book, "v1").collect(), quality.rules()):
        own = 1 << rule.bit
        assert (a.rule, a.n_failed, a.n_only, a.n_kept_without) == (rule.name, sum(b & own > 0 for b in rows), sum(b == own for b in rows), sum(b & ~own == 0 for b in rows))
    assert {r.n_failed for r in quality.ablation(quality.ledger(empty), "v1").collect()} == {0}
    assert quality.profile(book, "doc_id").count() == 9


SMALL_PIECES = [(p, math.log(x)) for p, x in (("▁", 0.1), ("a", 0.2), ("b", 0.1), ("ab", 0.25), ("▁a", 0.15), ("bab", 0.2))]


def plain_marginal(s, score, byte_scores, uses=None, weight=1.0):
    """Probability of s by every segmentation; uses, if given, takes each path's pieces and bytes with its probability."""
    total = 0.0

    def go(at, p, path):
        nonlocal total
        if at == len(s):
            total += p
            if uses is not None:
                uses.append((p, path))
            return
        for n in range(1, len(s) - at + 1):
            if s[at : at + n] in score:
                go(at + n, p * math.exp(score[s[at : at + n]]), [*path, s[at : at + n]])
        if s[at] not in score:
            b = list(s[at].encode())
            go(at + 1, p * math.exp(sum(byte_scores[x] for x in b)), [*path, *b])

    go(0, 1.0, [])
    return total


@pytest.mark.parametrize("part", [4096, 3])
def test_lattice_sums_over_segmentations(monkeypatch, part):
    monkeypatch.setattr(lattice, "PART", part)
    pieces, byte_scores = lattice.with_bytes(SMALL_PIECES)
    assert sum(math.exp(x) for _, x in pieces) + sum(map(math.exp, byte_scores)) == pytest.approx(1)
    score, names = dict(pieces), [p for p, _ in pieces]
    model = lattice.Lattice(pieces, byte_scores)
    for w in ("ab", "abab", "babab", "a", "xay", "", "é", "abababababab"):
        paths = []
        total = plain_marginal("▁" + w, score, byte_scores, paths)
        assert model.log10(w) == pytest.approx(math.log10(total))
        counts, byte_counts = np.zeros(len(pieces)), np.zeros(256)
        model.expect("▁" + w, 2.0, counts, byte_counts)
        want, want_bytes = np.zeros(len(pieces)), np.zeros(256)
        for p, path in paths:
            for x in path:
                if isinstance(x, int):
                    want_bytes[x] += 2 * p / total
                else:
                    want[names.index(x)] += 2 * p / total
        assert counts == pytest.approx(want) and byte_counts == pytest.approx(want_bytes)


@pytest.mark.parametrize("frequent", [((0, 64, 100), (65, 8192, 10)), ((0, 64, 2),)])
def test_lattice_scores_are_marginals_after_one_step(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    rng = random.Random(6)
    bank = ["ab", "bab", "abab", "é", "a", "bb", "xab"]
    rows = [(i, " ".join(rng.choice(bank) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    got = {r.doc_id: r.score for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), SMALL_PIECES).collect()}
    pieces, byte_scores = lattice.with_bytes(SMALL_PIECES)
    score = dict(pieces)
    uses, ends = Counter(), 0
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            ends += 1
            for w in text.split():
                paths = []
                total = plain_marginal("▁" + w, score, byte_scores, paths)
                for p, path in paths:
                    for x in path:
                        uses[x] += p / total
    kinds = [*score, *range(256)]
    total = sum(uses.values()) + lattice.SMOOTH * len(kinds) + ends + lattice.SMOOTH
    new = {k: math.log((uses[k] + lattice.SMOOTH) / total) for k in kinds}
    end = math.log10((ends + lattice.SMOOTH) / total)
    for i, text in rows:
        want = end + sum(math.log10(plain_marginal("▁" + w, {k: v for k, v in new.items() if isinstance(k, str)}, new)) for w in text.split())
        assert got[i] == pytest.approx(want)


def test_base_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = {d.doc_id: [w.lower() for w in words(d.text or "")] + [None] for d in docs}
    low = lambda w: None if w is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    toks = {d.doc_id: [low(w) for w in words(d.text or "")] + [None] for d in docs}
    c = Counter(w for i, t in toks.items() if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    rows = op2_subword_lattice(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0


def test_lattice_edges(spark, edge, empty, monkeypatch):
    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(lattice, "FREQUENT", ((0, 64, 3),))  # so that most words go through the join
    rows = lattice.score(edge, pieces).collect()
    assert len(rows) == edge.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lattice.score(empty, pieces).count() == 0


def test_bpe_equals_merges(spark, sf_dir, edge, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    raw = bpe.read_ranks(path)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(edge.select("doc_id", "text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for d in docs.collect():
        ids = enc.encode_ordinary(d.text or "")
        want[d.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((d.text or "").encode())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, raw, public_tokenizers.PATTERN).collect()) == want
    assert bpe.round_trip(empty, raw, public_tokenizers.PATTERN).count() == 0
    tokens = bpe.encode(edge, raw, public_tokenizers.PATTERN)
    assert Counter(r.text for r in bpe.decode(tokens, raw).collect()) == Counter(d.text or "" for d in edge.collect())


def test_bpe_random():
    import tiktoken

    raw = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    model, rng = bpe.Bpe(raw), random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice(["a", "b", "!", "!!", "th", "e", "  ", "é", "日", "ing", "0", "ß", " "]) for _ in range(rng.randint(1, 25)))
        assert model.encode(s.encode()) == enc.encode_ordinary(s), s


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")
    w = [x for x in w if x]
    at = [(i, label) for p, label in licence.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licences(spark, sf_dir, edge, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(edge.select(F.col("doc_id") + 800_000, "text"))
    more = spark.createDataFrame([(900_001, "CC BY cc by. The MIT License; apache license"), (900_002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction")], "doc_id long, text string")
    docs = docs.union(more)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licence.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert next(r.labels for r in rows if r.doc_id == 900_002) == "mit"
    assert licence.scan(empty).count() == 0


def test_suffix_automaton():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randint(0, 3) for _ in range(rng.randint(1, 30))] for _ in range(4)]
        a = licence.SuffixAutomaton(texts)
        stream = [rng.randint(0, 4) for _ in range(60)]
        runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for e, (length, state) in enumerate(a.statistics(stream), 1):
            want = next((n for n in range(e, 0, -1) if tuple(stream[e - n : e]) in runs), 0)
            assert length == want
            if length >= licence.MIN_RUN:
                assert a.at[state] == {(k, i + length - 1) for k, t in enumerate(texts) for i in range(len(t)) if t[i : i + length] == stream[e - length : e]}


def plain_cover(places):
    """The most tokens that a chain of (end, start, last) covers, by trying every chain."""
    best = 0

    def go(m, covered):
        nonlocal best
        best = max(best, covered)
        end_, start_, last_ = places[m]
        for n in range(m + 1, len(places)):
            end, start, last = places[n]
            first = last - (end - start)
            if start - end_ - 1 <= licence.MAX_GAP and end_ < end and start_ < start and last_ < last and last_ - (end_ - start_) < first:
                go(n, covered + min(end - max(start - 1, end_), last - max(first - 1, last_)))

    for m, (end, start, _) in enumerate(places):
        go(m, end - start + 1)
    return best


def test_chains_are_the_best(monkeypatch):
    monkeypatch.setattr(licence, "MIN_RUN", 2)
    rng = random.Random(14)
    for _ in range(40):
        body = [f"t{rng.randint(0, 6)}" for _ in range(25)]
        scanner = licence.Scanner([("x", " ".join(body))], {})
        text = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(24)
            text += body[a : a + rng.randint(2, 8)] + ["zz"] * rng.choice((0, 1, 13))
        tokens = np.array([scanner.ids.get(w.encode(), -1) for w in text])
        places = sorted((end, end - n + 1, last) for end, n, state in scanner.matches(tokens) for _, last in scanner.automaton.at[state])
        got = scanner.chains(tokens)
        assert max((c[1] for c in got), default=0) == plain_cover(places)
        spans = sorted((c[2], c[3]) for c in got)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_a_stray_match_breaks_no_chain():
    scanner = licence.Scanner(licence.TEMPLATES, licence.BASE)
    mit = next(t for label, t in licence.TEMPLATES if label == "mit")
    w = mit.split()
    stray = w[:20] + w[2:7] + w[20:]
    for text in (mit, " ".join(stray)):
        _, _, _, _, _, labels, score, _ = scanner.scan(text)
        assert labels == "mit" and score > 0.9


def test_edited_licences_are_found():
    """Of whole templates with a tenth of their words changed at least nine tenths keep their label."""
    rng = random.Random(15)
    scanner = licence.Scanner(licence.TEMPLATES, licence.BASE)
    long = [(label, text.split()) for label, text in licence.TEMPLATES if len(text.split()) >= 24]
    found = 0
    for k in range(200):
        label, w = long[k % len(long)]
        w = [f"v{rng.randint(0, 9)}" if rng.random() < 0.1 else x for x in w]
        junk = [f"q{rng.randint(0, 99)}" for _ in range(60)]
        found += label in scanner.scan(" ".join(junk + w + junk))[5].split(",")
    assert found >= 180
    assert scanner.scan(" ".join(f"q{rng.randint(0, 99)}" for _ in range(500)))[5] == ""


def test_language(spark, edge, empty):
    rng = random.Random(3)
    kinds = {"aa": "la le lo ra re ka", "bb": "xiq zup vog yew qib", "cc": "śćą żół ęńń ćwi"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(rng.randint(5, 80))), k) for i, k in enumerate(list(kinds) * 60)]
    docs = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "12 ... 34", "aa"), (1002, "la le", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    truth = {i: k for i, _, k in rows}
    assert sum(got[i].lang_pred == k for i, k in truth.items()) > 0.97 * len(truth)
    assert sum(got[i].rejected for i in truth) == 0
    assert {(got[i].lang_pred, got[i].score) for i in (1000, 1001)} == {("und", 0.0)} and got[1002].lang_pred == "aa"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    out = langid.report(edge.drop("held_out"))
    assert out.count() == edge.count() and {r.lang_pred for r in out.collect()} == {"und"}
    assert langid.report(empty).count() == 0
    model = langid.fit(docs)
    assert langid.accepted(docs, model).count() == len(truth) + 1


def plain_likelihoods(counts, n, new):
    """{word: (log P(word | toxic), log P(word | ordinary))} of words in new, from {word: (toxic, ordinary)} by dictionaries."""
    grams = lambda w, k: [("\x02" * (k - 1) + w + "\x03")[i : i + k] for i in range(len(w) + 1)]

    def level(types):
        once, twice = sum(c == 1 for c in types.values()), sum(c == 2 for c in types.values())
        d = once / (once + 2 * twice) if once else 0.5
        total, cut = Counter(), Counter()
        for g, c in types.items():
            total[g[:-1]] += c
            cut[g[:-1]] += min(c, d)
        return lambda g: ((types[g] - min(types[g], d)) / total[g[:-1]] if g in types else 0.0, cut[g[:-1]] / total[g[:-1]] if g[:-1] in total else 1.0)

    lower = []
    for k in range(1, n):
        longer = {g for w in counts for g in grams(w, k + 1)}
        lower.append(level(Counter(g[1:] for g in longer)))
    top = []
    for c in (0, 1):
        types = Counter()
        for w, x in counts.items():
            for g in grams(w, n):
                if x[c]:
                    types[g] += x[c]
        top.append(level(types))
    alphabet = 1 + len(set("".join(counts)))

    def probability(g, c):
        p = 1 / alphabet
        for k, one in enumerate(lower, 1):
            share, rest = one(g[-k:])
            p = share + rest * p
        share, rest = top[c](g)
        return share + rest * p

    return {w: tuple(sum(math.log(probability(g, c)) for g in grams(w, n)) for c in (0, 1)) for w in new}


def test_toxicity_models_are_kneser_ney():
    rng = random.Random(8)
    counts = {}
    for _ in range(200):
        w = "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
        counts[w] = (rng.choice((0, 0, 1, 3)), rng.choice((0, 1, 2, 5)))
    counts = {w: x for w, x in counts.items() if any(x)}
    model = toxicity.train(list(counts), np.array(list(counts.values())))
    new = [*list(counts)[:50], "abcabc", "zzz", "a", "édz"]
    want = plain_likelihoods(counts, toxicity.ORDER, new)
    assert toxicity.word_ratios(model, new) == pytest.approx([want[w][0] - want[w][1] for w in new])
    texts = [["abc", "zzz", "abc"], [], ["a"]]
    want |= plain_likelihoods(counts, toxicity.ORDER, ["abc"])
    share = toxicity.SHARE
    for words_, got in zip(texts, toxicity.differences(model, texts)):
        toxic = [math.log((1 - share) * math.exp(want[w][1]) + share * math.exp(want[w][0])) for w in words_]
        ordinary = [want[w][1] for w in words_]
        assert got == pytest.approx((sum(toxic) - sum(ordinary)) / len(words_) if words_ else math.log(1 - share))


def test_toxicity(spark, edge, empty):
    rng = random.Random(4)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda bad: " ".join([*(rng.choice(common) for _ in range(60)), *(["zorkle", "vexnik"] * bad)])
    rows = [(i, text(1 if i % 3 == 0 else 0), int(i % 3 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted == rows[i][2] for i in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    out = toxicity.report(docs.union(edge.select("doc_id", "text")), labels)
    assert out.count() == 900 + edge.count()
    assert {r.score for r in toxicity.report(edge, labels.limit(0)).collect()} == {0.0}
    assert toxicity.report(empty, labels).count() == 0


def test_decontamination(spark, edge, empty):
    item = "Tom has 5 apples and buys 7 more apples for 3 dollars today. How many apples has Tom after 5 weeks in all?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (4, "too short")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Intro. " + item + " End."), (2, "So. " + item.replace("Tom", "Ann").replace("5", "9").replace("7", "4").replace("3", "8")), (3, item.replace("5 apples", "6 apples")), (4, "Apples are sold for 3 dollars and Tom buys more today."), (5, None)],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.find(docs, bench).collect()}
    assert got == {(1, 1): True, (2, 1): False}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.find(edge, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(edge, bench).count() == edge.count() and decontaminate.find(empty, bench).count() == 0


def test_decontamination_blocks(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.find(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, decontaminate.find(docs, bench).collect())) == whole
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t and len(x.split()) >= 12}
    assert exact <= {(d, i) for d, i, _, _ in whole}
