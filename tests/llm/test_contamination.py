"""The join of template windows against a plain search, and its recall on items with other numbers and names."""

import random
import re
from collections import Counter

from tarn.llm import decontaminate as D

WORDS = "how many apples does a train carry when the farmer buys red boxes and sells old stones for each long day so that all the water in one tank is left after they leave at noon with some more pears".split()
NAMES, UNITS = ["Tom", "Ann", "New York", "Bob", "Rome"], ["km", "hours", "dollars", "kg"]


def question(rng, n):
    """A question of n words with slots, as a list of (kind, word)."""
    out = []
    for i in range(n):
        kind = rng.choice("wwwwwnum") if i else "w"
        out.append((kind, {"w": lambda: rng.choice(WORDS), "n": lambda: str(rng.randint(1, 40)), "u": lambda: rng.choice(UNITS), "m": lambda: rng.choice(NAMES)}[kind]()))
    return out


def text(parts):
    return " ".join(w for _, w in parts) + "?"


def other(rng, parts):
    """The question with other numbers and names, one for each of its own."""
    new = dict(zip(map(str, range(1, 41)), map(str, rng.sample(range(50, 500), 40)))) | dict(zip(NAMES, rng.sample(["Eve", "San Remo", "Kim", "Paris", "Max"], 5)))
    return [(k, new.get(w, w) if k in "nm" else w) for k, w in parts]


def plain_template(words, within):
    """[(kind or word, value)]: sentence marks drop out, neighbouring names are one."""
    out, opens = [], not within
    for w in words:
        if w in ".!?\n":
            opens = True
            continue
        low = w.lower()
        if re.search(r"\d", w):
            new = ("number", low)
        elif low in D.UNITS and w[0].islower():
            new = ("unit", low)
        elif w[0].isupper() and w[1:].islower() and not opens:
            new = ("name", low)
        else:
            new = (f"={low}", low)
        if new[0] == "name" and out and out[-1][0] == "name":
            new = ("name", f"{out.pop()[1]} {low}")
        out.append(new)
        opens = False
    return out


def plain_found(item, doc):
    """Whether the item stands in the document, by comparing every window with every window."""
    split = lambda t: re.findall(D._TOKEN, t)
    b, raw = plain_template(split(doc), False), split(item)
    low = [[w.lower() for w in split(t) if w not in ".!?\n"] for t in (item, doc)]
    slot = lambda x: x[0][0] != "="
    for within in (False, True):
        if within and not (raw and raw[0][0].isupper() and raw[0][1:].islower()):
            break
        a = plain_template(raw, within)
        if len(a) < D.MIN_WORDS or sum(not slot(x) for x in a) < D.MIN_LITERAL:
            if low[0] and any(low[1][i : i + len(low[0])] == low[0] for i in range(len(low[1]))):
                return True
            continue
        size = min(D.WINDOW, len(a))
        covered = set()
        for shift in range(-len(a), len(b) + 1):
            same = lambda q: 0 <= q + shift and q + shift + size <= len(b) and all(a[q + j][0] == b[q + shift + j][0] for j in range(size))  # noqa: B023, E731
            starts = [q for q in range(len(a) - size + 1) if same(q)]
            pairs = {q + j: (a[q + j][0], a[q + j][1], b[q + shift + j][1]) for q in starts for j in range(size) if slot(a[q + j])}
            n = Counter(pairs.values())
            rivals = lambda x: [c for y, c in n.items() if y != x and y[0] == x[0] and (y[1] == x[1] or y[2] == x[2])]  # noqa: B023, E731
            wrong = {p for p, x in pairs.items() if any(c >= n[x] for c in rivals(x))}
            good = [q for q in starts if not wrong & set(range(q, q + size))]
            covered |= set(good)
            run, last = set(), None
            for q in good:
                run = (run if last == q - 1 else set()) | set(range(q, q + size))
                last = q
                if sum(p not in pairs or pairs[p][1] == pairs[p][2] for p in run) >= D.LONG_RUN:
                    return True
        if len(covered) >= D.MIN_COVER * (len(a) - size + 1):
            return True
    return False


def cases(rng, n):
    items = [question(rng, rng.randint(1, 45)) for _ in range(n)]
    docs = []
    for parts in items:
        changed = other(rng, parts)
        for k in rng.sample(range(len(changed)), min(len(changed), rng.choice((0, 0, 1, 3)))):
            changed[k] = (changed[k][0], rng.choice(("9", "Zoe", "word", changed[k][1])))
        part = changed[rng.choice((0, 0, 3)) :][: rng.choice((60, 60, 20))]
        docs.append(" ".join([text(question(rng, 12)), text(part), text(question(rng, 9))]))
    return [text(x) for x in items], docs


def test_equals_the_plain_search(spark):
    items, docs = cases(random.Random(11), 60)
    items += [items[0], "Say 5 7", "no?"]
    docs += [docs[0], "no 1 else: say 5 7 then", ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.find(frame, bench).collect())
    assert got == sorted((d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if plain_found(x, t))
    assert 20 <= len(got) <= 55  # some found, some not


def test_recall_on_other_numbers_and_names(spark):
    rng = random.Random(3)
    items = [question(rng, rng.randint(15, 60)) for _ in range(150)]
    frame = spark.createDataFrame([(i, f"{text(question(rng, 30))} {text(other(rng, x))} {text(question(rng, 30))}") for i, x in enumerate(items)] + [(1000 + i, text(question(rng, 90))) for i in range(150)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find(frame, spark.createDataFrame([(i, text(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert len({(i, i) for i in range(150)} & got) >= 0.9 * 150
    assert not any(d >= 1000 for d, _ in got)


def test_rows_and_ids(spark):
    """Repeated rows, repeated and null ids, own columns with the names used inside."""
    item = "Tom has 5 apples and buys 7 more apples for 3 dollars today. How many apples has Tom in all?"
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, item, "x")], "item_id long, text string, item string")
    rows = [(7, item, 0, 0, "a"), (7, item, 0, 0, "a"), (None, item, 0, 0, "b"), (8, "else", 0, 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, w int, found_id string")
    got = Counter((r.doc_id, r.item_id) for r in D.find(docs, bench).collect())
    assert got == {(7, 1): 4, (7, None): 2, (None, 1): 2, (None, None): 1}
    assert sorted(r.found_id for r in D.clean(docs, bench).collect()) == ["b", "c"]


def test_a_join_that_finds_nothing_finds_no_item(spark, monkeypatch):
    item = "Tom has 5 apples and buys 7 more apples for 3 dollars today. How many apples has Tom in all?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item)], "doc_id long, text string")
    assert D.find(docs, bench).count() == 1
    monkeypatch.setattr(D, "bit_map", lambda items, bits: D.np.zeros(1 << (bits - 5), D.np.uint32))
    assert D.find(docs, bench).count() == 0
