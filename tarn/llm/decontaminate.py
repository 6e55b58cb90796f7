"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of documents and benchmark items become typed placeholders: a word
with a digit is a number, with any . and , between its digits; a unit is one of UNITS; a name is a
run of capitalised words that do not open a sentence; all other words stand in lower case. Windows of WINDOW template words (of the
whole item if it is shorter) are hashed and joined. Hits on one diagonal (document place minus
item place) align item and document; there the slots must be consistent: one value of the item
stands for one value in the document and the other way round. Of pairs of values that contradict
each other the most frequent stands, none if several are; windows that hold a slot of another pair
do not count. So a question with other numbers is caught, a text of the same shape with unrelated
slots is not. The first word of an item, which may stand inside a sentence of a document, is taken
in both forms, word and name. An item is found in a document where the windows that count cover
MIN_COVER of its windows, or where windows that follow each other hold LONG_RUN words that are
equal, whatever their part of the item.

The items' windows are a table, keyed by two independent 64-bit hashes. The documents are read once;
of their windows those leave the worker that pass a bit map of the items' hashes, which has at
most BLOCK_BYTES bytes whatever the benchmark's size (a larger benchmark lets more windows pass, none is lost).
They are written, joined to the items' windows on both hashes, and judged by document and item.

Templates below MIN_WORDS words, or without MIN_LITERAL words outside slots, cannot be told from
chance; such items are found as exact sequences of lower-cased words, however short: by windows too, all
of which must stand on one diagonal. Null or empty
texts have no windows. Repeated documents are reported each; repeated items each under their id;
rows with a null document id are reported with null, items with a null id likewise. Without items, or without
documents, the result is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import fresh, keep, map_rows, per_worker, small_batches

WINDOW, MIN_COVER, MIN_WORDS, MIN_LITERAL = 8, 0.6, 5, 4
#: The least above the 20 words on end that an item with one number changed may share with a clean document (test_decontamination).
LONG_RUN = 21
#: Bytes of the bit map at most; bits of it for each window of an item while it is smaller; bits that a window must find set.
BLOCK_BYTES, ROOM, PROBES = 8 << 20, 32, 4
#: Words whose form a worker remembers; words of texts that are cut into windows together.
HELD, GROUP = 200_000, 1 << 16
# Units of measurement.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years kb mb gb tb hz khz mhz ghz w kw v a k usd eur gbp dollar dollars euro euros cent cents percent metre metres meter meters kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms litre litres liter liters".split())
_TOKEN = r"[^\W_]+(?:[.,](?<=\d.)(?=\d)[^\W_]+)*|[.!?\n]"
_NUMBER, _UNIT, _NAME, _FIRST_WORD = 1, 2, 3, 4
#: Flags of a form.
_CAPITAL, _MARK, _BITS = 1, 2, 2
#: Variants of an item: its first word opens a sentence, stands within one; its words as they are.
_OPEN, _WITHIN, _PLAIN = 0, 1, 2
_WEIGHTS, _CHECKS = (np.array([pow(x, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_PROBES = np.array([pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) for j in range(PROBES)], np.uint64)
#: What _TOKEN finds in a text without _: only a word that ends in a digit can go on after a mark, and no word is tried again for less.
_FAST = re.compile(r"\w++(?:(?<!\d)|(?:[.,](?<=\d.)(?=\d)\w++)*+)|[.!?\n]").findall


def split(text: str | None) -> list[str]:
    """The words and marks of a text; _ stands between words."""
    return _FAST((text or "").replace("_", " "))


def literal(low: str) -> int:
    """The template id of a word in lower case: 58 bits of its hash, above the placeholders' ids."""
    return _FIRST_WORD + (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> 6)


class Forms(dict):
    """word -> template id << _BITS, and flags."""

    def __missing__(self, word: str) -> int:
        letters = word.isalpha()
        if not letters and word in ".!?\n":
            found = _MARK
        elif not letters and any(map(str.isdigit, word)):
            found = _NUMBER << _BITS
        else:
            low, upper = word.lower(), word[:1].isupper()
            if low in UNITS and not upper:
                found = _UNIT << _BITS
            else:
                found = (literal(low) << _BITS) + (_CAPITAL if upper and word[1:].islower() else 0)
        if len(self) >= HELD:
            self.clear()
        if len(word) <= 40:
            self[word] = found
        return found


def template(codes: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template ids, the places in the token list where each begins and ends, whether a capitalised word opens a sentence there).

    within: the first token does not open a sentence. Sentence marks drop out. Neighbouring names are one slot; a mark never stands between them,
    as the word after a mark is none.
    """
    mark, capital = (codes & _MARK) > 0, (codes & _CAPITAL) > 0
    opens = np.concatenate(([not within], mark[:-1]))
    ids = np.where(capital & ~opens, _NAME, codes >> _BITS)
    at = np.flatnonzero(~mark)
    ids = ids[at]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != _NAME) | (ids[:-1] != _NAME)
    last = np.ones(len(ids), bool)
    last[:-1] = first[1:]
    return ids[first], at[first], at[last] + 1, (capital & opens)[at[first]]


def value(words: list[str], begin: int, end: int) -> str:
    """What stands in a slot."""
    return " ".join(words[begin:end]).lower()


def standing(pairs: dict[tuple[int, str, str], int]) -> set[tuple[int, str, str]]:
    """Of pairs (kind, item's value, document's value) with their counts those that no other with a value of theirs reaches."""
    most: dict[tuple, list[int]] = defaultdict(list)
    for (kind, a, b), n in pairs.items():
        most[kind, 0, a].append(n)
        most[kind, 1, b].append(n)
    alone = {key: max(ns) if ns.count(max(ns)) == 1 else math.inf for key, ns in most.items()}
    return {(kind, a, b) for (kind, a, b), n in pairs.items() if n >= alone[kind, 0, a] and n >= alone[kind, 1, b]}


def spans(starts: set[int], size: int) -> list[list[int]]:
    """[begin, end) of the words under windows that follow each other."""
    out: list[list[int]] = []
    for q in sorted(starts):
        if out and out[-1][1] == q + size - 1:
            out[-1][1] += 1
        else:
            out.append([q, q + size])
    return out


def _at(ids: np.ndarray, starts: np.ndarray, n: int, weights: np.ndarray, first: int | None = None) -> np.ndarray:
    """Hashes of the windows of n ids at starts, with another first id if one is given."""
    out = np.full(len(starts), n, np.uint64)
    for j in range(n):
        out += (ids[starts + j].astype(np.uint64) if j or first is None else np.full(len(starts), first, np.uint64)) * weights[j]
    return out ^ (out >> np.uint64(31))


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """_at of all windows of n ids."""
    count, own = max(0, len(ids) - n + 1), ids.astype(np.uint64)
    out = np.full(count, n, np.uint64)
    for j in range(n):
        out += own[j : j + count] * _WEIGHTS[j]
    return out ^ (out >> np.uint64(31))


def _plain(low: Sequence[str]) -> np.ndarray:
    """Ids of words as they are; none is that of a template."""
    return np.array([-literal(w) for w in low], np.int64)


def item_windows(text: str | None) -> list[tuple]:
    """The windows of an item: (hash, check, variant, place, whether a name opens the item there, number of windows, size,
    places of the slots in the window, their kinds, their values)."""
    words = split(text)
    forms, out = Forms(), []
    codes = np.fromiter(map(forms.__getitem__, words), np.int64, len(words))
    plain = False
    for variant in (_OPEN, _WITHIN):
        ids, at, end, _ = template(codes, variant == _WITHIN)
        if variant == _WITHIN and (not len(at) or at[0] or not codes[0] & _CAPITAL):
            break
        if len(ids) < MIN_WORDS or (ids >= _FIRST_WORD).sum() < MIN_LITERAL:
            plain = True
            continue
        size = min(WINDOW, len(ids))
        count = len(ids) - size + 1
        hashes, checks = (_at(ids, np.arange(count), size, w).view(np.int64).tolist() for w in (_WEIGHTS, _CHECKS))
        for p in range(count):
            slots = [j for j in range(size) if ids[p + j] < _FIRST_WORD]
            values = [value(words, at[p + j], end[p + j]) for j in slots]
            out.append((hashes[p], checks[p], variant, p, not p and bool(ids[0] == _NAME), count, size, slots, [int(ids[p + j]) for j in slots], values))
    low = [w.lower() for w in words if w not in ".!?\n"]
    if low and plain:
        ids, size = _plain(low), min(WINDOW, len(low))
        count = len(low) - size + 1
        hashes, checks = (_at(ids, np.arange(count), size, w).view(np.int64).tolist() for w in (_WEIGHTS, _CHECKS))
        out += [(h, c, _PLAIN, p, False, count, size, [], [], []) for p, (h, c) in enumerate(zip(hashes, checks))]
    return out


def text_windows(texts: Iterable[str | None], forms: Forms, sizes: Sequence[int], plain: Sequence[int], passes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """Of documents' windows of these sizes (plain: as they are) those whose hash passes: (number of the text, hash, check, place,
    whether its first word is read as a name, values of its slots).

    Texts are cut together until they have GROUP words, with a sentence mark after each: what follows it is read as a text's beginning.
    """
    least = min([*sizes, *plain], default=math.inf)
    words, of, begins = [], [], []
    for n, text in enumerate(texts):
        own = split(text)
        if len(own) < least:
            continue
        of.append(n)
        begins.append(len(words))
        words += own
        words.append("\n")
        if len(words) >= GROUP:
            yield from _group_windows(words, of, begins, forms, sizes, plain, passes)
            words, of, begins = [], [], []
    if of:
        yield from _group_windows(words, of, begins, forms, sizes, plain, passes)


def _group_windows(words: list[str], of: list[int], begins: list[int], forms: Forms, sizes: Sequence[int], plain: Sequence[int], passes: Callable[[np.ndarray], np.ndarray]) -> list[tuple]:
    """text_windows of texts, numbered by of, that begin at these places of words."""
    codes = np.fromiter(map(forms.__getitem__, words), np.int64, len(words))
    ids, at, end, opens = template(codes)
    bounds, out = np.array([*begins, len(words)]), []

    def add(own: np.ndarray, places: np.ndarray, starts: np.ndarray, hashes: np.ndarray, size: int, head: bool = False) -> None:
        open_ = np.flatnonzero(passes(hashes))
        text = np.searchsorted(bounds, places[starts[open_]], "right") - 1
        inside = places[starts[open_] + size - 1] < bounds[text + 1]
        open_, text = open_[inside], text[inside]
        if not len(open_):
            return
        starts = starts[open_]
        checks = _at(own, starts, size, _CHECKS, _NAME if head else None).view(np.int64).tolist()
        place = starts - np.searchsorted(places, bounds[text])
        for n, s, d, h, c in zip(text.tolist(), starts.tolist(), place.tolist(), hashes[open_].view(np.int64).tolist(), checks):
            values = [value(words, at[s + j], end[s + j]) for j in range(size) if own[s + j] < _FIRST_WORD or (head and not j)] if own is ids else []
            out.append((of[n], h, c, d, head, values))

    for size in sizes:
        count = len(ids) - size + 1
        if count > 0:
            add(ids, at, np.arange(count), _hashes(ids, size), size)
            # a document's sentence may open with the name that an item begins with
            heads = np.flatnonzero(opens[:count])
            add(ids, at, heads, _at(ids, heads, size, _WEIGHTS, _NAME), size, True)
    if plain:
        places = np.flatnonzero((codes & _MARK) == 0)
        own = -(codes[places] >> _BITS)
        slots = np.flatnonzero(own > -_FIRST_WORD)
        own[slots] = _plain([words[i].lower() for i in places[slots].tolist()])
        for size in plain:
            if len(own) >= size:
                add(own, places, np.arange(len(own) - size + 1), _hashes(own, size), size)
    return out


def judge(matches: list[tuple]) -> tuple[float, bool] | None:
    """(cover, verbatim) of one item in one document, from the windows that meet: (variant, item's place, document's place minus item's,
    number of windows, size, places of slots, their kinds, the item's values, the document's values). None: not found."""
    diagonals: dict[tuple[int, int], dict[int, tuple]] = defaultdict(dict)
    for variant, p, shift, *rest in matches:
        diagonals[variant, shift][p] = rest
    found: dict[int, tuple[set[int], bool, int]] = {}
    long: set[int] = set()
    for (variant, _), at in sorted(diagonals.items()):
        windows, size = next(iter(at.values()))[:2]
        if variant == _PLAIN:
            if len(at) == windows:
                return 1.0, True
            continue
        slots = {p + j: (kind, a, b) for p, (_, _, places, kinds, theirs, own) in at.items() for j, kind, a, b in zip(places, kinds, theirs, own)}
        stands = standing(Counter(slots.values()))
        wrong = {p for p, pair in slots.items() if pair not in stands}
        good = {q for q in at if not any(q + j in wrong for j in range(size))}
        if good:
            same = all(a == b for _, a, b in slots.values())
            covered, verbatim, _ = found.get(variant, (set(), True, windows))
            found[variant] = (covered | good, verbatim and same, windows)
            differ = {p for p, (_, a, b) in slots.items() if a != b}
            if variant not in long and any(hi - lo - len(differ.intersection(range(lo, hi))) >= LONG_RUN for lo, hi in spans(good, size)):
                long.add(variant)
    best = [(len(covered) / windows, verbatim) for v, (covered, verbatim, windows) in found.items() if len(covered) >= MIN_COVER * windows or v in long]
    return max(best, default=None)


class Index:
    """Items in memory, to look single texts up: the join of find with a dictionary."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        self.windows: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        sizes: dict[bool, set[int]] = {False: set(), True: set()}
        for n, (_, text) in enumerate(items):
            for h, c, *rest in item_windows(text):
                self.windows[h, c].append((n, *rest))
                sizes[rest[0] == _PLAIN].add(rest[4])
        self.sizes, self.plain = sorted(sizes[False]), sorted(sizes[True])
        self.known = np.unique(np.array([h for h, _ in self.windows], np.int64))

    def forms(self) -> Forms:
        """The forms of documents' words."""
        return Forms()

    def hits(self, text: str | None, forms: Forms) -> Iterator[tuple[int, float, bool]]:
        """(item id, cover, verbatim) of each item found in the text."""
        matches: dict[int, list[tuple]] = defaultdict(list)
        for _, h, c, d, head, own in text_windows([text], forms, self.sizes, self.plain, lambda x: np.isin(x.view(np.int64), self.known)):
            for n, variant, p, named, windows, size, places, kinds, theirs in self.windows.get((h, c), ()):
                if named or not head:
                    matches[n].append((variant, p, d - p, windows, size, places, kinds, theirs, own))
        for n in sorted(matches):
            if got := judge(matches[n]):
                yield self.items[n][0], *got


def _probe(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The place of hashes in a map of 1 << bits bits, for the k-th probe."""
    return ((hashes * _PROBES[k]) >> np.uint64(64 - bits)).astype(np.int64)


def bit_map(items: DataFrame, bits: int) -> np.ndarray:
    """A map of 1 << bits bits in which each probe of the items' hashes is set; its words, not the hashes, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([_probe(hashes, k, bits) for k in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["w", "b"])

    words = items.select("h").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return out


def passing(words: np.ndarray, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which hashes find all their bits set in a bit_map."""

    def passes(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        left = None
        for k in range(PROBES):
            at = _probe(hashes if left is None else hashes[left], k, bits)
            hit = np.flatnonzero((words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1))
            left = hit if left is None else left[hit]
        out[left] = True
        return out

    return passes


_FOUND = "doc_id long, item_id long, cover double, verbatim boolean"
_ITEM = "h:long,c:long,variant:int,p:int,named:boolean,windows:int,size:int,places:array<int>,kinds:array<int>,theirs:array<string>"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cover (part of the item's windows) and verbatim (equal slots): a row for each item found."""
    texts = benchmark.where("text is not null").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    cut = map_rows(texts, lambda: lambda item, item_id, text: (item, item_id, item_windows(text)), f"item long, item_id long, w array<struct<{_ITEM}>>")
    # written, so that each item and, below, each document has one number whatever is computed again
    items = keep(cut.select("item", "item_id", F.inline("w")))
    counts = items.groupBy((F.col("variant") == _PLAIN).alias("plain"), "size").count().collect()
    if not counts:
        return docs.sparkSession.createDataFrame([], _FOUND)
    sizes, plain = (sorted(r["size"] for r in counts if r["plain"] == x) for x in (False, True))
    bits = max(5, min((ROOM * sum(r["count"] for r in counts)).bit_length(), (8 * BLOCK_BYTES).bit_length() - 1))
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(items, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, passes = per_worker(("template forms",), Forms), passing(shared.value, bits)
        for batch in batches:
            got = list(text_windows((x.as_py() for x in batch.column(2)), forms, sizes, plain, passes))
            of, *cols = zip(*got) if got else [()] * 6
            source = pa.array(of, pa.int64())
            cols = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(source), batch.column(1).take(source), *cols], ["row", "doc_id", "h", "c", "d", "head", "own"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    open_ = keep(small_batches(rows).mapInArrow(run, "row long, doc_id long, h long, c long, d int, head boolean, own array<string>"))
    match = F.struct("variant", "p", (F.col("d") - F.col("p")).alias("shift"), "windows", "size", "places", "kinds", "theirs", "own")
    met = open_.join(items, ["h", "c"]).where("named or not head").groupBy("row", "doc_id", "item", "item_id").agg(F.collect_list(match).alias("matches"))

    def verdict():
        def one(doc_id, item_id, matches):
            got = judge([tuple(m.values()) for m in matches])
            return doc_id, item_id, *(got or (None, None))

        return one

    return map_rows(met.select("doc_id", "item_id", "matches"), verdict, _FOUND).where("cover is not null")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose id has an item found in it; rows with a null id stay."""
    own = fresh(docs, "found_id")
    # written, so that its size is known: few ids go to every task, many are joined by shuffle
    ids = keep(find(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias(own)).distinct())
    return docs.join(ids, F.col("doc_id") == F.col(own), "left_anti")
