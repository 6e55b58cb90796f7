"""Removal of repeated LENGTH-byte strings, with deep-shallow suffix sorting.

Each text is its UTF-8 bytes. A byte goes if a LENGTH-byte string over it also starts earlier:
in a document with a smaller id, or before it in the same one. Strings are judged on the input.
A row's position is its id, null last, and the hash of its text; a repeat costs bytes only of the
row in which it stands.

1. Of the GRAM-byte grams inside a string the one with the least hash is its anchor; equal
   strings have equal anchors at equal places. So a document is cut into runs of string starts
   that share an anchor; a run's context is the bytes that its strings cover.
2. Runs go to a bucket by their anchor's hash, packed, with the hash of their context. Of runs
   with equal contexts in one Arrow batch only the first is sent; the others are repeats, and so
   are all but the first in the bucket. A passage in any number of copies thus sends one run for
   each batch. Anchors with many contexts in a sample of the documents (a gram that stands in many
   texts) would make one large group: their runs are cut into single strings, whose own hash
   is their bucket, so they spread evenly. The sample changes the size of groups, never the result.
3. Anchors that stand in different contexts are compared byte by byte: the contexts, read from
   the texts, are sorted on both sides of the anchor by words of eight bytes to a shallow depth and
   blind tries for the groups with longer common prefixes. From the two orders and their common
   prefix lengths follows which strings stand in several contexts: those of one class, in both
   orders, by the bytes they have before and after the anchor. Pairs of contexts are never formed,
   so an anchor's time grows with its contexts. An anchor with over SPLIT contexts is spread by the
   hashes of the strings themselves.
4. The repeats meet their texts, which are cut.

Null and empty texts are empty. Rows with a null id come after all others, in the order of their
texts' hashes; so do rows that share an id among themselves, and of two such rows the later one loses
what they share. Rows equal in id and text count as one document and are cut alike. An empty table
gives an empty result; other columns do not matter. Two hashes of 64 bits, of anchor and context,
together stand for equality in step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import keep, per_worker, small_batches

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
#: Bytes of text for one bucket, contexts of one anchor that one sort takes, and contexts, of any anchors, that are sorted together.
BUCKET_BYTES, SPLIT, TOGETHER = 32 << 20, 100_000, 1 << 16
#: The sample by which anchors with many contexts are found: its rows, the contexts from which an anchor counts, and how many are remembered.
SAMPLE_ROWS, HOT_FROM, HOT = 6_000, 40, 50_000
#: Texts are hashed in pieces of so many bytes.
PIECE = 1 << 20
#: Bytes by which contexts are sorted before blind tries: the number of the group, the gram and 16 more.
SHALLOW = 8 + GRAM + 16
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class _Powers:
    """Powers of the hash base and of its inverse, and the bytes' values."""

    def __init__(self):
        n = PIECE + 2 * LENGTH
        state, values = 0x243F6A8885A308D3, []
        for _ in range(256):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            values.append((state ^ state >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) | 1)
        self.value = np.array(values, _U)
        up, down = np.full(n + 1, _BASE, _U), np.full(n + 1, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def runs(data: bytes, powers: _Powers, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first start, last start, anchor - last start) of the runs of a text, in order.

    Runs of the anchors in hot (sorted) are cut into single strings; a string's hash stands for the
    anchor's, and the anchor's with its place for the context's.
    """
    out: list[list] = [[], [], [], [], []]
    for begin in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        a = np.frombuffer(data, np.uint8, min(PIECE + LENGTH - 1, len(data) - begin), begin)
        n = len(a)
        sums = np.zeros(n + 1, _U)
        np.cumsum(powers.value[a] * powers.up[:n], out=sums[1:])
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * powers.down[: n - GRAM + 1])
        low = _U((1 << 21) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=_U)
        size = 1
        while 2 * size <= SPAN:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
        at = (least & low).astype(np.int64)
        change = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], change))
        last = np.concatenate((change, [len(at)])) - 1
        anchor = at[first]
        context = (sums[last + LENGTH] - sums[first]) * powers.down[first]
        context = _mix(context + (anchor - first).astype(_U) * _U(0xA0761D6478BD642F) + (last - first).astype(_U) * _U(0xE7037ED1A0B428DB))
        key = grams[anchor]
        if len(hot):
            cut = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            sizes = np.where(cut, last - first + 1, 1)
            if cut.any():
                of = np.repeat(np.arange(len(key)), sizes)
                start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                single = cut[of]
                place = (anchor[of] - start).astype(_U)
                string = _mix((sums[start + LENGTH] - sums[start]) * powers.down[start])
                context = np.where(single, _mix(key[of] + place * _U(0xA0761D6478BD642F)), context[of])
                key, anchor, first, last = np.where(single, string, key[of]), anchor[of], start, np.where(single, start, last[of])
        for x, y in zip(out, (key, context, first + begin, last + begin, anchor - last)):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (_U, _U, np.int64, np.int64, np.int64)))


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns as byte planes, in which the equal high bytes of small numbers lie together."""
    return b"".join(np.ascontiguousarray(c.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T).tobytes() for c, w in zip(columns, _WIDTHS))


_WIDTHS = (8, 8, 8, 8, 4, 1, 1)


def _unpack(rows: list[bytes]) -> list[np.ndarray]:
    out: list[list] = [[] for _ in _WIDTHS]
    for row in rows:
        n, at = len(row) // sum(_WIDTHS), 0
        for x, w in zip(out, _WIDTHS):
            plane = np.frombuffer(row, np.uint8, n * w, at).reshape(w, n).T
            x.append(np.ascontiguousarray(plane).view(f"<u{w}").reshape(-1))
            at += n * w
    return [np.concatenate(x) if x else np.zeros(0, f"<u{w}") for x, w in zip(out, _WIDTHS)]


def _by(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    kinds, start = np.unique(bucket[order], return_index=True)
    for k, a, b in zip(kinds.tolist(), start, [*start[1:], len(order)]):
        yield k, [c[order[a:b]] for c in columns]


def _doc_bucket(docs: np.ndarray, versions: np.ndarray, buckets: int) -> np.ndarray:
    """Remainder by the number of buckets, which is prime; pmod in Spark gives the same."""
    return np.mod(docs ^ versions, buckets)


def _repeats(out: list, docs: np.ndarray, versions: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> None:
    """Adds packed rows of (document, version, first byte, end) by the documents' buckets."""
    if len(docs):
        for k, cols in _by(_doc_bucket(docs, versions, buckets), docs, versions, low, high):
            out.append((k, b"".join(c.astype(np.int64).tobytes() for c in cols)))


def _four(rows: list[bytes]) -> np.ndarray:
    """Rows of _repeats as an array of four lines."""
    return np.concatenate([np.frombuffer(r, np.int64).reshape(4, -1) for r in rows] or [np.zeros((4, 0), np.int64)], 1)


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """Hashes of the anchors with HOT_FROM contexts or more in a sample of about SAMPLE_ROWS rows, at most HOT, sorted."""
    total = rows.count()
    rate = min(1.0, SAMPLE_ROWS / total) if total else 1.0
    draw = F.pmod(F.xxhash64("doc", "ver", F.lit("anchors")), F.lit(1_000_003)) / 1_000_003

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, none = per_worker(("powers",), _Powers), np.zeros(0, _U)
        for batch in batches:
            got = [runs(t.as_buffer().to_pybytes(), powers, none)[:2] for t in batch.column(0) if t.is_valid]
            pairs = np.unique(np.concatenate([np.stack(x) for x in got] or [np.zeros((2, 0), _U)], 1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["anchor", "context"])

    some = rows.where(draw < rate).select("text").mapInArrow(run, "anchor long, context long").distinct()
    top = some.groupBy("anchor").count().where(F.col("count") >= HOT_FROM).orderBy(F.desc("count"), "anchor").limit(HOT)
    return np.sort(top.select("anchor").toArrow()["anchor"].to_numpy().astype(np.int64).view(_U))


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    """kind (0: runs by anchor bucket, 1: repeats by document bucket), bucket, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = per_worker(("powers",), _Powers)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for doc_id, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) >= LENGTH:
                    got = runs(data, powers, shared.value)
                    for x, y in zip(cols, (*got, np.full(len(got[0]), doc_id, np.int64), np.full(len(got[0]), version, np.int64))):
                        x.append(y)
            if not cols[0]:
                continue
            anchor, context, first, last, beyond, doc, ver = (np.concatenate(x) for x in cols)
            again = _again(anchor, context, doc, ver, first)
            rows: list = []
            r = np.flatnonzero(again)
            if len(r):  # neighbouring repeats of a document become one
                joins = (np.diff(r) == 1) & (doc[r][1:] == doc[r][:-1]) & (ver[r][1:] == ver[r][:-1]) & (first[r][1:] == last[r][:-1] + 1)
                head, tail = np.concatenate(([True], ~joins)), np.concatenate((~joins, [True]))
                _repeats(rows, doc[r[head]], ver[r[head]], first[r[head]], last[r[tail]] + LENGTH, buckets)
            found = [(1, *x) for x in rows]
            s = np.flatnonzero(~again)
            for k, packed in _by((anchor[s] % _U(buckets)).astype(np.int64), anchor[s], context[s], doc[s], ver[s], first[s], (last - first)[s], beyond[s]):
                found.append((0, k, _pack(packed)))
            yield _record(found)

    return docs.mapInArrow(run, "kind int, bucket long, packed binary")


def _judge(sent: DataFrame, buckets: int) -> DataFrame:
    """kind (1: repeats; 2: contexts to compare) by document bucket, packed.

    kind 2 has seven lines: document, version, first start, last start, anchor's place, its hash, and the number of its contexts.
    """

    def run(table: pa.Table) -> pa.Table:
        kinds, packed = table["kind"].to_pylist(), table["packed"].to_pylist()
        found = [(1, b, p) for k, b, p in zip(kinds, table["bucket"].to_pylist(), packed) if k == 1]
        anchor, context, doc, ver, first, extra, beyond = _unpack([p for k, p in zip(kinds, packed) if k == 0])
        doc, ver, first = doc.view(np.int64), ver.view(np.int64), first.astype(np.int64)
        last = first + extra
        if len(anchor):
            again = _again(anchor, context, doc, ver, first)
            out: list = []
            _repeats(out, doc[again], ver[again], first[again], last[again] + LENGTH, buckets)
            found += [(1, *x) for x in out]
            rest = np.flatnonzero(~again)
            order = rest[np.lexsort((context[rest], anchor[rest]))]
            a, c = anchor[order], context[order]
            new = np.concatenate(([True], a[1:] != a[:-1]))
            own = np.cumsum(new) - 1
            number = np.bincount(own, np.concatenate(([True], new[1:] | (c[1:] != c[:-1]))))[own]
            order, number = order[number > 1], number[number > 1]
            lines = (doc, ver, first, last, last + beyond, anchor.view(np.int64))
            for k, cols in _by(_doc_bucket(doc[order], ver[order], buckets), *(x[order] for x in lines), number):
                found.append((2, k, b"".join(x.astype(np.int64).tobytes() for x in cols)))
        return pa.Table.from_batches([_record(found)])

    bucket = F.when(F.col("kind") == 0, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    return sent.groupBy(bucket.alias("g")).applyInArrow(run, "kind int, bucket long, packed binary")


def _record(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "bucket", "packed"])


def _again(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray, ver: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks runs of which an equal one, by both hashes, stands earlier."""
    order = np.lexsort((first, ver, doc, context, anchor))
    a, c, d, v, f = anchor[order], context[order], doc[order], ver[order], first[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), bool)
    out[order] = (d != d[lead]) | (v != v[lead]) | (f != f[lead])
    return out


def _prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Sorts strings with long common prefixes: inner nodes hold a place and its bytes, leaves the strings."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: object = [first]

    def add(self, i: int) -> None:
        s, node, path = self.strings[i], self.root, []
        while isinstance(node, tuple):
            path.append(node)
            place, kids = node
            c = s[place] if place < len(s) else -1
            node = kids.get(c)
            if node is None:  # any leaf below shares what all strings here share
                node = next(iter(kids.values()))
        other = self.strings[node[0]]
        common = _prefix(s, other)
        if common == len(s) == len(other):
            node.append(i)
            return
        parent = None
        at = self.root
        for step in path:
            if step[0] >= common:
                at = step
                break
            parent = step
            c = s[step[0]] if step[0] < len(s) else -1
            at = step[1].get(c)
        mine = s[common] if common < len(s) else -1
        if isinstance(at, tuple) and at[0] == common:
            at[1][mine] = [i]
            return
        theirs = other[common] if common < len(other) else -1
        inner = (common, {mine: [i], theirs: at})
        if parent is None:
            self.root = inner
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = inner

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out += node
        return out


def _words(strings: list[bytes], width: int) -> np.ndarray:
    """The first width bytes of each string, zeros after its end; width is a multiple of 8."""
    return np.frombuffer(b"".join([s[:width].ljust(width, b"\0") for s in strings]), np.uint8).reshape(len(strings), width)


def deep_shallow(strings: list[bytes], depth: int = SHALLOW) -> list[int]:
    """Indices in sorted order: by the first depth bytes, eight at a time, then blind tries for what still ties."""
    if not depth:
        order, tied = np.arange(len(strings)), np.ones(max(0, len(strings) - 1), bool)
    else:
        key = _words(strings, -(-depth // 8) * 8).view(">u8").astype(_U)
        order = np.lexsort(key.T[::-1])
        tied = (key[order[1:]] == key[order[:-1]]).all(1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], tied, [0]))))
    for a, b in edges.reshape(-1, 2).tolist():
        equal: dict[bytes, list[int]] = {}
        for i in order[a : b + 1].tolist():
            equal.setdefault(strings[i], []).append(i)
        if len(equal) > 1:
            heads = [x[0] for x in equal.values()]
            trie = BlindTrie(strings, heads[0])
            for i in heads[1:]:
                trie.add(i)
            order[a : b + 1] = [i for head in trie.order() for i in equal[strings[head]]]
    return order.tolist()


def _common(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string, common prefix with the one before in sorted order)."""
    order = np.array(deep_shallow(strings), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    size = np.array([len(s) for s in strings], np.int64)[order]
    rows = _words(strings, -(-max(size.tolist(), default=0) // 8) * 8 + 8)[order]
    before = np.zeros(len(order), np.int64)
    before[1:] = np.minimum((rows[1:] != rows[:-1]).argmax(1), np.minimum(size[1:], size[:-1]))
    same = (rows[1:] == rows[:-1]).all(1)
    before[1:][same] = np.minimum(size[1:], size[:-1])[same]
    return rank, before


def compare(group: np.ndarray, doc: np.ndarray, ver: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, data: list[bytes], wanted: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """(document, version, first start, last start) of strings that an earlier context of their group has too.

    A context is a group's number, document, version, first start, last start, anchor's place and the bytes from the first
    start; the anchors of a group are equal, and contexts come in order of group, document, version and start. wanted may mask
    the starts that count. All contexts are sorted at once on each side of their anchors, by their groups first. A string
    with x bytes before its anchor is known by two places in the orders, that of its x bytes before and of its LENGTH - x others;
    equal strings stand in one class of both, and the first of a class is the one that stays.
    """
    place = at - first
    names = [g.to_bytes(8) for g in group.tolist()]
    right, right_before = _common([g + d[x:] for g, d, x in zip(names, data, place.tolist())])
    left, left_before = _common([g + d[:x][::-1] for g, d, x in zip(names, data, place.tolist())])
    n, before = len(group), np.arange(SPAN)
    counts = (place[:, None] >= before) & ((at - last)[:, None] <= before)
    for k in [k for k, w in enumerate(wanted) if w is not None]:
        counts[k, at[k] - last[k] : place[k] + 1] = np.frombuffer(wanted[k], bool)[::-1]
    hit = np.zeros((n, SPAN + 1), bool)  # by start, and a column that parts the rows
    for x in range(SPAN):
        who = np.flatnonzero(counts[:, x])
        if len(who) < 2:
            continue
        kind = np.cumsum(left_before < x + 8)[left[who]] * (n + 1) + np.cumsum(right_before < LENGTH - x + 8)[right[who]]
        order = np.argsort(kind, kind="stable")
        new = np.concatenate(([True], kind[order[1:]] != kind[order[:-1]]))
        own = who[order]
        lead = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        hit[own, SPAN - 1 - x] = (doc[own] != doc[lead]) | (ver[own] != ver[lead]) | (at[own] != at[lead])
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit.ravel())))).reshape(-1, 2)
    k = edges[:, 0] // (SPAN + 1)
    low, high = (edges - (k * (SPAN + 1))[:, None]).T
    return doc[k], ver[k], at[k] - (SPAN - 1) + low, at[k] - SPAN + high


def _fetch(docs: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """anchor, part, doc, ver, first, last, at, data, wanted of the contexts to compare, and their bucket.

    An anchor with over SPLIT contexts is dealt by string hashes into parts; a context goes to the
    parts of its strings, and wanted marks those that belong there.
    """
    schema = pa.schema([("bucket", pa.int64()), ("anchor", pa.int64()), ("part", pa.int32()), ("doc", pa.int64()), ("ver", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("at", pa.int64()), ("data", pa.binary()), ("wanted", pa.binary())])

    def run(own: pa.Table, there: pa.Table) -> pa.Table:
        powers = per_worker(("powers",), _Powers)
        lines = np.concatenate([np.frombuffer(p, np.int64).reshape(7, -1) for p in there["packed"].to_pylist()] or [np.zeros((7, 0), np.int64)], 1)
        texts: dict[tuple[int, int], pa.Scalar] = {}
        if lines.shape[1]:
            texts = {(d, v): t for d, v, t in zip(own["doc"].to_pylist(), own["ver"].to_pylist(), own["text"]) if t.is_valid}
        out: list[tuple] = []
        for doc, ver, first, last, at, anchor, number in zip(*lines.tolist()):
            data = texts[doc, ver].as_buffer()[first : last + LENGTH].to_pybytes()
            if number <= SPLIT:
                out.append((_slot(anchor, 0, buckets), anchor, 0, doc, ver, first, last, at, data, None))
                continue
            a = np.frombuffer(data, np.uint8)
            sums = np.zeros(len(a) + 1, _U)
            np.cumsum(powers.value[a] * powers.up[: len(a)], out=sums[1:])
            parts = (_mix((sums[LENGTH:] - sums[:-LENGTH]) * powers.down[: len(a) - LENGTH + 1]) % _U(20 * number // SPLIT + 1)).astype(np.int64)
            for part in np.unique(parts).tolist():
                out.append((_slot(anchor, part, buckets), anchor, part, doc, ver, first, last, at, data, (parts == part).tobytes()))
        cols = list(zip(*out)) if out else [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, "bucket long, anchor long, part int, doc long, ver long, first long, last long, at long, data binary, wanted binary")


def _slot(anchor: int, part: int, buckets: int) -> int:
    return (anchor + 0x9E3779B97F4A7C15 * part) % buckets


def _compare_all(contexts: DataFrame, buckets: int) -> DataFrame:
    """kind 1 rows of the repeats among contexts."""

    def run(table: pa.Table) -> pa.Table:
        anchor, part, *lines = (table[c].to_numpy() for c in ("anchor", "part", "doc", "ver", "first", "last", "at"))
        order = np.lexsort((lines[2], lines[1], lines[0], part, anchor))
        new = np.concatenate(([True], (np.diff(anchor[order]) != 0) | (np.diff(part[order]) != 0)))
        group = np.cumsum(new)
        start = np.flatnonzero(new)
        out: list = []
        for some in np.split(np.arange(len(order)), start[np.flatnonzero(np.diff(start // TOGETHER)) + 1]):
            own = order[some]
            texts = table.select(["data", "wanted"]).take(pa.array(own))
            doc, ver, low, high = compare(group[some], *(x[own] for x in lines), texts["data"].to_pylist(), texts["wanted"].to_pylist())
            _repeats(out, doc, ver, low, high + LENGTH, buckets)
        return pa.Table.from_batches([_record([(1, *x) for x in out])])

    return contexts.groupBy("bucket").applyInArrow(run, "kind int, bucket long, packed binary")


def _cut(docs: DataFrame, gone: DataFrame, texts: bool) -> DataFrame:
    """One row for each row of docs: what of it is left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * texts)

    def run(own: pa.Table, there: pa.Table) -> pa.Table:
        lines = _four(there["packed"].to_pylist())
        lines = lines[:, np.lexsort((lines[2], lines[1], lines[0]))]
        new = np.flatnonzero(np.concatenate(([True], (lines[:2, 1:] != lines[:2, :-1]).any(0)))) if lines.shape[1] else np.zeros(0, np.int64)
        where = dict(zip(zip(*lines[:2, new].tolist()), zip(new.tolist(), [*new[1:].tolist(), lines.shape[1]])))
        out = []
        for doc_id, doc, ver, text in zip(own["doc_id"].to_pylist(), own["doc"].to_pylist(), own["ver"].to_pylist(), own["text"]):
            data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
            a, b = where.get((doc, ver), (0, 0))
            spans: list[list[int]] = []
            for low, high in zip(lines[2, a:b].tolist(), lines[3, a:b].tolist()):
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            raw = data.to_pybytes()
            edges = [0, *(e for s in spans for e in s), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
            row = (doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if texts else row)
        cols = list(zip(*out)) if out else [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return docs.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(run, ddl)


def _buckets(docs: DataFrame) -> int:
    """A prime number of buckets of about BUCKET_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(29, total // BUCKET_BYTES) | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept (binary) for each row of docs."""
    own = F.col("doc_id").cast("long")
    keyed = small_batches(docs).select(own.alias("doc_id"), F.coalesce(own, F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("ver"), "text")
    rows = keyed.select("doc", "ver", "text")
    buckets = _buckets(rows)
    judged = keep(_judge(_send(rows, buckets), buckets))
    keyed = keyed.withColumn("bucket", F.pmod(F.col("doc").bitwiseXOR(F.col("ver")), F.lit(buckets).cast("long")))
    contexts = _fetch(keyed, judged.where("kind = 2").select("bucket", "packed"), buckets)
    more = _compare_all(contexts, buckets)
    gone = judged.where("kind = 1").select("bucket", "packed").unionByName(more.select("bucket", "packed"))
    return _cut(keyed, gone, texts)


def report(docs: DataFrame) -> DataFrame:
    """dedup() without the texts."""
    return dedup(docs, False)
