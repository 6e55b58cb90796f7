"""Exact n-gram Jaccard join in metric space, up to components.

A document is the set of its distinct SIZE-word shingles (64-bit hashes; A-Z in lower case; with
fewer words the whole sequence is one shingle). Documents link at 100 * intersection >= 80 * union,
that is within RADIUS of the Jaccard distance, which is a metric.

1. One pass over the texts writes for each its size, its identity (equal sets are one class),
   its keys and a sketch. The keys are the first n - ceil(0.8 n) + 1 shingles in a fixed order, of
   which any two linked sets share one. The order puts shingles that are frequent in a sample
   last; it affects the size of regions, never the result.
2. Pivots: of the classes that share a key the smallest is a pivot, and the others lie in its
   region. Classes that share no key with any other are at a distance over RADIUS from all and
   end here; linked classes share a key, so they share the region of its pivot. A class is
   measured against the pivots of its regions, the nearest first (its Voronoi cell); others only
   while they are of another component. A region of one component is done: this settles copies
   of one text, however many, by as many distances as there are copies.
3. What is left of a region is joined in the metric of sketches, the numbers of shingles in
   bins, whose L1 distance never exceeds the symmetric difference. The empty set is the
   first pivot: a set lies as far from it as its size, so regions fall into bands of sizes, with
   the next band as window. Cells over LEAF classes are first taken apart by what their classes have
   apart from the cell's common set, the shingles of most of a sample of it: classes so near to it that
   they link for sure join the nearest, and of all others two that link share one of the rarest
   differences (_differences). So near copies of one text part, however many, by a number of rows that
   follows theirs. What stays over LEAF is dealt to its nearest of PIVOTS more
   pivots, and a class is replicated to another cell where the triangle inequality lets a linked
   class stand there; cells are dealt again, until each fits a task, which goes on in the same
   way (join_cell). Cells that no pivot divides are joined by pairs of blocks.
4. Pairs that the sketches cannot tell apart are measured exactly on the sets.

Null or empty texts have no shingle and no links; their component is their own id. Rows with a
null id link like others; a component's id is the smallest one that is not null. Repeated rows
get a row each. An empty table gives an empty result. Set identity rests on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import fresh, keep, map_rows, per_worker, small_batches
from tarn.llm.components import components

SIZE = 5
RADIUS = 0.2
#: Classes and bytes of sketches of a cell that one task joins; pivots that divide a larger cell; classes of a block.
LEAF, LEAF_BYTES, PIVOTS, BLOCK = 1024, 16 << 20, 16, 512
#: Sets of a large cell by which its common set is found.
COMMON = 15
#: A cell that keeps more than this part of its region's classes is not divided further.
STUBBORN = 0.75
#: The sample by which frequent shingles are found, and how many of them are remembered.
SAMPLE_ROWS, FREQUENT_FROM, FREQUENT = 6_000, 4, 50_000
#: Shingles for each bin of a sketch, and the fewest and most bins; numbers over 255 count as 255, which keeps the bound.
PER_BIN, FEWEST, MOST = 1, 64, 1 << 20
#: Fewer bins by so much tell which cells have a pair that may link at all.
COARSE = 8
#: Bits of the filter that spares most documents' sets the shuffle; its size is fixed.
FILTER_BITS = 1 << 26
HELD = 150_000
ROWS = 500
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word)
        if len(self) >= HELD:
            self.clear()
        if len(word) <= 40:
            self[word] = found
        return found


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SIZE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * _MIX[j]
    out = _scramble(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_hash(own: np.ndarray) -> int:
    """Identity of a set as a signed 64-bit number."""
    return int(_scramble(np.array([_scramble(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The keys of a set: so many first shingles, frequent ones last, that linked sets share one."""
    n = len(own)
    if not n:
        return own
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[: n - (4 * n + 4) // 5 + 1]


def sketch(own: np.ndarray) -> bytes:
    """Numbers of shingles by their first bits, in a power of two of bins, a byte each."""
    bits = (min(MOST, max(FEWEST, len(own) // PER_BIN)) - 1).bit_length()
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def fold(sketch_: bytes, bins: int) -> np.ndarray:
    """The sketch in fewer bins."""
    return np.frombuffer(sketch_, np.uint8).astype(np.int32).reshape(bins, -1).sum(1)


def apart(x: bytes, y: bytes) -> int:
    """L1 distance of two sketches in the bins of the smaller one."""
    bins = min(len(x), len(y))
    return int(np.abs(fold(x, bins) - fold(y, bins)).sum())


def _sets(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many documents of a sample of about SAMPLE_ROWS rows have, at most FREQUENT."""
    total = docs.count()
    rate = min(1.0, SAMPLE_ROWS / total) if total else 1.0
    draw = F.pmod(F.xxhash64("doc_id", F.lit("shingles")), F.lit(1_000_003)) / 1_000_003

    def make():
        hashes = per_worker(("shingle words",), _Hashes)
        return lambda text: (shingles(text, hashes).view(np.int64).tolist(),)

    some = map_rows(_sets(docs).where(draw < rate).select("text"), make, "s array<long>")
    top = some.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT_FROM).orderBy(F.desc("count"), "s").limit(FREQUENT)
    return np.sort(top.select("s").toArrow()["s"].to_numpy().astype(np.int64).view(np.uint64))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, keys, sketch for each row of docs; cls is null without shingles.

    keys and sketch stand in the first row of a class in each task only, so copies of one text,
    however many, send their keys once for each task. A task remembers the 64-bit identities of its rows.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker(("shingle words",), _Hashes)
        late, sent = frequent.value, set()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                own = shingles(text, hashes)
                cls = set_hash(own) if len(own) else None
                first = cls is not None and cls not in sent
                if first:
                    sent.add(cls)
                for c, x in zip(out, (len(own), cls, prefix(own, late).view(np.int64) if first else None, sketch(own) if first else None)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds[1:]))], names=["doc_id", "n", "cls", "keys", "sketch"])

    return _sets(docs).mapInArrow(run, "doc_id long, n long, cls long, keys array<long>, sketch binary")


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit map of FILTER_BITS bits in which each rep of ids is set; its words, not the ids, come here."""
    bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(bit, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return out


def _members(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """cls, own (the set's hashes as bytes) of the classes in ids (cls, rep).

    The bit map spares most other documents; what it lets through by chance the join takes out.
    Rows without an id always go on to the join.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker(("shingle words",), _Hashes)
        table, sent = bits.value, set()
        for batch in batches:
            bit = batch.column(0).to_numpy()
            some = (table[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool) | batch.column(1).is_null().to_numpy(zero_copy_only=False)
            cls, sets = [], []
            for text in batch.column(2).filter(pa.array(some)).to_pylist():
                own = shingles(text, hashes)
                if len(own) and (one := set_hash(own)) not in sent:
                    sent.add(one)
                    cls.append(one)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "own"])

    rows = _sets(docs).select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"), "doc_id", "text").mapInArrow(run, "cls long, own binary")
    return rows.join(ids.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("own").alias("own"))


def distance(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both, len(a) + len(b) - both


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs that link."""
    one = sets.select(F.col("cls").alias("a"), F.col("own").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("own").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                both, union = distance(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                ok.append(100 * both >= 80 * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near_pivots(regions: DataFrame, some: DataFrame) -> DataFrame:
    """a (a class), b (a pivot of its) and far, the sketches' distance by the sizes, where sizes and sketches allow a link."""
    one = some.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    two = some.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.array([9 * apart(x, y) / (na + nb) for x, y, na, nb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], names=["a", "b", "far"]).filter(pa.array(far <= 1))

    pairs = regions.select(F.col("cls").alias("a"), F.col("pivot").alias("b")).join(one, "a").join(two, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return pairs.select("a", "b", "x", "y", "na", "nb").mapInArrow(run, "a long, b long, far double")


def join_cell(sketches: list[bytes], sizes: np.ndarray, label: np.ndarray, inside: np.ndarray, leaf: int = 32, pivots: int = 8) -> list[tuple[int, int, int]]:
    """(i, j, slack) of pairs of different labels that sizes and sketches allow to link, one of the two inside.

    slack is the sum of sizes less 9 times the sketches' L1, a metric; the larger the likelier. The
    inside is dealt to its nearest pivots; whatever may link with a cell's members lies within the cell's
    radius and the largest bound of its pivot, and exceeds its own nearest pivot's distance by twice
    that bound at most.
    """
    found: list[tuple[int, int, int]] = []
    bins = min(map(len, sketches))
    values = np.stack([fold(x, bins) for x in sketches])

    def pairs(core: np.ndarray, window: np.ndarray) -> None:
        everyone = np.concatenate((core, window))
        for k, i in enumerate(core.tolist()):
            others = everyone[k + 1 :]
            others = others[(label[others] != label[i]) & (5 * np.minimum(sizes[others], sizes[i]) >= 4 * np.maximum(sizes[others], sizes[i]))]
            if len(others):
                room = sizes[others] + sizes[i]
                others = others[9 * np.abs(values[others] - values[i]).sum(1) <= room]
                for j in others.tolist():
                    slack = int(sizes[i] + sizes[j]) - 9 * apart(sketches[i], sketches[j])
                    if slack >= 0:
                        found.append((i, j, slack))

    def recur(core: np.ndarray, window: np.ndarray) -> None:
        if not len(core) or len(core) + len(window) < 2:
            return
        if len(core) <= leaf:
            pairs(core, window)
            return
        chosen = core[np.arange(pivots) * len(core) // pivots]
        everyone = np.concatenate((core, window))
        d = np.stack([np.abs(values[everyone] - values[p]).sum(1) for p in chosen], 1)
        nearest, least = d.argmin(1), d.min(1)
        bound = (sizes[everyone].max() + sizes[core].max()) / 9
        inner = np.arange(len(everyone)) < len(core)
        for k in range(pivots):
            mine = inner & (nearest == k)
            if not mine.any():
                continue
            reach = np.minimum(d[mine, k].max() + bound, least + 2 * bound)
            beside = ~mine & (~inner | (nearest > k)) & (d[:, k] <= reach)
            if mine.sum() == len(core):
                pairs(everyone[mine], everyone[beside])
            else:
                recur(everyone[mine], everyone[beside])

    recur(np.flatnonzero(inside), np.flatnonzero(~inside))
    return found


def _divided(rows: DataFrame, some: DataFrame) -> DataFrame:
    """rows (cell, cls, inside, label, n, w) of large cells with their numbers m, dealt to Voronoi cells around pivots.

    A class goes to the cell of its nearest pivot. Any class within reach of it, a quarter of its size
    (two linked sets of 1.25 times the size at most differ in no more), stands in a cell whose pivot is
    farther by twice that at most: to those of higher number it goes as a window, outside; classes that
    are outside already go to all such cells.
    """
    picked = rows.where("inside").groupBy("cell", F.pmod(F.xxhash64("cls", "cell"), F.lit(PIVOTS)).alias("k")).agg(F.min("cls").alias("cls"))
    sketches = some.select("cls", "sketch")
    bins = rows.groupBy("cell").agg(F.min("w").alias("bins"))
    # at most PIVOTS sketches of a cell
    pivots = picked.join(sketches, "cls").groupBy("cell").agg(F.collect_list("sketch").alias("pivots")).join(bins, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            sizes, inside = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            folded: dict[int, np.ndarray] = {}
            of, to, core = [], [], []
            for i, (cell, n, within, own, pivots_, bins_) in enumerate(zip(batch.column(0).to_pylist(), sizes.tolist(), inside, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if cell not in folded:
                    folded[cell] = np.stack([fold(x, bins_) for x in sorted(pivots_)])
                d = np.abs(folded[cell] - fold(own, bins_)).sum(1)
                home = int(d.argmin())
                for k in np.flatnonzero(2 * d <= 2 * d[home] + n).tolist():
                    if within and k < home:
                        continue
                    of.append(i)
                    to.append(k)
                    core.append(within and k == home)
            rest = [batch.column(j).take(pa.array(of, pa.int64())) for j in (0, 6, 7, 1, 8, 9)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(to, pa.int32()), pa.array(core, pa.bool_())], names=["parent", "cls", "label", "n", "w", "m", "k", "inside"])

    dealt = rows.join(sketches, "cls").join(pivots, "cell").select("cell", "n", "inside", "sketch", "pivots", "bins", "cls", "label", "w", "m")
    dealt = dealt.mapInArrow(run, "parent long, cls long, label long, n long, w long, m long, k int, inside boolean")
    return dealt.select(F.xxhash64("parent", "k").alias("cell"), "cls", "inside", "label", "n", "w", "m")


def _bands(members: DataFrame) -> DataFrame:
    """cell, cls, inside, label, n, w: the regions' classes (pivot, cls, label, n, w) by bands of sizes, the next one as window."""
    band = F.floor(F.log("n") / float(np.log(1.25)) + 1e-9)
    bands = F.inline(F.array(F.struct(band.alias("band"), F.lit(True).alias("inside")), F.struct((band - 1).alias("band"), F.lit(False).alias("inside"))))
    return members.select("pivot", "cls", "label", "n", "w", bands).select(F.xxhash64("pivot", "band").alias("cell"), "cls", "inside", "label", "n", "w")


def _fits():
    return (F.col("size") <= LEAF) & (F.col("bytes") <= LEAF_BYTES)


def _sizes(rows: DataFrame) -> DataFrame:
    """cell, size, bytes, of: the cells of rows that have two labels and something inside."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("bytes"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("inside").alias("core"), F.max("m").alias("of"))
    return keep(sizes.where("core and l0 <> l1").select("cell", "size", "bytes", "of"))


def common_set(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that two of some sets or more have (one or more of fewer than three), and in how many."""
    tokens, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in sets]), return_counts=True)
    often = counts >= min(2, len(sets) // 2 + 1)
    return tokens[often], counts[often]


def differences(own: np.ndarray, tokens: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Shingles that a set has apart from the common set, those of more than half of k sets, in one order for all sets:
    what it has more before what it lacks, what is rare among the k first."""
    common = tokens[2 * counts > k]
    more, less = np.setdiff1d(own, common, True), np.setdiff1d(common, own, True)
    seen = np.zeros(len(more), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, more), len(tokens) - 1)
        seen = np.where(tokens[at] == more, counts[at], 0)
    lack = k - counts[np.searchsorted(tokens, less)]
    return np.concatenate((more[np.lexsort((more, seen))], less[np.lexsort((less, lack))]))


def _differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """cell, cls, excess, apart, first for the rows (cell, cls, n) of large cells: how many shingles a class has apart from its
    cell's common set, nine times that less its size, and the first of them, a quarter of its size at most and one."""
    most = F.least(F.lit(COMMON), F.greatest(F.lit(3), F.floor(F.lit(LEAF_BYTES) / (8 * F.max("n")))))
    share = rows.groupBy("cell").agg(most.alias("k"))
    some = rows.withColumn("draw", F.pmod(F.xxhash64("cls", "cell"), F.lit(COMMON))).groupBy("cell", "draw").agg(F.min("cls").alias("cls"))
    some = some.join(share, "cell").where("draw < k").join(sets, "cls").groupBy("cell").agg(F.collect_list("own").alias("sets"))

    def middle():
        def make(cell, sets_):
            tokens, counts = common_set(sets_)
            return cell, tokens.tobytes(), counts.astype(np.uint8).tobytes(), len(sets_)

        return make

    centres = keep(map_rows(some, middle, "cell long, tokens binary, counts binary, k int"))

    def parted():
        def make(cell, cls, n, own, tokens, counts, k):
            apart_ = differences(np.frombuffer(own, np.uint64), np.frombuffer(tokens, np.uint64), np.frombuffer(counts, np.uint8).astype(np.int64), k)
            return cell, cls, 9 * len(apart_) - n, len(apart_), apart_[: n // 4 + 1].view(np.int64).tolist()

        return make

    dealt = rows.join(sets, "cls").join(centres, "cell").select("cell", "cls", "n", "own", "tokens", "counts", "k")
    return map_rows(dealt, parted, "cell long, cls long, excess long, apart long, first array<long>")


def _stars(apart: DataFrame) -> DataFrame:
    """cell, least, centre, open: the smallest excess of a cell, its class, and the smallest excess of those that do not link with it
    for sure, null without any.

    Two classes differ in the sum of their differences at most, so they link if their excesses sum to 0 or less. If
    any two do, both do with the class of the smallest.
    """
    best = apart.groupBy("cell").agg(F.min(F.struct("excess", "cls")).alias("x")).select("cell", F.col("x.excess").alias("least"), F.col("x.cls").alias("centre"))
    rest = apart.join(best, "cell").where("excess + least > 0").groupBy("cell").agg(F.min("excess").alias("open"))
    return best.join(rest, "cell", "left")


def _parted(rows: DataFrame, apart: DataFrame, stars: DataFrame) -> DataFrame:
    """rows (cell, cls, inside, label, n, w) of large cells in a cell for each difference that two labels share.

    Two classes link if they share (e + f) / 18 differences, e and f their excesses. Let e be the smaller one: its class
    finds f >= e, and f >= open if it is itself sure of the centre; the other finds e >= least, and no class of over
    1.25 times its size. So many of the last of an order may be left out as must be shared, less one.
    """
    sure = F.col("excess") + F.col("least") <= 0
    low = F.ceil((F.col("excess") + F.greatest("excess", "open")) / 18)
    high = F.ceil(F.greatest((F.col("excess") + F.col("least")) / 18, (4 * F.col("excess") - 5 * F.col("n")) / 36))
    length = lambda shared: F.greatest(F.lit(0), F.col("apart") - shared + 1).cast("int")
    own = apart.join(stars.where("open is not null"), "cell").join(rows, ["cell", "cls"])
    own = own.withColumns({"low": length(low), "both": F.when(sure, length(low)).otherwise(F.greatest(length(low), length(high)))})
    placed = own.select("cell", "cls", "inside", "label", "n", "w", "low", F.posexplode(F.slice("first", F.lit(1), F.col("both"))).alias("at", "difference"))
    placed = placed.select(F.xxhash64("cell", "difference").alias("cell"), "cls", "inside", "label", "n", "w", (F.col("at") < F.col("low")).alias("low"))
    shared = placed.groupBy("cell").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("inside").alias("core"), F.max("low").alias("low"))
    return placed.drop("low").join(shared.where("core and low and l0 <> l1").select("cell"), "cell", "left_semi")


def _cells(rows: DataFrame, some: DataFrame) -> DataFrame:
    """cell, cls, inside, label: rows (cell, cls, inside, label, n, w), in cells that each fit a task."""
    rows, fits, out = rows.withColumn("m", F.lit(None).cast("long")), _fits(), None
    while True:
        rows = keep(rows)
        sizes = _sizes(rows)
        stuck = ~fits & (F.coalesce(F.col("size") > STUBBORN * F.col("of"), F.lit(False)))
        done = rows.join(sizes.where(fits).select("cell"), "cell", "left_semi").select("cell", "cls", "inside", "label")
        out = done if out is None else out.union(done)
        large = sizes.where(~fits)
        if large.isEmpty():
            return out
        # a cell that was not divided: a block meets itself and each other block once
        many = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / LEAF_BYTES))
        placed = rows.join(sizes.where(stuck).select("cell", many.alias("blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("cls", "cell"), F.col("blocks")))
        meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
        out = out.union(placed.select("cell", "cls", "inside", "label", F.inline(meets)).select(F.xxhash64("cell", "i", "j").alias("cell"), "cls", "inside", "label"))
        rows = _divided(rows.drop("m").join(sizes.where(~fits & ~stuck).select("cell", F.col("size").alias("m")), "cell"), some)


def _coarse(some: DataFrame) -> DataFrame:
    """some with sketches of COARSE times fewer bins."""

    def make():
        return lambda cls, n, x: (cls, n, np.minimum(fold(x, max(FEWEST, len(x) // COARSE)), 255).astype(np.uint8).tobytes())

    return map_rows(some.select("cls", "n", "sketch"), make, "cls long, n long, sketch binary")


def _candidates(cells: DataFrame, some: DataFrame, wanted: str) -> DataFrame:
    """cell, a, b: pairs of different labels within cells (cell, cls, inside, label) that may link.

    wanted: "all"; "best", one pair, the likeliest, for each two labels of a cell: if it links, all others
    of the two are moot; or "any", one pair of each cell that has some.
    """
    dealt = cells.join(some.select("cls", "n", "sketch"), "cls").select("cell", "cls", "label", "n", "inside", "sketch").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(part: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, cls, label, n = (part[c].to_numpy() for c in ("cell", "cls", "label", "n"))
            sketches = part["sketch"].to_pylist()
            inside = np.array(part["inside"].to_pylist(), bool)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
            found: list[tuple[int, int, int]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = cls[a:b].tolist()
                got = join_cell(sketches[a:b], n[a:b], label[a:b], inside[a:b])
                if wanted == "any":
                    got = got[:1]
                elif wanted == "best":
                    own_label = label[a:b].tolist()
                    top: dict[tuple, tuple] = {}
                    for i, j, slack in got:
                        pair = (min(own_label[i], own_label[j]), max(own_label[i], own_label[j]))
                        if pair not in top or slack > top[pair][2]:
                            top[pair] = (i, j, slack)
                    got = list(top.values())
                found += [(int(cell[a]), min(own[i], own[j]), max(own[i], own[j])) for i, j, _ in got]
            x = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["cell", "a", "b"])

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            held = pa.Table.from_batches(rest)
            cell = held["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # cells are sorted; the last may go on
            if cut:
                yield from joined(held.slice(0, cut))
                rest = held.slice(cut).combine_chunks().to_batches()
        if rest:
            yield from joined(pa.Table.from_batches(rest))

    return dealt.mapInArrow(run, "cell long, a long, b long")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, label: the classes of docs that link with another, and the smallest class of their component; rows are their profiles."""
    firsts = rows.where("keys is not null")
    places = firsts.select(F.explode("keys").alias("key"), "cls")
    pivots = places.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last")).where("pivot <> last").select("key", "pivot")
    regions = keep(places.join(pivots.hint("shuffle_hash"), "key").where("cls <> pivot").select("pivot", "cls").distinct())
    ids = regions.select("cls").union(regions.select("pivot")).distinct()
    some = keep(firsts.join(ids, "cls", "left_semi").groupBy("cls").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch")))
    reps = keep(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep")).join(ids, "cls", "left_semi"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))

    def fetched(classes: DataFrame, but: DataFrame | None = None) -> DataFrame:
        wanted = classes.distinct()
        return keep(_members(docs, reps.join(wanted if but is None else wanted.join(but.select("cls"), "cls", "left_anti"), "cls", "left_semi")))

    def named(table: DataFrame, label: DataFrame, cls: str, name: str) -> DataFrame:
        return table.join(label.select(F.col("node").alias(cls), F.col("label").alias(name)), cls, "left").withColumn(name, F.coalesce(name, cls))

    def open_(pairs: DataFrame, label: DataFrame) -> DataFrame:
        return named(named(pairs, label, "a", "la"), label, "b", "lb").where("la <> lb").select("a", "b")

    # each class against its nearest pivot, then the others where components still differ
    near = keep(_near_pivots(regions, some))
    sets = fetched(ends(near))
    first = near.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    found = keep(_measured(first, sets))
    label = components(found)
    found = keep(found.union(_measured(open_(near.select("a", "b").join(first, ["a", "b"], "left_anti"), label), sets)))
    label = components(found)
    # what the pivots have not decided: the likeliest pair of two components first, then, of the cells that gave any, all
    members = named(regions.join(some.select("cls", "n", F.length("sketch").cast("long").alias("w")), "cls"), label, "cls", "label")
    banded = keep(_bands(members))
    large = _sizes(banded.withColumn("m", F.lit(None).cast("long"))).where(~_fits())
    if not large.isEmpty():
        part = keep(banded.join(large.select("cell"), "cell", "left_semi"))
        sets = sets.union(fetched(part.select("cls"), sets))
        apart_ = keep(_differences(part, sets))
        stars = keep(_stars(apart_))
        star = apart_.join(stars, "cell").where("excess + least <= 0 and cls <> centre").select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()
        found = keep(found.union(_measured(open_(star, label), sets)))
        label = components(found)
        part = _parted(named(part.drop("label"), label, "cls", "label"), apart_, stars)
        banded = banded.join(large.select("cell"), "cell", "left_anti").unionByName(part)
    cells = keep(_cells(banded, some))
    # few classes that only share a passage pass even coarse sketches: most cells end here
    cells = keep(cells.join(_candidates(cells, keep(_coarse(some)), "any").select("cell"), "cell", "left_semi"))
    tried = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for wanted in ("best", "all"):
        pairs = keep(_candidates(cells, some, wanted))
        fresh_ = pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        fresh_ = keep(fresh_ if wanted == "best" else open_(fresh_, label))
        if fresh_.isEmpty():
            if pairs.isEmpty():
                break
        else:
            sets = sets.union(fetched(ends(fresh_), sets))
            found, tried = keep(found.union(_measured(fresh_, sets))), tried.union(fresh_)
            label = components(found)
        cells = named(cells.drop("label").join(pairs.select("cell").distinct(), "cell", "left_semi"), label, "cls", "label")
    return label


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    rows = keep(profiles(docs))
    label = links(docs, rows)
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    of = classes.join(label.select(F.col("node").alias("cls"), "label"), "cls").select("cls", "label", "rep")
    ids = of.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = of.join(ids, "label").select("cls", "component_id")
    every = classes.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.select("doc_id", "n", "cls").join(every, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the smallest id; rows without id or shingles stay.

    Rows that share an id are one document, so they stay or go together.
    """
    own = fresh(docs, "component_own_id")
    ids = report(docs).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == F.col(own), "left_semi").union(docs.where("doc_id is null"))
