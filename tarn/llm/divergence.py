"""Source divergence audit: how far the sources of a language stand from each other and from the language.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. Each language keeps the terms that
stand in at least MIN_DOCS of its documents. A group (lang, source) with N occurrences of the V kept terms gives a term
with `count` of them p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)); a language gives q in the same way.

1. Each task counts its documents' terms by group in bounded tables: rows (lang, source, term, n, d).
2. One shuffle by (lang, term) sums them, and drops the terms of too few documents.
3. The terms of a language fall into blocks by their hash, of about TERMS terms, or of fewer where a dense matrix of all
   sources by the terms of a block had more than about CELLS numbers. Each block, by STRIP sources at a time, is a numpy int64 tile: its rows are
   broadcast against all sources, which gives a partial matrix of pairs, and each group keeps a heap of its TOP terms.
4. Partial matrices are summed by pair; heaps are merged by group.

All numbers are integers. p is found by long division in three steps of 1,000, so N + PRIOR * V may reach 9e15.

Defined results: null text, lang and source are ''; a group without terms takes part; a language without a kept term
gives pairs of value 0 and no terms; repeated rows each count and ids are not read; equal values are ordered
by the item's UTF-8 bytes; an empty table gives no rows; other columns are not read. Pairs grow with the square of a
language's sources, as the result asks for.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import keep, small_batches

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms and numbers of a tile, sources that are broadcast against all others at a time, and (group, term) entries of a task's tables.
TERMS, CELLS, STRIP, ENTRIES = 2048, 1 << 20, 256, 400_000
#: Languages whose figures go to every task; more are joined by a shuffle.
LANGS = 10_000

_KEEP = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of UTF-8 text to lower-case terms and blanks; every byte of a character beyond ASCII is 0x80 or more.
_BYTES = bytes(b if b in _KEEP else 0x20 for b in range(256)).lower()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, d of a task's rows; a null term marks each group that occurs."""
    names = ["lang", "source", "term", "n", "d"]

    def rows(groups: dict) -> pa.RecordBatch:
        lang, source, term, n, d = [], [], [], [], []
        for (g, s), (seen, docs) in groups.items():
            lang += [g] * (len(seen) + 1)
            source += [s] * (len(seen) + 1)
            term += [None, *seen]
            n += [0, *seen.values()]
            d += [0, *map(docs.__getitem__, seen)]
        own = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), own, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names)

    groups: dict = {}
    entries = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3))):
            found = Counter(text.as_py().translate(_BYTES).split())
            seen, docs = groups.setdefault((lang.as_py(), source.as_py()), ({}, {}))
            before = len(seen)
            for t, k in found.items():
                seen[t] = seen.get(t, 0) + k
                docs[t] = docs.get(t, 0) + 1
            entries += len(seen) - before
            if entries > ENTRIES:
                yield rows(groups)
                groups, entries = {}, 0
    yield rows(groups)


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, first: occurrences of kept terms by group, written to the shared folder.

    A row with a null term stands for each group; first marks one row of each kept term of a language.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), empty).cast("binary").alias("text"))
    parts = small_batches(rows).mapInArrow(_count, "lang string, source string, term string, n long, d long")
    # by (lang, term): the sum by group, the documents by language and the mark of one row need no second shuffle
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")
    known = sums.withColumns({"docs": F.sum("d").over(of_term), "first": F.col("source") == F.min("source").over(of_term)})
    return keep(known.where(F.col("term").isNull() | (F.col("docs") >= MIN_DOCS)).select("lang", "source", "term", "n", "first"))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total) in int64, for n <= total < 9.2e15."""
    out, rest = np.zeros_like(n), n
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def _tile(table: pa.Table) -> pa.Table:
    """part, source, item, value of one block of terms and one strip of sources.

    pair rows are partial sums over the block's terms, one for each source of the strip and each later source.
    """
    lang, strip = table.column("lang")[0], table.column("strip")[0].as_py()
    is_group = pc.is_null(table.column("term"))
    groups, cells = table.filter(is_group), table.filter(pc.invert(is_group))
    order = sorted(range(groups.num_rows), key=groups.column("source").to_pylist().__getitem__)
    sources = [groups.column("source")[i].as_py() for i in order]
    terms = sorted(set(cells.column("term").to_pylist()), key=str.encode)
    at, place = {s: i for i, s in enumerate(sources)}, {t: i for i, t in enumerate(terms)}
    count = np.zeros((len(sources), len(terms)), np.int64)
    if terms:
        rows = np.fromiter(map(at.__getitem__, cells.column("source").to_pylist()), np.int64, cells.num_rows)
        cols = np.fromiter(map(place.__getitem__, cells.column("term").to_pylist()), np.int64, cells.num_rows)
        count[rows, cols] = cells.column("n").to_numpy()
    held = groups.column("total").to_numpy()[order]
    kept = groups.column("kept").to_numpy()[:1]
    prior = PRIOR * kept
    low, high = strip * STRIP, min(len(sources), (strip + 1) * STRIP)
    out: dict = {"part": [], "source": [], "item": [], "value": []}

    def add(part, source, items, values):
        out["part"].append(np.full(len(items), part))
        out["source"].append(np.full(len(items), source, object))
        out["item"].append(np.array(items, object))
        out["value"].append(np.asarray(values, np.int64))

    p = shares(count + PRIOR, (held + prior)[:, None]) if terms else count
    names = np.array(sources, object)
    for i in range(low, high):
        # source i against all later ones at once; a few of them at a time where the terms are many
        step = max(1, CELLS // max(1, len(terms)))
        far = [np.abs(p[i] - p[j : j + step]).sum(axis=1) for j in range(i + 1, len(sources), step)]
        add("pair", sources[i], names[i + 1 :], np.concatenate(far) if far else [])
    if terms:
        q = shares(count.sum(axis=0) + PRIOR, held.sum() + prior)
        for i in range(low, high):
            above = np.nonzero((count[i] > 0) & (p[i] > q))[0]
            best = heapq.nsmallest(TOP, zip((q - p[i])[above].tolist(), above.tolist()))  # terms are in byte order
            add("term", sources[i], [terms[t] for _, t in best], [-v for v, _ in best])
    cols = [np.concatenate(v) if v else [] for v in out.values()]
    n = len(cols[0])
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array([lang.as_py()] * n, pa.string()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["lang", *out])


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source)."""
    known = counts(docs)
    is_group = F.col("term").isNull()
    groups = known.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & ~is_group).alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("kept"), F.count(F.lit(1)).alias("n_sources"))
    langs = langs.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / F.least(F.lit(TERMS), CELLS / F.col("n_sources")))).cast("int"), "strips": F.ceil(F.col("n_sources") / STRIP).cast("int")})
    langs = keep(langs)
    few = langs.count() <= LANGS
    of_lang = F.broadcast(langs) if few else langs
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    null = F.lit(None).cast("string")
    own = groups.join(of_lang, "lang").select("*", every.alias("block")).select("lang", "source", null.alias("term"), F.lit(0).cast("long").alias("n"), "total", "kept", "block", "strips")
    cells = known.where(~is_group & (F.col("n") > 0)).join(of_lang, "lang")
    zero = F.lit(0).cast("long")
    cells = cells.select("lang", "source", "term", "n", zero.alias("total"), zero.alias("kept"), F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "strips")
    rows = own.unionByName(cells).select("*", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip")).drop("strips")
    tiles = keep(rows.groupBy("lang", "block", "strip").applyInArrow(_tile, "lang string, part string, source string, item string, value long"))
    far = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p")
    pairs = far.select("lang", both, "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    heaps = tiles.where("part = 'term'").select(*pairs.columns)
    return ranked(pairs).unionByName(ranked(heaps).where(F.col("rank") <= TOP))
