"""The keyword index: words with their positions, phrases, BM25, and segments that repairs add.

Words are runs of letters and digits of any script, in lower case and, for Latin letters, without diacritics. A query's
term is a phrase of its words: it stands where they follow each other in one field. A field's weight counts for each
place. The rank is BM25 over phrases:

    idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)),  idf = max(ln((n - df + 0.5) / (df + 0.5)), 1e-6)

where tf is the weighted number of places, length the unweighted number of a chunk's words, n the number of all chunks and df that
of those with the phrase. A null or empty field has no words; a term without a word is left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import keep

WORD = r"[\p{L}\p{N}]+"
#: Weights of a job's fields.
FIELDS = {"title": 5.0, "company": 3.0, "location": 2.0, "section_type": 4.0, "content": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Phrases of a set of questions that go to every task, and words that are counted in the row; more are joined.
FEW_PHRASES, FEW_WORDS = 10_000, 256
#: Segments of an index beyond which small ones are merged.
SEGMENTS = 8


def _bases() -> dict[str, str]:
    """Letters of the Latin blocks up to U+024F with their base letter, where that is one of a to z."""
    out = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if chr(code) != base and base.isascii() and base.islower():
            out[chr(code)] = base
    return out


ACCENTED, PLAIN = map("".join, zip(*_bases().items()))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), ACCENTED, PLAIN), F.lit(WORD), 0)


def phrases(terms: DataFrame) -> DataFrame:
    """query_id, phrase, tokens of terms (query_id, term), each once."""
    rows = terms.select("query_id", words(F.col("term")).alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("query_id", F.array_join("tokens", " ").alias("phrase"), "tokens").dropDuplicates(["query_id", "phrase"])


def _length(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, map(F.size, names))


def postings(chunks: DataFrame, fields: dict[str, float] = FIELDS, key: str = "chunk_id", sizes: bool = False) -> DataFrame:
    """key, job_id, dl, field, term, positions: where each word of a chunk stands in each of its fields, without a shuffle.

    field is the place in `fields`; dl is the chunk's number of words. Positions count from 0 in their field. With sizes,
    each chunk has one more row, without a term, so that one pass over the texts gives lengths() as well.
    """
    names = [f"w{i}" for i in range(len(fields))]
    rows = chunks.select(F.col(key).alias("k"), "job_id", *[words(F.col(c)).alias(n) for c, n in zip(fields, names)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"{key} {kinds['k']}, job_id {kinds['job_id']}, dl int, field int, term string, positions array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, dl, field, term, positions = [], [], [], [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, batch.num_columns)))):
                total = sum(map(len, row))
                if sizes:
                    for c, x in zip((origin, dl, field, term, positions), (i, total, None, None, None)):
                        c.append(x)
                for f, tokens in enumerate(row):
                    places: dict[str, list[int]] = {}
                    for at, t in enumerate(tokens):
                        places.setdefault(t, []).append(at)
                    term += places
                    positions += places.values()
                    origin += [i] * len(places)
                    field += [f] * len(places)
                    dl += [total] * len(places)
            source = pa.array(origin, pa.int64())
            own = [batch.column(0).take(source), batch.column(1).take(source)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(dl, pa.int32()), pa.array(field, pa.int32()), pa.array(term, pa.string()), pa.array(positions, pa.list_(pa.int32()))], [key, "job_id", "dl", "field", "term", "positions"])

    return rows.mapInArrow(run, schema)


def lengths(chunks: DataFrame, fields: dict[str, float] = FIELDS, key: str = "chunk_id") -> DataFrame:
    names = [f"w{i}" for i in range(len(fields))]
    return chunks.select(F.col(key).alias("k"), "job_id", *[words(F.col(c)).alias(n) for c, n in zip(fields, names)]).select(F.col("k").alias(key), "job_id", _length(names).alias("dl"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: n and the average length of rows (dl)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def scan(chunks: DataFrame, fields: dict[str, float], few: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, totals) for a few words, in one pass over the texts whose result is written to the shared folder.

    A row is left for each chunk, with its length and the places of these words alone; hits are its postings.
    """
    names = [f"w{i}" for i in range(len(fields))]
    place = lambda f: lambda t, i: F.struct(F.lit(f).alias("field"), t.alias("term"), i.alias("at"))
    found = [F.filter(F.transform(n, place(f)), lambda s: s["term"].isin(few)) for f, n in enumerate(names)]
    split = chunks.select(F.col(key).alias("k"), *[words(F.col(c)).alias(n) for c, n in zip(fields, names)])
    rows = keep(split.select(F.col("k").alias(key), _length(names).alias("dl"), F.concat(*found).alias("found")))
    hits = rows.select(key, "dl", F.inline("found")).groupBy(key, "field", "term").agg(F.first("dl").alias("dl"), F.sort_array(F.collect_list("at")).alias("positions"))
    return hits, totals(rows)


def match(hits: DataFrame, asked: DataFrame, weights: list[float], key: str = "chunk_id") -> DataFrame:
    """key, phrase, tf, dl of the chunks in which a phrase stands, for hits (key, dl, field, term, positions).

    The positions of a phrase's second word are moved by one, of its third by two, and so on; the phrase starts at the
    places that all lists then share.
    """
    each = asked.select("phrase", "tokens").dropDuplicates(["phrase"]).select("phrase", F.size("tokens").alias("k"), F.posexplode("tokens").alias("off", "term"))
    each = F.broadcast(each) if asked.limit(FEW_PHRASES + 1).count() <= FEW_PHRASES else each
    moved = hits.join(each, "term").select(key, "dl", "field", "phrase", "k", F.transform("positions", lambda p: p - F.col("off")).alias("at"))
    lists = moved.groupBy(key, "field", "phrase").agg(F.first("dl").alias("dl"), F.first("k").alias("k"), F.collect_list("at").alias("lists")).where(F.size("lists") == F.col("k"))
    common = F.reduce(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
    weight = F.get(F.array(*map(F.lit, weights)), F.col("field"))
    rows = lists.select(key, "dl", "phrase", (F.size(common) * weight).alias("tf")).where("tf > 0")
    return rows.groupBy(key, "phrase").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def score(found: DataFrame, total: DataFrame, asked: DataFrame, key: str = "chunk_id", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, key, score from match()'s rows and the one row of totals()."""
    df = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = found.join(df.join(total), "phrase").select(key, "phrase", weight.alias("w"))
    return scored.join(asked.select("query_id", "phrase"), "phrase").groupBy("query_id", key).agg(F.sum("w").alias("score"))


def bm25(chunks: DataFrame, fields: dict[str, float], terms: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score for terms (query_id, term) without an index; chunks in which any of a query's terms stands.

    The texts are read once; if the terms have more than FEW_WORDS words, all postings are made and joined.
    """
    asked = phrases(terms)
    few = [r["t"] for r in asked.select(F.explode("tokens").alias("t")).distinct().limit(FEW_WORDS + 1).collect()]
    if len(few) > FEW_WORDS:
        rows = chunks if "job_id" in chunks.columns else chunks.withColumn("job_id", F.lit(None).cast("string"))
        hits, total = postings(rows, fields, key), totals(lengths(rows, fields, key))
    else:
        hits, total = scan(chunks, fields, few, key)
    return score(keep(match(hits, asked, list(fields.values()), key)), total, asked, key)


@dataclass(frozen=True)
class Segment:
    """Postings and lengths of the chunks that one repair has brought, sorted by term; rows counts the lengths."""

    number: int
    postings: DataFrame
    lengths: DataFrame
    rows: int


class Index:
    """An index of chunks (chunk_id, job_id and FIELDS) as segments that are written once.

    A repair writes a segment with the touched jobs' chunks and notes the jobs as dead in all older ones; searches read the
    asked terms of every segment, leave dead jobs out and rank by what is alive. Beyond SEGMENTS, the segments that
    together are no larger than the largest are merged into one, or all if there is none such, without their
    dead. `totals` holds the live number and average length, so a question reads no lengths.
    """

    def __init__(self, spark: SparkSession, fields: dict[str, float] = FIELDS):
        self.spark, self.fields = spark, fields
        self.segments: list[Segment] = []
        self.dead = spark.createDataFrame([], "job_id string, segment int")
        self.totals = totals(spark.createDataFrame([], "dl int"))
        self._next = 0

    def _cut(self, chunks: DataFrame) -> Segment:
        # the texts are read once: sorting by ranges reads what it sorts again for each of its samples
        rows = keep(postings(chunks, self.fields, sizes=True))
        return self._write(rows.where("term is not null"), rows.where("term is null").select("chunk_id", "job_id", "dl"))

    def _write(self, postings: DataFrame, lengths: DataFrame) -> Segment:
        # files of neighbouring terms: a scan's term filter skips files; a frequent term is split by chunk
        rows = keep(postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"))
        own = keep(lengths)
        out = Segment(self._next, rows, own, own.count())
        self._next += 1
        return out

    def repair(self, chunks: DataFrame, touched: DataFrame) -> Index:
        """The index after the touched jobs (job_id) have these chunks and no others."""
        dead = touched.select("job_id").distinct()
        older = [self.dead, *[dead.select("job_id", F.lit(s.number).alias("segment")) for s in self.segments]]
        self.dead = keep(reduce(DataFrame.unionByName, older).distinct())
        new = self._cut(chunks)
        self.segments = [*self.segments, new]
        if len(self.segments) > SEGMENTS:
            self._merge()
        self.totals = keep(totals(self._live("lengths")))
        return self

    def _live(self, part: str, segments: list[Segment] | None = None) -> DataFrame:
        """Rows of the live jobs, with their segment."""
        chosen = self.segments if segments is None else segments
        rows = reduce(DataFrame.unionByName, [getattr(s, part).withColumn("segment", F.lit(s.number)) for s in chosen])
        return rows.join(self.dead, ["job_id", "segment"], "left_anti")

    def _merge(self) -> None:
        *small, largest = sorted(self.segments, key=lambda s: s.rows)
        stays = [largest] if sum(s.rows for s in small) <= largest.rows else []
        merged = [s for s in self.segments if s not in stays]
        new = self._write(self._live("postings", merged).drop("segment"), self._live("lengths", merged).drop("segment"))
        self.segments = [*stays, new]
        self.dead = keep(self.dead.where(F.col("segment").isin([s.number for s in stays])))

    def search(self, terms: list[str] | DataFrame) -> DataFrame:
        """query_id, chunk_id, score for terms (query_id, term), or one question's terms with query_id 1."""
        if not isinstance(terms, DataFrame):
            terms = self.spark.createDataFrame([(1, t) for t in terms], "query_id int, term string")
        asked = phrases(terms)
        if not self.segments:
            return asked.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"))
        few = [r["t"] for r in asked.select(F.explode("tokens").alias("t")).distinct().limit(FEW_WORDS + 1).collect()]
        of_terms = [Segment(s.number, s.postings.where(F.col("term").isin(few)), s.lengths, s.rows) for s in self.segments] if len(few) <= FEW_WORDS else self.segments
        return score(match(self._live("postings", of_terms), asked, list(self.fields.values())), self.totals, asked)

    def save(self, path: str) -> None:
        for s in self.segments:
            s.postings.write.mode("errorifexists").parquet(f"{path}/postings/segment={s.number}")
            s.lengths.write.mode("errorifexists").parquet(f"{path}/lengths/segment={s.number}")
        rows = [(s.number, s.rows) for s in self.segments]
        self.spark.createDataFrame(rows, "segment int, n_rows int").write.mode("errorifexists").parquet(f"{path}/segments")
        self.dead.write.mode("errorifexists").parquet(f"{path}/dead")
        self.totals.write.mode("errorifexists").parquet(f"{path}/totals")

    @staticmethod
    def load(spark: SparkSession, path: str, fields: dict[str, float] = FIELDS) -> Index:
        out, read = Index(spark, fields), spark.read.parquet
        for r in read(f"{path}/segments").orderBy("segment").collect():
            n = r["segment"]
            out.segments.append(Segment(n, read(f"{path}/postings/segment={n}"), read(f"{path}/lengths/segment={n}"), r["n_rows"]))
            out._next = n + 1
        out.dead, out.totals = read(f"{path}/dead"), read(f"{path}/totals")
        return out
