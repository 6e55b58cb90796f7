"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

A line (a part between line feeds) is the sequence of its words in lower case. A line is dropped
if the same line, or, for lines of min_words words or more, a line within one word edit
(insertion, deletion or substitution) stands earlier; lines are ordered by document id (null
last), by the hash of the document's text where ids are equal, and by place. The earliest line of
any such pair stays unless a still earlier one drops it. Lines without a word never drop.

1. Equal lines are reduced to their first occurrence and number, before the shuffle.
2. Lines within one edit share their first or their last half. Only lines whose half occurs in
   another line go on, and only their words are fetched; no other line can have a partner, so
   none is lost.
3. For each word of such a line, the variant without it becomes a hashed key of the place, of
   the words before it and of those after it (running XORs, so the work is linear in the line),
   and each place of the line itself becomes such a key as well. Equal variants join:
   two deletions are a substitution, a deletion and a line itself an insertion.
4. Each key group is reduced to its earliest members, with which every other member is
   paired. So a large group makes as many pairs as it has lines. Each pair is verified.

min_words is 5 unless stated otherwise: one edit leaves a line of n words 1 - 1 / n of them in common, and
near-duplicates are those of a similarity of 0.8 or more. With 1 the bound holds for all lines; then any two
lines of a word each are within it.

Rows with equal id and text count as one document. Null texts have no lines. An empty table gives an
empty result; names of other columns may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import fresh, keep

#: Words of the shortest line of which one edit leaves a similarity of 0.8.
MIN_WORDS = 5
_BLANKS = " \t\n\x0b\x0c\r"
_ID = ("doc_id", "text_hash")
_LINE = ("h1", "h2")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "pos")


def _odd(text: Column) -> Column:
    """Whether some words of a text are apart by other than one blank or line feed."""
    return text.rlike("[\\t\\x0B\\f\\r]|  ")


def _plain(line: Column, odd: Column) -> Column:
    """The line's words in lower case, joined by one blank."""
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(line)))


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the first and last halves; where n is odd, of both roundings, else two are null."""
    low, high = F.floor(n / 2).cast("int"), F.when(n % 2 == 1, F.floor(n / 2).cast("int") + 1)
    part = lambda size: F.call_function("substring_index", line, F.lit(" "), size)
    keys = [F.xxhash64(F.lit(0), low, part(low)), F.xxhash64(F.lit(1), low, part(-low))]
    return keys + [F.when(high.isNotNull(), F.xxhash64(F.lit(side), high, part(high * sign))) for side, sign in ((0, 1), (1, -1))]


def _lines(docs: DataFrame, halves_from: int | None = None) -> DataFrame:
    """doc_id, text_hash, pos and the identity (h1, h2) of every line that has a word; with halves_from, also the halves of those of so many words."""
    # hashed in a projection of its own, so that it is done once for a text and not for each line
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _odd(F.col("text")).alias("odd"), "text").select(*_ID, "odd", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select(*_ID, "pos", _plain(F.col("line"), F.col("odd")).alias("line")).where("line <> ''")
    rows = rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(71), "line")})
    if halves_from is None:
        return rows.select(*_ID, "pos", *_LINE)
    rows = rows.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    keys = [F.when(F.col("n") >= halves_from, k).alias(f"half{i}") for i, k in enumerate(_halves(F.col("line"), F.col("n")))]
    return rows.select(*_ID, "pos", *_LINE, *keys)


def _distinct(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each different line: identity, first (order), times, and its halves (null below min_words)."""
    halves = [f"half{i}" for i in range(4)]
    lines = _lines(docs, min_words).select(*_LINE, _order().alias("at"), *halves)
    return lines.groupBy(*_LINE).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"), *(F.min(h).alias(h) for h in halves))


def _candidates(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """id, identity and line of the lines of which a half stands in another line too; ids rise as lines come."""
    keys = F.array_compact(F.array(*(f"half{i}" for i in range(4))))
    rows = distinct.where("half0 is not null").select(*_LINE, F.explode(keys).alias("half"))
    shared = rows.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("half")
    some = rows.join(shared, "half", "left_semi").select(*_LINE).distinct()
    where = distinct.select(*_LINE, "first").join(some, list(_LINE), "left_semi")
    where = where.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")).agg(F.collect_list(F.struct("first", *_LINE)).alias("xs"))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text")
    at = texts.join(where, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    at = at.withColumn("lines", F.split("text", "\n")).select("lines", F.explode("xs").alias("x"))
    found = at.select("x.first", "x.h1", "x.h2", _plain(F.get("lines", F.col("x.first.pos")), F.lit(True)).alias("line"))
    # sorted by ranges, so that the ids of later partitions are larger; equal rows of docs share a line
    return found.dropDuplicates(list(_LINE)).orderBy("first").select(F.monotonically_increasing_id().alias("id"), *_LINE, "line")


def _variants(lines: DataFrame) -> DataFrame:
    """key, removed (a variant, or the line itself), i and id for each place of each line.

    Before place i the words count from the start, after it from the end, so that the keys of
    lines of different length agree.
    """
    from pyspark.sql import Window

    group = Window.partitionBy("id")
    before = group.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    split = lines.select("id", F.split("line", " ").alias("w")).repartition("id")
    words = split.select("id", F.size("w").alias("n"), F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("i", "word"))
    zero = F.lit(0).cast("long")
    real = F.col("word").isNotNull()
    head = F.when(real, F.xxhash64(F.lit(1), "i", "word")).otherwise(zero)
    tail = F.when(real, F.xxhash64(F.lit(2), F.col("n") - F.col("i"), "word")).otherwise(zero)
    marked = words.select("id", "i", "n", real.alias("real"), head.alias("head"), tail.alias("tail"))
    after = F.bit_xor("tail").over(group).bitwiseXOR(F.coalesce(F.bit_xor("tail").over(before), zero))
    sums = marked.select("id", "i", "n", "real", "tail", F.coalesce(F.bit_xor("head").over(before), zero).alias("p"), after.alias("s"))
    own = F.struct(F.lit(False).alias("removed"), F.xxhash64("i", "n", "p", "s").alias("key"))
    cut = F.struct(F.lit(True).alias("removed"), F.xxhash64("i", F.col("n") - 1, "p", F.col("s").bitwiseXOR(F.col("tail"))).alias("key"))
    return sums.select("id", "i", F.inline(F.when(F.col("real"), F.array(own, cut)).otherwise(F.array(own))))


def _near(some: DataFrame) -> DataFrame:
    """Identities of candidate lines that an earlier line within one edit drops."""
    places = keep(_variants(some))
    least = lambda removed: F.min(F.when(F.col("removed") == removed, F.col("id")))
    groups = places.groupBy("key").agg(least(True).alias("cut"), least(False).alias("own"), F.max("id").alias("last")).where("cut is not null and least(cut, own) < last")
    # written, a few numbers for each key, so that the join has an exchange of its own on both sides: then Spark splits the places of a key that very many lines share
    groups = keep(groups)
    partner = F.when(F.col("removed"), F.least("cut", "own")).otherwise(F.col("cut"))
    pairs = places.join(groups, "key").select("id", partner.alias("to"), "i").where("to < id")
    best = pairs.groupBy("id").agg(F.min(F.struct("to", "i")).alias("to")).select("id", "to.to", "to.i")
    own = some.select("id", *_LINE, F.split("line", " ").alias("a"))
    other = some.select(F.col("id").alias("to"), F.split("line", " ").alias("b"))
    both = best.join(own, "id").join(other, "to")

    def without(x: str) -> Column:
        return F.concat(F.slice(x, F.lit(1), F.col("i")), F.slice(x, F.col("i") + 2, F.size(x)))

    longest = F.greatest(F.size("a"), F.size("b"))
    a = F.when(F.size("a") == longest, without("a")).otherwise(F.col("a"))
    b = F.when(F.size("b") == longest, without("b")).otherwise(F.col("b"))
    return both.where((F.abs(F.size("a") - F.size("b")) <= 1) & (a == b)).select(*_LINE).distinct()


def dropped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, pos, near: every line to drop; near is false where the same line stands earlier."""
    distinct = keep(_distinct(docs, min_words))
    near = _near(keep(_candidates(docs, distinct))).withColumn("near", F.lit(True))
    # written, so that the join reads both sides by an exchange of its own: then Spark splits the lines that stand in very many texts
    status = keep(distinct.select(*_LINE, "first", "times").join(near, list(_LINE), "left").where("times > 1 or near").select(*_LINE, "first", F.coalesce("near", F.lit(False)).alias("near")))
    hit = _lines(docs).join(status, list(_LINE))
    return hit.where(F.col("near") | (_order() > F.col("first"))).select(*_ID, "pos", (F.col("near") & (_order() == F.col("first"))).alias("near"))


def _by_document(docs: DataFrame, min_words: int) -> DataFrame:
    gone = dropped(docs, min_words).groupBy(*_ID).agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("pos", "near")))).alias("x"))
    return gone.select(*_ID, F.size("x").cast("long").alias("n_dropped"), F.size(F.filter("x", lambda y: y["near"])).cast("long").alias("n_near"), F.transform("x", lambda y: y["pos"]).alias("gone"))


def _keyed(docs: DataFrame, gone: DataFrame, key: Column) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of gone beside them, and the names of those, which are no names of docs."""
    names = {c: fresh(docs, f"line_{c}") for c in gone.columns}
    g = gone.select(*[F.col(c).alias(n) for c, n in names.items()])
    return docs.join(g, F.col("doc_id").cast("long").eqNullSafe(F.col(names["doc_id"])) & (key == F.col(names["text_hash"])), "left"), names


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near and gone (places of the dropped lines) for each row of docs."""
    # what is needed of a text is taken before the join, so that no text is shuffled for it
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.size(F.split("text", "\n")).cast("long"), F.lit(0)).alias("n_lines"))
    rows, of = _keyed(own, _by_document(docs, min_words), F.col("text_key"))
    dropped_, near, gone = F.col(of["n_dropped"]), F.col(of["n_near"]), F.col(of["gone"])
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n_lines", F.coalesce(dropped_ - near, zero).alias("n_exact"), F.coalesce(near, zero).alias("n_near"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the dropped lines taken out of text; rows left without a word by that are gone."""
    rows, of = _keyed(docs, _by_document(docs, min_words), F.xxhash64("text"))
    gone, all_, left_text = of["gone"], fresh(rows, "line_all"), fresh(rows, "line_text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), x.alias("line")))
    marks = F.transform(gone, lambda p: F.struct(p.alias("i"), F.lit(0).alias("kind"), F.lit("").alias("line")))
    rows = rows.withColumn(all_, F.when(F.col(gone).isNotNull(), F.array_sort(F.concat(marks, lines))))
    left = F.filter(all_, lambda x, i: (x["kind"] == 1) & ((i == 0) | (F.get(F.col(all_), i - 1)["kind"] == 1)))
    rows = rows.withColumn(left_text, F.when(F.col(all_).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n")))
    rows = rows.where(F.col(all_).isNull() | F.col(left_text).rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return rows.select(*[F.col(left_text).alias("text") if c == "text" else F.col(c) for c in docs.columns])
