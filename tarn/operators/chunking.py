"""Sections and chunks of texts, by window and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import lexicon as L
from tarn.functions import scalar as S

MAX_CHARS, OVERLAP, LONG_GENERAL = 1800, 180, 1200


def sections(docs: DataFrame, key: str = "job_id", text: str = "text", patterns: tuple = L.SECTION_PATTERNS, keep_all: bool = False) -> DataFrame:
    """key, section_no, section_type, body: the typed sections of each text.

    A running count of headings numbers the sections, one of blanks and list items the paragraphs.
    Sections to ignore go, and an unheaded part over LONG_GENERAL characters if some section has a
    heading of its own.
    """
    names = [n for n, _ in patterns]
    rows = docs.select(F.col(key), F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "raw")).withColumn("raw", F.trim("raw"))
    rows = rows.select(key, "pos", F.btrim("raw", F.lit(" #*-•")).alias("line"), S.is_list_item(F.col("raw")).alias("item"))
    rows = rows.withColumn("heading", S.heading_section(F.col("line"), patterns))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.sum(((F.col("line") == "") | F.col("item")).cast("int")).over(order)
    after_item = F.coalesce(F.lag("item").over(Window.partitionBy(key).orderBy("pos")), F.lit(False)).cast("int")
    rows = rows.withColumns({"section_no": F.count("heading").over(order), "opens": F.max(F.when(F.col("heading").isNotNull(), F.struct("pos", "heading"))).over(order)["heading"], "b": breaks, "a": after_item})
    rows = rows.withColumn("paragraph", F.col("b") + F.sum("a").over(order))
    lines = rows.where((F.col("line") != "") & F.col("heading").isNull())
    paragraphs = lines.groupBy(key, "section_no", "paragraph").agg(F.first("opens").alias("opens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = paragraphs.groupBy(key, "section_no").agg(F.coalesce(F.first("opens"), F.lit("general")).alias("section_type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "body"))), lambda x: x["body"]), "\n\n").alias("body"))
    if keep_all:
        return parts
    relevant = [n for n in names if n not in L.IGNORED_SECTIONS]
    headed = F.coalesce(F.max(F.col("section_type").isin(relevant)).over(Window.partitionBy(key)), F.lit(False))
    parts = parts.withColumn("headed", headed).where(~F.col("section_type").isin(*L.IGNORED_SECTIONS))
    return parts.where(~((F.col("section_type") == "general") & F.col("headed") & (F.length("body") > LONG_GENERAL))).drop("headed")


def stride(text: Column, size: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Pieces of `size` characters, each `overlap` before the end of the last."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def pack(text: Column, size: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed up to `size` characters; a new piece starts with the last one's tail.

    A fold over the paragraphs with the finished pieces and the open one as its state.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), F.trim), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        done, open_ = acc["done"], acc["open"]
        closed = F.when(open_ != "", F.concat(done, F.array(open_))).otherwise(done)
        joined = F.trim(F.concat(open_, F.lit("\n\n"), p), F.lit(" \n"))
        tail = F.ltrim(F.substr(open_, F.greatest(F.length(open_) - overlap, F.lit(0)) + 1), F.lit(" \n"))
        fresh = F.trim(F.concat(tail, F.lit("\n\n"), p), F.lit(" \n"))
        return (
            F.when(F.length(p) > size, F.struct(F.concat(closed, stride(p, size, overlap)).alias("done"), F.lit("").alias("open")))
            .when((open_ != "") & (F.length(joined) > size), F.struct(closed.alias("done"), fresh.alias("open")))
            .otherwise(F.struct(done.alias("done"), joined.alias("open")))
        )

    packed = F.aggregate(paragraphs, state, step, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def chunks(jobs: DataFrame, text: str = "description", patterns: tuple = L.SECTION_PATTERNS) -> DataFrame:
    """job_id, chunk_index, section_type, content, content_hash, token_count; equal chunks of a job once."""
    place = F.when(F.col("is_remote"), "remote").when(~F.col("is_remote"), "onsite or unspecified").otherwise("unspecified")
    label = lambda name, c, default: F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(c, F.lit("")), F.lit(default)))
    head = F.concat_ws("\n", label("Job", F.col("title"), ""), label("Company", F.col("company"), "Unknown"), label("Location", F.col("location"), "Unknown"), label("Job type", F.col("job_type"), "Unspecified"), F.concat(F.lit("Work arrangement: "), place))
    parts = sections(jobs, "job_id", text, patterns).select("job_id", "section_no", "section_type", F.posexplode(pack(F.col("body"))).alias("piece", "body"))
    rows = parts.join(jobs.select("job_id", head.alias("head")), "job_id").withColumn("content", F.concat(F.col("head"), F.lit("\nSection: "), F.col("section_type"), F.lit("\n\n"), F.col("body")))
    rows = rows.withColumn("content_hash", F.sha2("content", 256))
    first = F.row_number().over(Window.partitionBy("job_id", "content_hash").orderBy("section_no", "piece"))
    rows = rows.withColumn("n", first).where("n = 1")
    index = F.row_number().over(Window.partitionBy("job_id").orderBy("section_no", "piece")) - 1
    return rows.select("job_id", index.alias("chunk_index"), "section_type", "content", "content_hash", F.greatest(F.lit(1), F.floor(F.length("content") / 4).cast("int")).alias("token_count"))


def resync(old: DataFrame, new: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chunks after a change of `jobs` (job_id): unchanged jobs keep their rows, changed ones get the new.

    A job is unchanged if the digests of its sorted chunk hashes agree; a job without new chunks loses its old.
    """
    digest = lambda df, name: df.groupBy("job_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("content_hash")), "\n"), 256).alias(name))
    seen = jobs.select("job_id").distinct().join(digest(old, "was"), "job_id", "left").join(digest(new, "now"), "job_id", "left")
    changed = seen.where(~F.col("was").eqNullSafe(F.col("now"))).select("job_id")
    return old.join(changed, "job_id", "left_anti").unionByName(new.join(changed, "job_id", "left_semi"), allowMissingColumns=True)
