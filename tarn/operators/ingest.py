"""Records to jobs: canonical rows, upsert with history, expiry."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import scalar as S
from tarn.operators.filters import stale
from tarn.operators.groups import grouped
from tarn.session import keep

# The fields whose change makes a new version.
CONTENT = ("title", "company", "location", "description", "job_type", "min_amount", "max_amount", "currency", "interval", "is_remote", "date_posted", "skills", "experience_range")


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def canonical(raw: DataFrame) -> DataFrame:
    """Raw records as job rows: defaults, nulls for blanks, canonical URL, fingerprint, content hash and arrival.

    arrival orders the rows of a batch: the column of that name, else the order in which they are read.
    """
    c = lambda n: _col(raw, n)
    blank = lambda n: S.empty_to_null(c(n).cast("string"))
    return raw.select(
        S.fingerprint(*[c(n).cast("string") for n in ("site", "id", "job_url", "title", "company", "location")]).alias("fingerprint"),
        F.coalesce(blank("site"), F.lit("unknown")).alias("source"),
        blank("id").alias("source_job_id"),
        F.coalesce(blank("title"), F.lit("Untitled")).alias("title"),
        F.lower(F.coalesce(blank("title"), F.lit("untitled"))).alias("normalized_title"),
        *[blank(n).alias(n) for n in ("company", "location", "job_type", "currency", "interval", "job_url_direct")],
        c("min_amount").try_cast("double").alias("min_amount"),
        c("max_amount").try_cast("double").alias("max_amount"),
        c("is_remote").try_cast("boolean").alias("is_remote"),
        c("description").alias("description"),
        S.canonical_url(c("job_url")).alias("job_url"),
        S.iso_date(c("date_posted").cast("string")).alias("date_posted"),
        S.content_hash(*[c(n).cast("string") for n in CONTENT]).alias("content_hash"),
        (F.coalesce(F.col("arrival").cast("long"), F.monotonically_increasing_id()) if "arrival" in raw.columns else F.monotonically_increasing_id()).alias("arrival"),
    )


def packed(c: str) -> Column:
    """A text as bytes, led by 1 and in half the bytes if it is a SHA-256 in lower-case hex, else led by 0."""
    return F.when(F.col(c).rlike("\\A[0-9a-f]{64}\\z"), F.concat(F.lit(b"\1"), F.unhex(c))).otherwise(F.concat(F.lit(b"\0"), F.encode(c, "utf-8"))).alias(c)


def unpacked(c: str) -> Column:
    rest = F.expr(f"substring({c}, 2)")
    return F.when(F.substring(c, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8")).alias(c)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each row does, for rows (component, arrival, fingerprint, url, content_hash, job_id, is_active) sorted by component
    with its stored jobs, which have a job_id, first; fingerprint and content_hash are packed.

    The rows are streamed: only the jobs of the component that is being folded are held, by fingerprint and by
    current URL. A URL's jobs are a heap from which those that have moved away are taken when they come up.
    """
    names = ["fingerprint", "url", "arrival", "content_hash", "job_id", "change", "reactivated", "step"]
    at, jobs, prints, urls, step = None, {}, {}, {}, 0
    for batch in batches:
        out = []
        for component, arrival, fingerprint, url, content, job_id, active in zip(*(c.to_pylist() for c in batch.columns)):
            if component != at:
                at, jobs, prints, urls, step = component, {}, {}, {}, 0
            row = None if job_id else (fingerprint, url, arrival, content)
            if row:
                job_id = prints.get(fingerprint)
                held = urls.get(url, [])
                while held and jobs[held[0]][0] != url:
                    heapq.heappop(held)
                job_id = job_id or (held[0] if held else None)
                was = jobs.get(job_id)
                job_id = job_id or (fingerprint[1:].hex() if fingerprint[0] else fingerprint[1:].decode())[:32]
                change = "inserted" if not was else "unchanged" if was[1] == content else "updated"
                out.append((*row, job_id, change, bool(was) and not was[2], step))
                step += 1
                if change == "unchanged":
                    url, content = was[:2]
                active = True
                if not was:
                    prints[fingerprint] = job_id
            else:
                was = None
                prints[fingerprint] = job_id
            if url and (not was or was[0] != url):
                heapq.heappush(urls.setdefault(url, []), job_id)
            jobs[job_id] = (url, content, active)
        cols = list(zip(*out)) or [()] * len(names)
        kinds = (pa.binary(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def decide(jobs: DataFrame, batch: DataFrame) -> DataFrame:
    """fingerprint, url, arrival, content_hash, job_id, change, reactivated, step: one row for each row of batch, written to the shared folder.

    Rows are taken one after the other, by arrival: a row is the job with its fingerprint, else the job that has its
    source and URL at that time (of several the least job_id), else a new one. An updated job moves to the row's URL, an unchanged
    one stays where it is. Rows and stored jobs that are connected by fingerprints and URLs are folded together, in the
    order of their steps; narrow columns of the batch and of the stored jobs are all that is moved, once to meet their
    group's number, where URLs are linked at all, and once to the fold.
    """
    url = F.when(F.col("job_url") != "", F.concat_ws("\n", "source", "job_url")).alias("url")
    rows = batch.select(packed("fingerprint"), url, F.col("arrival").cast("long").alias("arrival"), packed("content_hash"), F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("boolean").alias("is_active"))
    known = jobs.select(packed("fingerprint"), url, F.lit(None).cast("long").alias("arrival"), packed("content_hash"), "job_id", "is_active")
    placed = grouped(keep(rows.unionByName(known)), "fingerprint", "url")
    order = placed.select("component", "arrival", "fingerprint", "url", "content_hash", "job_id", "is_active").repartition("component")
    order = order.sortWithinPartitions("component", F.asc_nulls_last("job_id"), "arrival", "fingerprint", "content_hash", "url")
    done = keep(order.mapInArrow(_fold, "fingerprint binary, url string, arrival long, content_hash binary, job_id string, change string, reactivated boolean, step long"))
    return done.withColumns({c: unpacked(c) for c in ("fingerprint", "content_hash")})


def row_key() -> Column:
    """The identity of a batch's row, by what decide() gives of it: fingerprint, arrival, content_hash and url, in 16 bytes."""
    return F.unhex(F.md5(F.concat_ws("\n", "fingerprint", F.col("arrival").cast("string"), "content_hash", "url")))


def upsert(jobs: DataFrame, snapshots: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, snapshots, changes) after a batch of canonical rows, taken one after the other in the order of their arrival.

    A job keeps the fingerprint of the row that founded it; its values are those of the last row that founded or
    updated it. Every version that the history has not yet is added to it. changes has a row for each row
    of the batch: job_id, change (inserted, updated, unchanged, each against the job's state before that row) and
    reactivated (the first row of a job that was inactive).
    """
    changes = decide(jobs, batch).withColumn("row", row_key())
    last = changes.groupBy("job_id").agg(F.max_by("row", F.when(F.col("change") != "unchanged", F.col("step"))).alias("row"), F.min_by("fingerprint", "step").alias("founder"))
    own = [c for c in jobs.columns if c not in ("job_id", "fingerprint", "first_seen_at", "last_seen_at", "is_active")]
    full = batch.withColumn("url", F.when(F.col("job_url") != "", F.concat_ws("\n", "source", "job_url"))).withColumn("row", row_key()).drop("url").dropDuplicates(["row"])
    values = full.join(last.where("row is not null").select("row", "job_id"), "row").select("job_id", F.struct(*[F.col(c) for c in own]).alias("new"))
    seen = last.select("job_id", "founder").join(values, "job_id", "left")
    both = jobs.select("job_id", F.struct(*jobs.columns).alias("old")).join(seen, "job_id", "full")
    stays = F.col("founder").isNull()
    out = both.select(
        "job_id",
        F.coalesce("old.fingerprint", "founder").alias("fingerprint"),
        *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in own],
        F.coalesce("old.first_seen_at", now).alias("first_seen_at"),
        F.when(stays, F.col("old.last_seen_at")).otherwise(now).alias("last_seen_at"),
        F.when(stays, F.col("old.is_active")).otherwise(F.lit(True)).alias("is_active"),
    ).select(jobs.columns)
    fresh = changes.where("change <> 'unchanged'").select("job_id", "row", "content_hash").dropDuplicates(["job_id", "content_hash"]).join(snapshots.select("job_id", "content_hash"), ["job_id", "content_hash"], "left_anti")
    versions = fresh.join(full.select("row", "description"), "row").select("job_id", "content_hash", "description", now.alias("created_at"))
    return out, snapshots.unionByName(versions.select(snapshots.columns)), changes.select("job_id", "change", "reactivated")


def to_sync(changes: DataFrame) -> DataFrame:
    """job_id of the jobs whose chunks must be made anew: inserted, updated or reactivated, each once."""
    return changes.where("change <> 'unchanged' or reactivated").select("job_id").distinct()


def counters(changes: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("change") == v).alias(v)
    return changes.agg(F.count(F.lit(1)).alias("received"), n("inserted"), n("updated"), n("unchanged"), F.count_if("reactivated").alias("reactivated"))


def expire(jobs: DataFrame, chunks: DataFrame, as_of: Column, days: int = 60) -> tuple[DataFrame, DataFrame]:
    """Jobs with stale ones inactive, and the chunks of the others."""
    out = jobs.withColumn("is_active", F.col("is_active") & ~stale(as_of, days))
    return out, chunks.join(out.where("not is_active").select("job_id"), "job_id", "left_anti")
