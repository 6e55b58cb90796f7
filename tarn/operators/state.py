"""State tables without updates in place: caches, logs, schedules, embedding attempts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.filters import attempts_left, pending
from tarn.session import keep


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def cache_get(cache: DataFrame, key: Column | str, kind: str, version: str, now: Column) -> DataFrame:
    """Valid entries: same key, kind and corpus version, not expired; of several the newest."""
    rows = cache.where((F.col("cache_key") == key) & (F.col("kind") == kind) & (F.col("corpus_version") == version) & (F.col("expires_at") > now))
    return rows.orderBy(F.desc("created_at")).limit(1)


def last_write(old: DataFrame, new: DataFrame, *keys: str, by: str = "created_at") -> DataFrame:
    """Both tables' rows; of one key the row with the largest `by` stays, the new one on ties."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc("_new"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def evict(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def prune(log: DataFrame, now: Column, days: int) -> DataFrame:
    """Log rows of the last `days` days, one at least."""
    return log.where(F.col("created_at") >= F.timestamp_add("DAY", F.lit(-max(1, days)), now))


def private(log: DataFrame, query: str = "query") -> DataFrame:
    """Log rows with the query's hash and length instead of its text."""
    return log.withColumns({"query_hash": F.sha2(query, 256), "query_length": F.length(query)}).drop(query)


def claim(runs: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots (scheduled_for) that no run has yet, each once."""
    return slots.select("scheduled_for").distinct().join(runs.select("scheduled_for"), "scheduled_for", "left_anti")


def recover(runs: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Runs that started over `hours` ago and have not ended are failed."""
    lost = (F.col("status") == "running") & (F.col("started_at") < F.timestamp_add("HOUR", F.lit(-hours), now))
    return runs.withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def next_slot(now: Column, zone: str = "Asia/Singapore", hour: int = 9) -> Column:
    """The next daily slot at `hour` in a time zone, as UTC."""
    local = F.from_utc_timestamp(now, zone)
    today = F.timestamp_add("HOUR", F.lit(hour), F.date_trunc("day", local))
    return F.to_utc_timestamp(F.when(today > local, today).otherwise(F.timestamp_add("DAY", F.lit(1), today)), zone)


def embed_pending(chunks: DataFrame, embed, model: str, provider: str, now: Column, most: int = 3, manual: bool = False, order: tuple = ("job_id", "chunk_index"), limit: int | None = None, dims: int | None = None, size: int = 32) -> DataFrame:
    """Chunks with vectors for pending ones of fewer than `most` attempts, at most `limit` of them in order.

    manual takes failed chunks instead, whatever their attempts. embed(texts) returns a vector for each text, of
    `dims` numbers if given; it runs on the executors, once for each batch of at most `size` chunks, in order.

    The first batch that raises, or whose vectors have other sizes, ends the run for all tasks: its rows have
    one more attempt and the error, and all rows after it stay as they were. For that the batches are numbered in order and go to the
    model in waves of 1, 2, 4, ... batches, each of which waits for the verdict on the one before. So a model
    that is down is called once, and one that fails later at most as often again as it had answered. Success clears attempts and error.
    """
    due = pending(model, provider) & attempts_left(manual, most)
    todo = chunks.where(due)
    rest = chunks.where(~due)
    if limit is not None:
        first = todo.select(*order).distinct().orderBy(*order).limit(limit)
        rest = rest.unionByName(todo.join(first, list(order), "left_anti").select(rest.columns))
        todo = todo.join(first, list(order), "left_semi").select(chunks.columns)
    # numbered as sorted: the partition above bit 33, the place in it below
    ordered = keep(todo.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).alias("_part"), F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / size)
    parts = [(r["_part"], r["n"]) for r in ordered.groupBy(part).agg((F.max(place) + 1).alias("n")).orderBy("_part").collect()]
    starts, total = [], 0
    for p, n in parts:
        starts.append((p, total))
        total += n
    if not total:
        return chunks
    # a row for each partition of the sort
    offsets = F.broadcast(chunks.sparkSession.createDataFrame(starts, "_part long, _start long"))
    numbered = ordered.select("_at", "content", part, place.alias("_place")).join(offsets, "_part").select("_at", "content", (F.col("_start") + F.col("_place")).alias("_batch"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, vectors, error = rows.sort_values("_at"), [None] * len(rows), None
        try:
            vectors = [[float(x) for x in v] for v in embed(list(rows["content"]))]
            if len(vectors) != len(rows) or len({len(v) for v in vectors} | ({dims} if dims else set())) > 1:
                raise ValueError("vectors of another number or size than expected")
        except Exception as e:  # what the caller's model raises becomes the row's error
            vectors, error = [None] * len(rows), str(e)[:500] or type(e).__name__
        return pd.DataFrame({"_at": rows["_at"], "_batch": rows["_batch"], "_vector": vectors, "_error": error})

    waves, start, width, failed = [], 0, 1, None
    while start < total and failed is None:
        wave = numbered.where(F.col("_batch").between(start, start + width - 1))
        waves.append(keep(wave.groupBy("_batch").applyInPandas(run, "_at long, _batch long, _vector array<float>, _error string")))
        failed = waves[-1].where("_error is not null").agg(F.min("_batch")).first()[0]
        start, width = start + width, 2 * width
    got = reduce(DataFrame.unionByName, waves)
    got = got if failed is None else got.where(F.col("_batch") <= failed)
    both = ordered.join(got.select("_at", "_vector", "_error"), "_at", "left")
    ok, bad = F.col("_vector").isNotNull(), F.col("_error").isNotNull()
    done = both.withColumns(
        {
            "embedding": F.when(ok, F.col("_vector")).otherwise(F.col("embedding")),
            "embedding_model": F.when(ok, F.lit(model)).otherwise(F.col("embedding_model")),
            "embedding_provider": F.when(ok, F.lit(provider)).otherwise(F.col("embedding_provider")),
            "embedding_attempts": F.when(ok, F.lit(0)).when(bad, F.col("embedding_attempts") + 1).otherwise(F.col("embedding_attempts")),
            "embedding_failed_at": F.when(ok, F.lit(None).cast("timestamp")).when(bad, now).otherwise(F.col("embedding_failed_at")),
            "embedding_error": F.when(ok, F.lit(None).cast("string")).when(bad, F.col("_error")).otherwise(F.col("embedding_error")),
        }
    )
    return rest.unionByName(done.select(chunks.columns))
