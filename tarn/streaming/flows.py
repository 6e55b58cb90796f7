"""Structured Streaming forms of ingestion and of the request log (an extension: the batch operators are the core)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(events: DataFrame, size: str, late: str = "1 day") -> DataFrame:
    """start, event_type, n, total of tumbling windows; on a stream, events later than `late` are left out."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    """A stream of the files of a folder, or of a pattern of files, in the order in which they came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls step(batch, number) for all files that are there, then ends; a rerun takes only new ones."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
