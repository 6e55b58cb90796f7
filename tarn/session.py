"""The session's shared folder, in which tables are written to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = ""


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the one that the session names for checkpoints.

    Executors and the driver must all reach that folder. Where the setting is absent, a temporary
    folder of this process takes its place on a local master; on a cluster that is an error.
    """
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own = _own or tempfile.mkdtemp(prefix="tarn-")
    return f"{base.rstrip('/')}/tarn-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df; sets Arrow batches of 2,000 rows in its session where Spark's default of 10,000 stands.

    For rows of whole texts or sets, of some KB each and at times far more; an executor holds
    several batches at once, twice over while a buffer grows.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "10000") == "10000":
        conf.set(_BATCH, "2000")
    return df


def keep(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
