"""Incremental intake of landed postings: `python -m jobs.posting_intake LANDED OUT [--config FILE]`.

LANDED is a path or pattern of files that a collector adds to. Each run takes the files that no run has taken yet, in
batches, and ends. A posting is known by its fingerprint or its URL on its board; of a batch, the rows that bring a new
or changed posting go on, and only those postings are cut into chunks anew.

    OUT/versions/batch=N/source=S   what each batch founded or changed, a row for each version
    OUT/chunks/batch=N/source=S     the chunks of the postings' last versions in that batch
    OUT/_checkpoint                 which files belong to which batch

A batch reads only what the batches before it have written and replaces its own folders whole, so one that failed
half-way, or is repeated after a lost driver, leaves the same files; a run without new files writes nothing. The
checkpoint belongs to OUT: remove both or none. Postings as they stand are `current(spark, OUT)`.

Rows without any text, title or place are postings as well (their title is `Untitled`) but have no chunk; an empty
table makes a batch without rows; repeated rows are unchanged postings; columns that the config does not name are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import counted, log, main
from tarn.operators import chunking, ingest
from tarn.session import keep
from tarn.streaming import flows

VERSIONS = "job_id string, fingerprint string, source_job_id string, title string, company string, location string, job_type string, job_url string, date_posted date, content_hash string, change string, nth long, n_chars long, batch long, source string"
CHUNKS = "job_id string, piece int, content string, content_hash string, batch long, source string"


def versions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(VERSIONS).parquet(f"{out}/versions")


def chunks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{out}/chunks")


def latest(rows: DataFrame) -> DataFrame:
    """The last version of each posting, with the number of its versions."""
    rest = [c for c in rows.columns if c != "job_id"]
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct("batch", "nth")).alias("v"), F.count(F.lit(1)).alias("n_versions"))
    return last.select("job_id", "v.*", "n_versions")


def current(spark: SparkSession, out: str) -> DataFrame:
    """A row for each chunk of each posting as it stands; a posting without text has one row without a chunk."""
    own = latest(versions(spark, out)).drop("content_hash")
    pieces = chunks(spark, out).select("job_id", "batch", "piece", "content", "content_hash")
    return own.join(pieces, ["job_id", "batch"], "left")


def take(spark: SparkSession, landed: DataFrame, number: int, out: str, conf: dict) -> None:
    """Writes what batch `number` founds or changes against the batches before it."""
    raw, read = counted(landed.select(*[F.expr(e).alias(n) for n, e in conf["columns"].items()]))
    rows = keep(ingest.canonical(raw))
    known = versions(spark, out).where(F.col("batch") < number) if number else spark.createDataFrame([], VERSIONS)
    before = latest(known.select("job_id", "fingerprint", "source", "job_url", "content_hash", "batch", "nth"))
    changes = ingest.decide(before.withColumn("is_active", F.lit(True)), rows).where("change <> 'unchanged'")
    # a posting keeps the fingerprint that founded it, which is not always that of the row
    founded = changes.where("change = 'inserted'").select("job_id", F.col("fingerprint").alias("founder"))
    founder = before.select("job_id", F.col("fingerprint").alias("founder")).join(changes.select("job_id").distinct(), "job_id", "left_semi").unionByName(founded)
    # who founded it and what came last is settled on narrow rows; only the texts that are cut move, once to meet them
    told = changes.withColumn("row", ingest.row_key()).select("job_id", "change", F.col("step").alias("nth"), "row").join(founder.withColumnRenamed("founder", "fingerprint"), "job_id")
    told = keep(told.withColumn("is_last", F.col("nth") == F.max("nth").over(Window.partitionBy("job_id"))))
    url = F.when(F.col("job_url") != "", F.concat_ws("\n", "source", "job_url"))
    keyed = rows.withColumn("url", url).withColumn("row", ingest.row_key()).withColumn("n_chars", F.coalesce(F.length("description"), F.lit(0)).cast("long"))
    found = told.join(keyed.drop("url", "fingerprint", "description").dropDuplicates(["row"]), "row")

    spread = [F.col("source"), F.pmod(F.xxhash64("job_id"), F.lit(conf["files_per_source"]))]
    names = [f.name for f in spark.createDataFrame([], VERSIONS).schema if f.name != "batch"]
    new, wrote = counted(found.select(*names).repartition(*spread), changed=F.count_if(F.col("change") == "updated"))
    new.write.mode("overwrite").partitionBy("source").parquet(f"{out}/versions/batch={number}")
    texts = told.where("is_last").select("row", "job_id").join(keyed.where("description <> ''").select("row", "source", "description").dropDuplicates(["row"]), "row")
    pieces = texts.select("job_id", "source", F.posexplode(chunking.stride(F.col("description"), conf["chunk_chars"], conf["chunk_overlap"])).alias("piece", "content"))
    cut, cuts = counted(pieces.withColumn("content_hash", F.sha2("content", 256)).repartition(*spread))
    cut.write.mode("overwrite").partitionBy("source").parquet(f"{out}/chunks/batch={number}")
    log.info("batch %s: read %s rows, wrote %s versions (%s of known postings) and %s chunks", number, read.get["rows"], wrote.get["rows"], wrote.get["changed"], cuts.get["rows"])


def run(spark: SparkSession, landed: str, out: str, conf: dict) -> None:
    """Takes the files of landed that are new, and ends."""
    schema = conf["schema"] or spark.read.format(conf["format"]).load(landed).schema
    stream = flows.read_files(spark, landed, schema, conf["files_per_batch"], conf["format"])
    done = flows.run_available(stream, lambda batch, number: take(spark, batch, number, out, conf), f"{out}/_checkpoint")
    done.awaitTermination()
    log.info("%s: %s batches, %s rows read, from %s", out, len(done.recentProgress), sum(p["numInputRows"] for p in done.recentProgress), landed)


if __name__ == "__main__":
    main("posting_intake", "Takes new files of postings into versions and chunks.", run, "landed", "out")
