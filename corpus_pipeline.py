"""The corpus pipeline: each stage reads the documents that the stage before has written.

1. Language identification drops documents whose language it rejects.
2. Line dedup takes repeated lines out of the texts and drops documents left without a word by that.
3. The n-gram Jaccard join keeps one document of each group of near-duplicates.
4. Benchmark decontamination drops documents that hold a benchmark item.
5. Byte-level BPE encodes the texts and decodes the ids again.

All but the last return the columns of documents; n_chars follows the text.

Defined results: null texts and texts without a letter go in the first stage, with or without an id; where no document
has a language to learn from, nothing can be rejected and all rows go on. Of texts that repeat under several ids the
least id stays; rows that share an id are one document and stay or go together, as do rows without an id. Very long texts are read whole. Other columns are carried along as they are, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, decontaminate, jaccard, langid, linededup
from tarn.llm.common import documents, held_out, keep


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter have none."""
    model = langid.fit(docs.where(~held_out(4, 2)))
    return langid.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; n_chars is counted anew."""
    out = linededup.dedup(docs)
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    return jaccard.representatives(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("byte_bpe", encode_bpe),
]

#: SQL has neither the centroids nor the merges; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each other stage returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
