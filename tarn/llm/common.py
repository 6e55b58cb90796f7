"""What the operators share: reading documents, and batch functions over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tarn.session import keep, small_batches

__all__ = ["bounded_sample", "documents", "fresh", "held_out", "keep", "map_rows", "per_worker", "small_batches"]


#: Rows that map_rows turns into Python objects at once.
ROWS = 1000


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _array(values, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        names = [f.name for f in kind.value_type]
        values = [None if v is None else [dict(zip(names, x)) for x in v] for v in values]
    return pa.array(values, kind)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row for each row of df, in Arrow batches.

    make() runs once for each Python worker task and returns a function of df's columns in
    order; the tuple it returns has the columns of schema. Executors hold one batch at a time.
    """
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, max(1, b.num_rows), ROWS)):
            out = [row(*x) for x in zip(*(c.to_pylist() for c in batch.columns))]
            cols = list(zip(*out)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([_array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return small_batches(df).mapInArrow(run, struct)


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id"):
    """True for the rows that a model must not learn from: crc32 of the id's decimal text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Different labels that a sample may hold.
LABELS = 10_000


def bounded_sample(df: DataFrame, label: str, per_label: int, total: int, key: str = "doc_id", also: str | None = None) -> DataFrame:
    """Rows with a label, about per_label of each value and never more than total rows.

    Which rows are taken follows from a hash of their key alone, or of the column `also` where they have no key, so a
    rerun takes the same. Labels
    are counted first (beyond LABELS values, the documented bound, the rarest are left out), and rows of
    a value are taken at the rate that its count asks for, all where there are few. Many values share
    nine tenths of total equally, so chance does not reach total; only very many rows of one key could,
    and then those of the least hash stand.
    """
    rate, draw = fresh(df, "sample_rate"), fresh(df, "sample_draw")
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(LABELS)
    kinds = counts.count()
    if not kinds:
        return df.limit(0)
    each = min(per_label, 0.9 * total / kinds)
    # at most LABELS short rows, so they may go to every task
    rates = counts.select(F.col(label).alias(f"{rate}_of"), F.least(F.lit(1.0), each / F.col("count")).alias(rate))
    mark = F.xxhash64(F.col(key), F.lit("sample"))
    mark = F.when(F.col(key).isNull(), F.xxhash64(F.col(also), F.lit("sample"))).otherwise(mark) if also else mark
    own = df.join(F.broadcast(rates), F.col(label) == F.col(f"{rate}_of")).withColumn(draw, F.pmod(mark, F.lit(1_000_003)) / 1_000_003)
    return own.where(F.col(draw) < F.col(rate)).orderBy(draw, key).limit(total).select(*df.columns)


def per_worker(key: tuple, build: Callable[[], object]) -> object:
    """What build() returned when this Python worker last asked for key; workers outlive tasks.

    Of each kind, key[0], the last value is kept.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_tarn_per_worker", types.ModuleType("_tarn_per_worker")).__dict__
    if kept.get(key[0], (None,))[0] != key:
        kept[key[0]] = None
        kept[key[0]] = (key, build())
    return kept[key[0]][1]
