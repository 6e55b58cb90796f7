"""Exact quantiles of many groups at once, none of which has to fit into a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import keep


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """keys and a column for each of probs (name -> quantile, 0 to 1), interpolated between neighbours as usual.

    1. Equal values of a group become one row with their number, within tasks first.
    2. These rows are sorted by ranges of (keys, value) and written; a large group spreads over many ranges. Each range's
       total by group is one short row, and running sums of those say in which ranges the wanted ranks lie.
    3. Only there are values counted up to the wanted rank: a window over one group in one range.

    Nulls do not count; a group with nulls alone has null quantiles; without keys the result is one row, also for an
    empty table.
    """
    names = [f"q_key{i}" for i in range(len(keys))]
    own = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("q_value"))
    counted = own.where("q_value is not null").groupBy(*names, "q_value").agg(F.count(F.lit(1)).alias("q_n"))
    ranged = keep(counted.repartitionByRange(*names, "q_value").withColumn("q_part", F.spark_partition_id()))
    sums = ranged.groupBy(*names, "q_part").agg(F.sum("q_n").alias("q_sum"))
    of_group = Window.partitionBy(*names)
    so_far = F.coalesce(F.sum("q_sum").over(of_group.orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"q_before": so_far, "q_total": F.sum("q_sum").over(of_group)})
    at = lambda p: F.lit(float(p)) * (F.col("q_total") - 1)
    wanted = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(p)), F.ceil(at(p))) for p in probs.values()]))))
    targets = sums.select(*names, "q_part", "q_before", "q_total", wanted.alias("q_rank")).where("q_rank >= q_before and q_rank < q_before + q_sum")
    targets = keep(targets.groupBy(*names, "q_part", "q_before", "q_total").agg(F.collect_list("q_rank").alias("q_ranks")))
    inside = [*names, "q_part"]
    upto = F.sum("q_n").over(Window.partitionBy(*inside).orderBy("q_value"))
    same = [ranged[c].eqNullSafe(targets[c]) for c in inside]
    near = ranged.join(targets, same).select(*[ranged[c] for c in inside], "q_value", "q_n", "q_before", "q_total", "q_ranks").withColumn("q_end", F.col("q_before") + upto)
    hit = near.select(*names, "q_value", "q_n", "q_end", "q_total", F.explode("q_ranks").alias("q_rank")).where("q_rank < q_end and q_rank >= q_end - q_n")
    found = hit.groupBy(*names).agg(F.first("q_total").alias("q_total"), F.map_from_entries(F.collect_list(F.struct("q_rank", "q_value"))).alias("q_at"))

    def quantile(p: float):
        low, high = F.floor(at(p)), F.ceil(at(p))
        return F.col("q_at")[low] + (F.col("q_at")[high] - F.col("q_at")[low]) * (at(p) - low)

    found = found.select(*names, *[quantile(p).alias(n) for n, p in probs.items()])
    if not keys:
        return found
    groups = own.select(*names).distinct()
    out = groups.join(found, [groups[n].eqNullSafe(found[n]) for n in names], "left")
    return out.select(*[groups[n].alias(k) for k, n in zip(keys, names)], *probs)
