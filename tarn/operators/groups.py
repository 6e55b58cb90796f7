"""Connected components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import keep


def components(links: DataFrame, node: str, via: str) -> DataFrame:
    """node, component: the least node that can be reached over shared values of `via`, for links (node, via).

    Each round gives a node the least label over the values that it shares and then that label's own label, so long
    chains halve; a round is written to the shared folder, and the last is the one that changes no label.
    Rows without a node or a value are left out.
    """
    edges = keep(links.select(F.col(node).alias("node"), F.col(via).alias("via")).dropna().distinct())
    labels = edges.select("node", F.col("node").alias("label")).distinct()
    while True:
        low = edges.join(labels, "node").groupBy("via").agg(F.min("label").alias("low"))
        near = edges.join(low, "via").groupBy("node").agg(F.min("low").alias("near"))
        of_label = near.select(F.col("node").alias("near"), F.col("near").alias("far"))
        jumped = near.join(of_label, "near").join(labels, "node").select("node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        labels = keep(jumped)
        moved = labels.where("moved").limit(1).count()
        labels = labels.select("node", "label")
        if not moved:
            return labels.select(F.col("node").alias(node), F.col("label").alias("component"))


def grouped(rows: DataFrame, node: str, via: str) -> DataFrame:
    """rows (without null nodes) with component, a number that all rows have in common which shared nodes and values of `via` connect.

    It is worked out on 64-bit hashes, and first among the values: only those that meet in a node of several values are
    linked, so nothing else takes part in the rounds. Two hashes that are equal by chance give two components one number, no
    more: whoever folds a component must compare the keys themselves.
    """
    own = rows.withColumns({"node_hash": F.xxhash64(node), "via_hash": F.when(F.col(via).isNotNull(), F.xxhash64(via))})
    edges = own.select("node_hash", "via_hash").where("via_hash is not null")
    homes = edges.groupBy("node_hash").agg(F.min("via_hash").alias("home"), F.max("via_hash").alias("last"))
    linked = components(edges.join(homes.where("home <> last").select("node_hash"), "node_hash", "left_semi"), "via_hash", "node_hash")
    # rows without a value go with their node's others
    alone = own.where("via_hash is null").join(homes.select("node_hash", "home"), "node_hash", "left").withColumn("home", F.coalesce("home", "node_hash"))
    placed = own.where("via_hash is not null").withColumn("home", F.col("via_hash")).unionByName(alone)
    out = placed.join(linked.withColumnRenamed("via_hash", "home"), "home", "left")
    return out.select(*rows.columns, F.coalesce("component", "home").alias("component"))
