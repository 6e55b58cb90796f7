"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import keep

#: Links of one node that meet its label in one task; a node with more is salted.
HEAVY = 20_000


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of links (a, b).

    Every node takes the smallest label among its own, its neighbours' and its label's, until
    nothing changes; the table of labels is written in each round, so lineage stays short.
    Links with a null end and links of a node with itself do not count; an empty table gives an empty
    one. The label of a node with over HEAVY links goes out once for each HEAVY of them, to which the
    links are dealt, so no hub's links meet in one task; nothing comes to the driver but a count.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    degree = F.ceil(F.col("links") / HEAVY)
    edges = keep(both)
    counts = edges.groupBy(F.col("b").alias("hub")).agg(F.count(F.lit(1)).alias("links")).where(F.col("links") > HEAVY)
    heavy = keep(counts.select("hub", degree.alias("salts")))
    dealt = edges.join(heavy, F.col("b") == F.col("hub"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(0)).alias("salt"))
    dealt = dealt if not heavy.isEmpty() else edges.withColumn("salt", F.lit(0).cast("long"))
    labels = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        sent = labels.join(heavy, F.col("node") == F.col("hub"), "left").select(F.col("node").alias("b"), "label", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        near = dealt.join(sent, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "node").join(jump, "label").select("node", F.col("label").alias("old"), F.least("label", "near", "far").alias("label"))
        new = keep(new)
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
