"""Connected components of a link table, without a graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm.frames import remove, stored


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``, any orderable type).

    The label is the smallest node reachable. Each round takes the smallest label
    among the neighbours, then the label of that label, so paths halve. Labels are
    written after every round; a lost executor costs the running round only. A node
    with very many links is a skewed join, which adaptive execution splits, and a
    minimum, which is combined before the shuffle.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), folder, "links", few=True)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), folder, "labels0", few=True)
    turn = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), "label")
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        fresh = low.join(jump, "low").select("node", F.least("low", "jump").alias("label"), (F.least("low", "jump") != F.col("label")).alias("moved"))
        turn += 1
        fresh = stored(fresh, folder, f"labels{turn}", few=True)
        moved = fresh.where("moved").limit(1).count()
        remove(spark, f"{folder}/labels{turn - 1}")
        labels = fresh.select("node", "label")
        if not moved:
            return labels
