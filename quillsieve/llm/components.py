"""Connected components by labels that shrink: every step joins and aggregates, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.session import pin


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes of ``edges`` (``a``, ``b``); the label is the least node of the component.

    Each round takes the least label among a node's neighbours and then that label's own label, so a path of length n
    is done in about log n rounds. A node with very many neighbours is only a frequent join key, whose rows Spark
    splits, and its labels are added up in the tasks before the shuffle.
    """
    both = pin(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        least = labels.join(seen.agg(F.min("label").alias("_near")), "node").select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new")
        )
        jumped = least.join(labels.select(F.col("node").alias("_new"), F.col("label").alias("_far")), "_new")
        labels = pin(jumped.select("node", F.least("_new", "_far").alias("label"), "_old"))
        if labels.where(F.col("label") != F.col("_old")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
