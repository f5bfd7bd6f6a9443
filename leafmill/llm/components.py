"""Connected components of an undirected graph, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (id, component): every vertex of an edge with the smallest vertex that it reaches.

    Each round takes the smallest label among the neighbours and then the label's label, so labels
    travel along a chain in a number of rounds that grows with the logarithm of its length.  Every
    round is aggregated before its shuffle and cut by a checkpoint; nothing is gathered by vertex.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        better = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        labels_now = checkpoint(better.join(root, "component").select("id", "was", F.least("component", "root").alias("component")))
        if labels_now.where("was <> component").isEmpty():
            return labels_now.select("id", "component")
        labels = labels_now.select("id", "component")
