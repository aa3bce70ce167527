"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(a, b)``.

    Each round takes the smallest label among a node's neighbours and then jumps to that label's
    label, until nothing changes. Rounds are written to the shared folder. An edge with a null end
    is left out; repeated edges and loops do no harm.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = materialize(lower, "labels")
        roots = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = materialize(
            lower.join(roots, "component", "left").select("node", "old", F.coalesce(F.least("component", "root"), "component").alias("component")), "labels"
        )
        labels = moved.select("node", "component")
        if moved.filter("old != component").isEmpty():
            return labels
