"""Connected components by joins, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.sources.scratch import materialise


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Every round, a node takes the smallest label among its own and its neighbours',
    then the label of its label, so long chains shorten quickly. The smallest label
    around a node is a map-side combined minimum: a hub's edges are never gathered.
    Labels are written each round; nothing is kept in executors' memory.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialise(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component"))
    labels = materialise(labels, "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("smaller")
        )
        jump = labels.select(F.col("node").alias("smaller"), F.col("component").alias("further"))
        moved = materialise(
            step.join(jump, "smaller").select("node", "component", F.least("smaller", "further").alias("new")), "labels"
        )
        done = moved.where("new <> component").isEmpty()
        labels = moved.select("node", F.col("new").alias("component"))
        if done:
            return labels
