"""Connected components by minimum labels and pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). node, root: the smallest node that each node of an edge is connected to.

    Each round takes the least label among the neighbours, then the label's own label, so that
    chains shorten by powers of two. A node with very many edges is a skewed join key, which
    adaptive execution splits; its messages are combined before they are shuffled. Edges of a node
    with itself only make it a node.
    """
    # before the rounds: a node's smaller neighbours are tied to the least of them instead
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("w")))
    tied = edges.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
    edges = least.withColumnRenamed("w", "v").unionByName(tied)
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("root")))
    while True:
        told = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("root").alias("told"))
        near = labels.join(told, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("told", "root")).alias("root"))
        near = materialize(near)
        up = near.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = materialize(near.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")))
        changed = jumped.where("root <> old").limit(1).count()
        release(near)
        release(labels)
        labels = jumped.select("node", "root")
        if not changed:
            release(both)
            return labels
