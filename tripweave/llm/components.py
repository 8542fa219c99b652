"""Connected components of a table of links, by contracting it round after round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import saved


def _roots(parents: DataFrame) -> DataFrame:
    """``node, parent`` with each parent replaced by the last one above it; parents are smaller than their nodes."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        step = saved(parents.join(above, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")))
        parents = step.drop("moved")
        if step.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that has a link to another; ``links`` is ``a, b``.

    Every node hooks on its smallest neighbour, trees shrink to their roots, and the links between roots go on to
    the next round. Links of a node with itself, repeated links and links with a null end change nothing.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct())
    labels = None
    while not edges.isEmpty():
        parents = _roots(edges.groupBy("node").agg(F.min("to").alias("parent")))
        if labels is None:
            smallest = edges.select(F.col("to").alias("node")).distinct().join(parents, "node", "left_anti")
            labels = parents.withColumnRenamed("parent", "component").unionByName(smallest.withColumn("component", F.col("node")))
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            labels = labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = saved(labels)
        one = parents.withColumnRenamed("parent", "x")
        two = parents.select(F.col("node").alias("to"), F.col("parent").alias("y"))
        ends = edges.join(one, "node", "left").join(two, "to", "left").select(F.coalesce("x", "node").alias("x"), F.coalesce("y", "to").alias("y")).where("x <> y")
        edges = saved(ends.select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("to")).distinct())
    if labels is None:
        labels = edges.select("node", F.col("to").alias("component"))
    return labels
