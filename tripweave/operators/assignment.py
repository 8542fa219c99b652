"""All-or-nothing assignment of trips to shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.conf import ModelConf
from tripweave.operators.network import Network
from tripweave.operators.trees import Levels, sum_up, sweep_up
from tripweave.runtime import large


def assign(od: DataFrame, tree: DataFrame, network: Network, conf: ModelConf, levels: Levels | None = None) -> DataFrame:
    """Volume per edge for ``od(src, node, trips)``: trips are summed up each source's tree, then over sources.

    With ``levels`` that takes a few joins; without them the loads are swept up by distance.
    """
    loads = od.where("src <> node").groupBy("src", "node").agg(F.sum("trips").alias("load"))
    if levels is not None:
        flows = sum_up(loads, levels).join(large(tree.select("src", "node", "link_id")), ["src", "node"])
    else:
        mean = network.arc_costs(conf.length_coef, conf.time_coef).agg(F.avg("cost")).first()[0]
        flows = sweep_up(loads, tree, conf.band * mean if mean else 0.0, conf.hops_per_round)
    by_link = flows.groupBy("link_id").agg(F.sum("load").alias("volume"))
    if network.members is None:
        return by_link.withColumnRenamed("link_id", "edge_id")
    return network.expand(by_link).groupBy("edge_id").agg(F.sum("volume").alias("volume"))


def assign_by_paths(od: DataFrame, path_links: DataFrame) -> DataFrame:
    """The same volumes from written-out paths joined to the matrix; pairs without a path add nothing."""
    return (
        od.join(large(path_links), ["origin", "destination"])
        .groupBy("edge_id").agg(F.sum("trips").alias("volume"))
    )
