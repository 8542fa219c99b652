"""Merging of chains: links that meet at a node of degree 2 become one link.

An inner node has degree 2 and is not mandatory.  Every link is looked at in both directions; pointers to the end of
the chain double each round, so a chain of n links takes about log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.operators.network import Network, node_degree
from tripweave.runtime import checkpoint, checkpoint_observed, large
from tripweave.sources.tables import unique


def inner_nodes(links: DataFrame, mandatory: DataFrame) -> DataFrame:
    """Nodes of degree 2 outside ``mandatory(node)``."""
    return node_degree(links).where("degree = 2").select("node").join(large(mandatory.select("node")), "node", "left_anti")


def both_directions(links: DataFrame) -> DataFrame:
    def way(forward: bool):
        start, end = ("source_node", "target_node") if forward else ("target_node", "source_node")
        is_open = F.lit(True) if forward else ~F.col("is_oneway")
        return F.struct(
            F.lit(forward).alias("forward"), F.col(start).alias("start"), F.col(end).alias("end"), is_open.alias("is_open")
        )

    return links.select("link_id", "length", "travel_time", F.inline(F.array(way(True), way(False))))


def chain_ends(links: DataFrame, mandatory: DataFrame) -> DataFrame:
    """For each link and direction the last link of its chain (``end_link``) and the links still ahead (``ahead``).

    Links of a ring without any anchor have no end and are left out.
    """
    inner = inner_nodes(links, mandatory).withColumn("is_inner", F.lit(True))
    ways = checkpoint(
        both_directions(links).join(large(inner), F.col("end") == F.col("node"), "left")
        .withColumn("is_inner", F.coalesce("is_inner", F.lit(False))).drop("node")
    )
    onward = ways.select(
        F.col("link_id").alias("end_link"), F.col("forward").alias("end_forward"), F.col("start").alias("end"),
        (~F.col("is_inner")).alias("fixed"),
    )
    ending = ways.where("NOT is_inner").select(
        "link_id", "forward", F.col("link_id").alias("end_link"), F.col("forward").alias("end_forward"),
        F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("fixed"),
    )
    passing = (
        ways.where("is_inner").join(large(onward), "end").where("link_id <> end_link")
        .select("link_id", "forward", "end_link", "end_forward", F.lit(1).cast("long").alias("ahead"), "fixed")
    )
    n_open = F.count_if(~F.col("fixed"))
    pointer, left = checkpoint_observed(ending.unionByName(passing), n_open=n_open)
    while left["n_open"]:
        jump = pointer.select(
            F.col("link_id").alias("end_link"), F.col("forward").alias("end_forward"),
            F.col("end_link").alias("next_link"), F.col("end_forward").alias("next_forward"),
            F.col("ahead").alias("further"), F.col("fixed").alias("done"),
        )
        moved = pointer.where("NOT fixed").join(large(jump), ["end_link", "end_forward"]).select(
            "link_id", "forward", F.col("next_link").alias("end_link"), F.col("next_forward").alias("end_forward"),
            (F.col("ahead") + F.col("further")).alias("ahead"), F.col("done").alias("fixed"),
        )
        before = left["n_open"]
        pointer, left = checkpoint_observed(pointer.where("fixed").unionByName(moved), n_open=n_open)
        if left["n_open"] == before:
            break
    return pointer.where("fixed").select("link_id", "forward", "end_link", "ahead").join(large(ways), ["link_id", "forward"])


def chain_members(links: DataFrame, mandatory: DataFrame) -> DataFrame:
    """Each link with its chain, named by the smaller of the two end links, and seen in the chain's direction,
    which starts at that end; a chain of one link keeps its own direction."""
    ends = chain_ends(links, mandatory)
    chains = ends.groupBy("link_id").agg(
        F.min("end_link").alias("chain"), F.max("end_link").alias("far_end"),
        F.max(F.when(F.col("forward"), F.col("is_open"))).alias("open_forward"),
        F.max(F.when(~F.col("forward"), F.col("is_open"))).alias("open_backward"),
    )
    rows = ends.join(large(chains), "link_id").where("end_link = far_end AND (chain <> far_end OR forward)")
    alone = links.join(large(rows.select("link_id")), "link_id", "left_anti").select(
        F.col("link_id").alias("chain"), "link_id", F.lit(0).cast("long").alias("ahead"), F.col("source_node").alias("start"),
        F.col("target_node").alias("end"), "length", "travel_time", F.lit(True).alias("along"),
        (~F.col("is_oneway")).alias("against"),
    )
    return rows.select(
        "chain", "link_id", "ahead", "start", "end", "length", "travel_time",
        F.when(F.col("forward"), F.col("open_forward")).otherwise(F.col("open_backward")).alias("along"),
        F.when(F.col("forward"), F.col("open_backward")).otherwise(F.col("open_forward")).alias("against"),
    ).unionByName(alone)


def chain_merge(members: DataFrame) -> DataFrame:
    """One row per chain: summed length and time; open in a direction only if every member is."""
    return members.groupBy("chain").agg(
        F.max_by("start", "ahead").alias("start"), F.min_by("end", "ahead").alias("end"),
        F.sum("length").alias("length"), F.sum("travel_time").alias("travel_time"),
        F.bool_and("along").alias("along"), F.bool_and("against").alias("against"), F.count("*").alias("n_edges"),
    )


def contract(network: Network, mandatory: DataFrame) -> Network:
    """The network with its chains merged.

    Chains that return to the anchor they left, and chains open in neither direction, can lie on no path and are
    dropped.  Costs between the nodes that stay are unchanged.
    """
    if network.members is not None:
        raise ValueError("the network is already contracted")
    links = unique(network.links, "link_id", "edges")
    members = checkpoint(chain_members(links, mandatory))
    merged = checkpoint(chain_merge(members).where("start <> end AND (along OR against)"))
    new_links = merged.select(
        F.col("chain").alias("link_id"),
        F.when(F.col("along"), F.col("start")).otherwise(F.col("end")).alias("source_node"),
        F.when(F.col("along"), F.col("end")).otherwise(F.col("start")).alias("target_node"),
        "length", "travel_time", (~(F.col("along") & F.col("against"))).alias("is_oneway"),
    )
    place = F.when(F.col("runs_along"), F.col("n_edges") - F.col("ahead")).otherwise(F.col("ahead") + 1)
    new_members = members.join(
        large(merged.select("chain", "n_edges", F.col("along").alias("runs_along"))), "chain"
    ).select(F.col("chain").alias("link_id"), F.col("link_id").alias("edge_id"), place.alias("seq"))
    return Network(checkpoint(new_links), checkpoint(new_members)).counted()
