"""Road network as two tables: undirected links with a one-way flag, and the directed arcs they allow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions.formulas import edge_cost
from tripweave.runtime import checkpoint, large
from tripweave.sources.tables import EDGES, conform


@dataclass(frozen=True)
class Network:
    """``links(link_id, source_node, target_node, length, travel_time, is_oneway)``.

    A plain network has one link per edge.  A contracted one also holds ``members(link_id, edge_id,
    seq)``, the edges each link stands for in source-to-target order.
    """

    links: DataFrame
    members: DataFrame | None = None
    n_arcs: int = 0

    @staticmethod
    def from_edges(edges: DataFrame) -> Network:
        links = checkpoint(load_links(edges))
        return Network(links).counted()

    def counted(self) -> Network:
        bad, n = self.links.select(
            F.count_if(
                F.expr("link_id IS NULL OR source_node IS NULL OR target_node IS NULL OR is_oneway IS NULL "
                       "OR length IS NULL OR travel_time IS NULL OR length < 0 OR travel_time < 0 "
                       "OR isnan(length) OR isnan(travel_time)")
            ),
            F.sum(F.when(F.col("is_oneway"), 1).otherwise(2)),
        ).first()
        if bad:
            raise ValueError(f"{bad} edges have a missing, negative or undefined value")
        return Network(self.links, self.members, int(n or 0))

    @property
    def arcs(self) -> DataFrame:
        return arcs_of(self.links)

    @property
    def nodes(self) -> DataFrame:
        return endpoints(self.links).distinct()

    def arc_costs(self, length_coef: float, time_coef: float) -> DataFrame:
        """``(link_id, u, v, cost)`` for the given weights; arcs of infinite or undefined cost lead nowhere and are left out."""
        if not (length_coef >= 0 and time_coef >= 0):
            raise ValueError(f"weights must not be negative or undefined: {length_coef}, {time_coef}")
        cost = edge_cost(F.col("length"), F.col("travel_time"), length_coef, time_coef)
        return self.arcs.select("link_id", "u", "v", cost.alias("cost")).where(F.col("cost") < float("inf"))

    def link_count(self) -> int:
        return self.links.count()

    def expand(self, by_link: DataFrame) -> DataFrame:
        """Replace ``link_id`` by the ids of the edges behind it."""
        if self.members is None:
            return by_link.withColumnRenamed("link_id", "edge_id")
        return by_link.join(large(self.members.select("link_id", "edge_id")), "link_id").drop("link_id")


def load_links(edges: DataFrame) -> DataFrame:
    """Edges that join two different nodes; a node seen only in self-loops does not exist."""
    return (
        conform(edges, EDGES)
        .where("source_node <> target_node OR source_node IS NULL OR target_node IS NULL")
        .withColumnRenamed("edge_id", "link_id")
    )


def arcs_of(links: DataFrame) -> DataFrame:
    """Directed arcs: each link forwards, and backwards unless it is one-way."""
    both = F.array(
        F.struct(F.col("source_node").alias("u"), F.col("target_node").alias("v")),
        F.struct(F.col("target_node").alias("u"), F.col("source_node").alias("v")),
    )
    one = F.slice(both, 1, 1)
    return links.select(
        "link_id", "length", "travel_time", F.inline(F.when(F.col("is_oneway"), one).otherwise(both))
    ).select("link_id", "u", "v", "length", "travel_time")


def endpoints(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("source_node", "target_node")).alias("node"))


def node_degree(links: DataFrame) -> DataFrame:
    """Number of links at each node, whatever their direction."""
    return endpoints(links).groupBy("node").agg(F.count("*").alias("degree"))


def missing_nodes(zones: DataFrame, network: Network) -> DataFrame:
    """``zone_id, node_id`` of zones on nodes that the network does not have."""
    return zones.join(large(network.nodes), zones["node_id"] == F.col("node"), "left_anti").select("zone_id", "node_id")


def check_nodes(zones: DataFrame, network: Network) -> None:
    """Raise when a zone sits on a node the network does not have."""
    lost = missing_nodes(zones, network).take(5)
    if lost:
        raise ValueError(f"zones on nodes that do not exist, e.g. {[tuple(r) for r in lost]}")
