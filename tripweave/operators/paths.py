"""Paths between zones, as tables of path links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.conf import ModelConf
from tripweave.operators.network import Network
from tripweave.operators.trees import counted_tree, lift, walk_up
from tripweave.runtime import large, small


def at_nodes(pairs: DataFrame, zones: DataFrame, n_zones: int, conf: ModelConf) -> DataFrame:
    """Add the nodes of ``origin`` and ``destination`` as ``src`` and ``node``; a zone that ``zones`` does not have raises."""
    start = zones.select(F.col("zone_id").alias("origin"), F.col("node_id").alias("src"))
    end = zones.select(F.col("zone_id").alias("destination"), F.col("node_id").alias("node"))
    used = pairs.select(F.explode(F.array("origin", "destination")).alias("zone_id")).distinct()
    lost = used.join(large(zones.select("zone_id")), "zone_id", "left_anti").take(5)
    if lost:
        raise ValueError(f"pairs of zones that the model does not have, e.g. {[r[0] for r in lost]}")
    return pairs.join(small(start, n_zones, conf.broadcast_rows), "origin").join(
        small(end, n_zones, conf.broadcast_rows), "destination"
    )


def path_links(pairs: DataFrame, tree: DataFrame, levels: list[DataFrame], network: Network) -> DataFrame:
    """``(origin, destination, seq, edge_id)`` for ``pairs(origin, destination, src, node)``, in travel order from 1."""
    starts = pairs.where("src <> node").select("src", "node").distinct()
    starts = starts.select("src", "node", F.col("node").alias("at"))
    entry = tree.select("src", F.col("node").alias("at"), "link_id", "up")
    walked = walk_up(starts, levels).join(large(entry), ["src", "at"])
    one_path = Window.partitionBy("src", "node")
    ordered = walked.withColumn("seq", F.max("back").over(one_path) - F.col("back") + 1)
    ordered = in_edge_order(ordered, network)
    return pairs.select("origin", "destination", "src", "node").join(large(ordered), ["src", "node"]).select(
        "origin", "destination", "seq", "edge_id"
    )


def in_edge_order(ordered: DataFrame, network: Network) -> DataFrame:
    """Spell merged links out as edges, backwards where the path runs against the link."""
    if network.members is None:
        return ordered.withColumnRenamed("link_id", "edge_id")
    direction = network.links.select("link_id", "source_node")
    place = F.when(F.col("up") == F.col("source_node"), F.col("part")).otherwise(-F.col("part"))
    spelled = (
        ordered.withColumnRenamed("seq", "link_seq").join(large(direction), "link_id")
        .join(large(network.members.withColumnRenamed("seq", "part")), "link_id")
        .withColumn("part", place)
    )
    along = Window.partitionBy("src", "node").orderBy("link_seq", "part")
    return spelled.withColumn("seq", F.row_number().over(along).cast("long"))


def collect_paths(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``pairs`` with the path as an array of edge ids; pairs without a path keep an empty one."""
    arrays = links.groupBy("origin", "destination").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_id"))), lambda x: x["edge_id"]).alias("path")
    )
    return pairs.join(large(arrays), ["origin", "destination"], "left").withColumn(
        "path", F.coalesce("path", F.array().cast("array<long>"))
    )


def counted_incidence(pairs: DataFrame, tree: DataFrame, levels: list[DataFrame], network: Network, counts: DataFrame,
                      n_counts: int, conf: ModelConf) -> DataFrame:
    """``(origin, destination, edge_id)`` for each counted edge on the path of each pair.

    Either walks every path and keeps the counted links, or first shrinks the trees to counted links so that the
    rows produced are the rows returned.  The sizes decide: walking touches at most pairs times hops,
    shrinking touches the trees.
    """
    counted_edges = counts.select("edge_id")
    if network.members is None:
        counted_links = counted_edges.select(F.col("edge_id").alias("link_id"), "edge_id")
    else:
        counted_links = network.members.join(small(counted_edges, n_counts, conf.broadcast_rows), "edge_id").select("link_id", "edge_id")
    counted_links = small(counted_links, n_counts, conf.broadcast_rows)
    starts = pairs.where("src <> node").select("src", "node").distinct()
    if starts.count() * 2 ** (len(levels) - 1) <= tree.count():
        hits = hits_by_walking(starts, tree, levels)
    else:
        hits = hits_by_shrinking(starts, tree, counted_links, n_counts, conf)
    hits = hits.join(counted_links, "link_id").select("src", "node", "edge_id")
    return pairs.select("origin", "destination", "src", "node").join(large(hits), ["src", "node"]).select(
        "origin", "destination", "edge_id"
    )


def hits_by_walking(starts: DataFrame, tree: DataFrame, levels: list[DataFrame]) -> DataFrame:
    entry = tree.select("src", F.col("node").alias("at"), "link_id")
    return walk_up(starts.withColumn("at", F.col("node")), levels).join(large(entry), ["src", "at"])


def hits_by_shrinking(starts: DataFrame, tree: DataFrame, counted_links: DataFrame, n_counts: int, conf: ModelConf) -> DataFrame:
    shrunk, nearest = counted_tree(tree, counted_links, n_counts, conf)
    starts = starts.join(large(nearest), ["src", "node"]).withColumnRenamed("to", "at")
    entry = shrunk.select("src", F.col("node").alias("at"), "link_id")
    return walk_up(starts, lift(shrunk)).join(large(entry), ["src", "at"])
