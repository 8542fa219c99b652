"""Shortest-path trees, and walks on them in a logarithmic number of joins.

A tree row ``(src, node, link_id, up, dist)`` says how the best path from ``src`` enters ``node``.  ``lift``
derives, by doubling, the ancestor 2^k links up for every k; with those tables all paths come out of one
job of about log2(hops) joins.  Sums over subtrees, which load trips on links, need no such tables: descending ``dist`` is
a topological order, and ``sweep_up`` follows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.conf import ModelConf
from tripweave.operators.network import Network
from tripweave.operators.skim import INF, chained, double, within
from tripweave.runtime import checkpoint, checkpoint_observed, is_empty, kept_together, large, partitions, settle, settle_observed, small, static_plans


def shortest_tree(labels: DataFrame, network: Network, conf: ModelConf) -> DataFrame:
    """The link by which each label was reached; of several equal ones the smallest ``link_id``.

    An offer equal to the label is exact: the label was produced by the same addition.  Grouping offers by
    their value next to the label itself finds it without joining the labels to themselves.
    """
    costs = network.arc_costs(conf.length_coef, conf.time_coef)
    if is_empty(costs.where("cost = 0")):
        found = tight_arcs(labels, costs, network.n_arcs, conf)
    else:
        found = tree_with_free_arcs(labels, costs, network.n_arcs, conf)
    return settle(found, "src", "node", ordered=True)


def offers_of(labels: DataFrame, costs: DataFrame, n_arcs: int, conf: ModelConf) -> DataFrame:
    return (
        labels.where(within(conf.search_radius))
        .join(small(costs, n_arcs, conf.broadcast_rows), F.col("node") == F.col("u"))
        .select("src", F.col("v").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), "link_id", "u")
        .where("src <> node")
    )


def tight_arcs(labels: DataFrame, costs: DataFrame, n_arcs: int, conf: ModelConf) -> DataFrame:
    offers = offers_of(labels, costs, n_arcs, conf).withColumn("own", F.lit(0))
    own = labels.select(
        "src", "node", "dist", F.lit(None).cast("long").alias("link_id"), F.lit(None).cast("long").alias("u"),
        F.lit(1).alias("own"),
    )
    return (
        offers.unionByName(own)
        .groupBy("src", "node", "dist")
        .agg(F.min("link_id").alias("link_id"), F.min_by("u", "link_id").alias("up"), F.max("own").alias("own"))
        .where("own = 1 AND link_id IS NOT NULL")
        .select("src", "node", "link_id", "up", "dist")
    )


def tree_with_free_arcs(labels: DataFrame, costs: DataFrame, n_arcs: int, conf: ModelConf) -> DataFrame:
    """Arcs of zero cost can be tight in a circle, so labels are first ranked by links from the source and an
    arc must also lead from one rank to the next."""
    offers = offers_of(labels, costs, n_arcs, conf)
    tight = settle(offers.join(large(labels), ["src", "node", "dist"]).select("src", "node", "link_id", "u"), "src", "u")
    state = settle(
        labels.where("src = node").select("src", "node", F.lit(0.0).alias("dist"), F.lit(INF).alias("done")),
        "src", "node",
    )
    left = {"n_open": 1}
    while left["n_open"]:
        fresh = state.where("dist < done").select("src", F.col("node").alias("u"), "dist")
        further = fresh.join(large(tight), ["src", "u"]).select(
            "src", "node", (F.col("dist") + 1).alias("dist"), F.lit(INF).alias("done")
        )
        state, left = checkpoint_observed(
            state.withColumn("done", F.col("dist")).unionByName(further)
            .groupBy("src", "node").agg(F.min("dist").alias("dist"), F.min("done").alias("done")),
            n_open=F.count_if(F.col("dist") < F.col("done")),
        )
    ranks = state.select("src", "node", F.col("dist").alias("rank"))
    before = ranks.select("src", F.col("node").alias("u"), F.col("rank").alias("rank_u"))
    found = (
        tight.join(large(before), ["src", "u"]).join(large(ranks), ["src", "node"])
        .where("rank_u + 1 = rank")
        .groupBy("src", "node").agg(F.min("link_id").alias("link_id"), F.min_by("u", "link_id").alias("up"))
    )
    return found.join(large(labels), ["src", "node"]).select("src", "node", "link_id", "up", "dist")


def renewed(df: DataFrame) -> DataFrame:
    """The same columns as new attributes, so that a written table can be joined to the one it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class Levels(list):
    """Tables ``(src, node, up)`` of the ancestor 1, 2, 4, ... links up, and the columns they are partitioned by.

    With sources for every partition that is ``src`` alone: all work stays within a source then, whose labels the network or
    the search radius bounds, and no level moves a row. Few sources are partitioned by ``src, node``.
    """

    keys: tuple[str, ...] = ("src", "node")


def lift(tree: DataFrame) -> Levels:
    """The levels of a tree, as long as any ancestor exists."""
    spark = tree.sparkSession
    levels = Levels([tree.select("src", "node", "up")])
    if tree.select("src").distinct().count() >= partitions(spark):
        levels.keys = ("src",)
        levels[0] = settle(levels[0], "src", ordered=True)
    while True:
        low = levels[-1]
        step = low.select("src", F.col("node").alias("up"), F.col("up").alias("next"))
        with kept_together(spark):
            high = low.join(large(step), ["src", "up"]).select("src", "node", F.col("next").alias("up"))
            if levels.keys == ("src",):
                high = checkpoint(high.sortWithinPartitions("src", "node"))
            else:
                high = settle(high, "src", "node", ordered=True)
        if is_empty(high):
            return levels
        levels.append(high)


def walk_up(starts: DataFrame, levels: Levels) -> DataFrame:
    """All ancestors of ``starts(src, node, at)``: rows ``(src, node, at, back)`` with ``back`` links behind.

    Each join doubles the reach: a row stays and also jumps.  Every distance has one binary form, so every
    ancestor comes out once.  The source itself is left out, as no link enters it.
    """
    spark = starts.sparkSession
    rows = starts.select("src", "node", "at", F.lit(0).cast("long").alias("back"))
    with kept_together(spark):
        rows = rows.repartition(partitions(spark), "src") if levels.keys == ("src",) else rows
        for k, level in enumerate(levels):
            jump = level.where("up <> src").select("src", F.col("node").alias("at"), "up")
            here = F.struct("at", "back")
            there = F.struct(F.col("up").alias("at"), (F.col("back") + F.lit(2**k)).alias("back"))
            rows = rows.join(large(jump), ["src", "at"], "left").select(
                "src", "node", F.inline(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there)))
            )
        return checkpoint(renewed(rows))


def sum_up(loads: DataFrame, levels: Levels) -> DataFrame:
    """Sum ``loads(src, node, load)`` over each node's subtree; nodes without load below them do not occur.

    After the step with the 2^k ancestors a node holds everything fewer than 2^(k+1) links below it, so equal
    paths merge early and no path is ever written out.
    """
    spark = loads.sparkSession
    with kept_together(spark):
        loads = loads.repartition(partitions(spark), "src") if levels.keys == ("src",) else loads
        for level in levels:
            jump = level.where("up <> src")
            here = F.struct("node", "load")
            there = F.struct(F.col("up").alias("node"), "load")
            loads = (
                loads.join(large(jump), ["src", "node"], "left")
                .select("src", F.inline(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))))
                .groupBy("src", "node").agg(F.sum("load").alias("load"))
            )
        return checkpoint(renewed(loads))


def sweep_up(loads: DataFrame, tree: DataFrame, step: float, hops: int) -> DataFrame:
    """``(src, node, link_id, load)``: the sum of ``loads(src, node, load)`` over the subtree of each node with a load in or below it.

    Every node passes what it has to the node above it.  A front comes down by ``step`` a hop and only loads beyond it move, so
    most nodes have all of their subtree's load when their turn comes and pass it on once; one that gets more later
    passes that on too.  Nodes farther out than everything that still waits are done and stay in the table that wrote them.
    """
    spark = tree.sparkSession
    none = F.lit(None).cast("double")
    rows = tree.join(large(loads.withColumn("waits", F.lit(True))), ["src", "node"], "left").select(
        "src", "node", "link_id", "up", "dist", F.col("load").alias("wait"), F.coalesce("waits", F.lit(False)).alias("waits"),
        none.alias("flow"), F.lit(False).alias("used"),
    )
    high = F.max(F.when(F.col("waits"), F.col("dist")))
    # Few sources spread over the partitions by node, at the price of one shuffle a hop.
    keys = ["src"] if tree.select("src").distinct().count() >= partitions(spark) else ["src", "node"]
    rows, left = settle_observed(rows, *keys, high=high)
    per_job = hops if keys == ["src"] else 1
    done, front = [], float("inf")
    while left["high"] is not None:
        front = min(front, left["high"] - step)
        with static_plans(spark):
            moved = rows.where(F.col("dist") <= F.lit(left["high"])).withColumn("front", F.lit(front))
            moved = chained(PASS_UP.format(step=double(step)), per_job, moved).drop("front")
            rows, left = checkpoint_observed(moved, high=high)
        front -= per_job * step
        finished = F.lit(True) if left["high"] is None else F.col("dist") > F.lit(left["high"])
        done.append(rows.where(F.col("used") & finished).select("src", "node", "link_id", F.col("flow").alias("load")))
    if not done:
        return rows.select("src", "node", "link_id", F.col("flow").alias("load")).limit(0)
    return reduce(DataFrame.unionByName, done)


# One hop: loads that wait at or beyond the front go to the node above and count as flow on the link between.
PASS_UP = """
SELECT src, node, max(link_id) AS link_id, max(up) AS up, max(dist) AS dist, sum(wait) AS wait, bool_or(waits) AS waits,
  sum(flow) AS flow, bool_or(used) AS used, max(front) - {step} AS front
FROM (
  SELECT src, front, inline(CASE WHEN goes AND up <> src THEN array(here, above) ELSE array(here) END)
  FROM (
    SELECT src, front, goes, up,
      named_struct('node', node, 'link_id', link_id, 'up', up, 'dist', dist, 'wait', CASE WHEN NOT goes THEN wait END, 'waits', waits AND NOT goes,
        'flow', CASE WHEN goes THEN coalesce(flow + wait, flow, wait) ELSE flow END, 'used', used OR goes) AS here,
      named_struct('node', up, 'link_id', CAST(NULL AS BIGINT), 'up', CAST(NULL AS BIGINT), 'dist', CAST(NULL AS DOUBLE), 'wait', wait, 'waits', true,
        'flow', CAST(NULL AS DOUBLE), 'used', false) AS above
    FROM (SELECT *, waits AND dist >= front AS goes FROM {{rows}})
  )
) GROUP BY src, node"""


def counted_tree(tree: DataFrame, counted_links: DataFrame, n_counts: int, conf: ModelConf) -> tuple[DataFrame, DataFrame]:
    """Shrink the tree to links that carry a count.

    Returns the small tree and ``(src, node, to)``, the nearest node at or above each node that is entered by
    a counted link.  Pointers past uncounted links double every round; finished ones drop out of the join.
    """
    links = counted_links.select("link_id").distinct().withColumn("counted", F.lit(True))
    flagged = tree.join(small(links, n_counts, conf.broadcast_rows), "link_id", "left")
    unfixed = {"n_open": F.count_if(~F.col("fixed"))}
    pointer, left = settle_observed(
        flagged.select(
            "src", "node", F.when(F.col("counted"), F.col("node")).otherwise(F.col("up")).alias("to"),
            F.coalesce(F.col("counted"), F.col("up") == F.col("src")).alias("fixed"),
        ),
        "src", "node", **unfixed,
    )
    while left["n_open"]:
        ahead = pointer.select("src", F.col("node").alias("to"), F.col("to").alias("next"), F.col("fixed").alias("done"))
        moved = pointer.where("NOT fixed").join(large(ahead), ["src", "to"]).select(
            "src", "node", F.col("next").alias("to"), F.col("done").alias("fixed")
        )
        pointer, left = settle_observed(pointer.where("fixed").unionByName(moved), "src", "node", **unfixed)
    nearest = pointer.where("to <> src").select("src", "node", "to")
    above = nearest.select("src", F.col("node").alias("up"), "to")
    shrunk = (
        flagged.where("counted").select("src", "node", "link_id", "up")
        .join(large(above), ["src", "up"], "left")
        .select("src", "node", "link_id", F.coalesce("to", "src").alias("up"))
    )
    return settle(shrunk, "src", "node"), nearest
