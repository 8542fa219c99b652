"""Least-cost labels from many origins at once.

A label is a row ``(src, node, dist)``.  Every hop offers improved labels to the neighbours of their
nodes and keeps the least offer per ``(src, node)``; the search ends when no label improves.

Labels are expanded in bands of distance: a front moves on by ``band`` mean arc costs a hop, and a label beyond it waits, as
shorter ways to it may still come up.  What is left open tells how far labels are settled: none below the least open
distance changes any more.  A node's hold is the most that an arc back to a node that enters it costs, and infinite if one of them
has no arc back: a settled label farther back than its node's hold can receive no offer, and need not be looked at again.
Each round's one job also counts what is open.

Two ways to run a hop:

* arcs small enough to broadcast: labels are hash-partitioned by ``src`` once, and a job advances several
  hops without any shuffle.  A source has at most one label per node of that broadcast-sized network, so no
  partition can hold an unbounded group. Rounds carry and rewrite what offers can still come to. Of few labels, the others stay in the
  table that wrote them; of many, they are written apart once they are a fair share, so that the round's table can go;
* otherwise, or with too few sources to fill the cluster: one hop per job. Labels and arcs are hash-partitioned by node once and
  stay there; only offers move, to the partition of the node they are for. A node has one label per source at most. A hop reads
  all labels but writes only new and lesser ones, so all hops together write little more than each label once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.conf import ModelConf
from tripweave.operators.network import Network
from tripweave.runtime import checkpoint, checkpoint_observed, large, let_go, partitions, settle, small, static_plans

INF = float("inf")
# Below this many arcs a source's labels fit one task whatever the number of sources.
FEW_ARCS = 1_000_000
# Up to this many labels a round's table may stay for the settled ones in it, some 10 MB.
FEW_LABELS = 200_000
# The share of a larger table that settled labels out of reach must be to be written apart.
APART = 0.25
# A search by hops reads so many layers at most, and so many that hold less than that share of all rows.
MOST_LAYERS, MOST_SLIGHT, SLIGHT = 40, 6, 0.02


def within(radius: float):
    """True for labels that may still be expanded: those at or inside the search radius."""
    return F.lit(True) if math.isinf(radius) else F.col("dist") <= F.lit(float(radius))


def live(radius: float):
    """``done`` is the distance at which a label was last expanded, infinite if never."""
    return (F.col("dist") < F.col("done")) & within(radius)


def shortest_dist(network: Network, sources: DataFrame, conf: ModelConf, strict_radius: bool = False) -> DataFrame:
    """Labels ``(src, node, dist)`` from every node of ``sources(src)``.

    Labels just outside the search radius that were reached from inside it are kept, unless
    ``strict_radius`` drops them.
    """
    spark = sources.sparkSession
    costs = network.arc_costs(conf.length_coef, conf.time_coef)
    arc = costs.agg(F.avg("cost").alias("mean"), F.max("cost").alias("most")).first()
    parts = partitions(spark)
    with static_plans(spark):
        origins = checkpoint(sources.select("src").distinct().repartition(parts, "src"))
    # The table that is sent also has a row for each node, and a node has an arc: three rows an arc at most.
    fits = 3 * network.n_arcs <= conf.broadcast_rows
    by_source = fits and (network.n_arcs <= FEW_ARCS or origins.count() >= parts)
    start = origins.select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.lit(INF).alias("done"))
    step = conf.band * arc["mean"] if arc["mean"] else INF
    reach = arc["most"] or 0.0
    if by_source:
        costs = checkpoint(costs)
        labels = search_by_source(start, checkpoint(costs.join(large(holds_of(costs)), "v")), conf, step, reach)
    else:
        labels = search_by_hop(start, costs, conf, step)
    return labels.where(within(conf.search_radius)) if strict_radius else labels


def holds_of(costs: DataFrame) -> DataFrame:
    """``(v, hold)``: the most that an arc costs from ``v`` back to a node that enters it.

    It is infinite if some arc that ends there has no arc back, so that offers may come from any distance.
    """
    back = costs.groupBy(F.col("v").alias("u"), F.col("u").alias("v")).agg(F.min("cost").alias("back"))
    return costs.join(large(back), ["u", "v"], "left").groupBy("v").agg(F.max(F.coalesce("back", F.lit(INF))).alias("hold"))


def search(state: DataFrame, advance: Callable[[DataFrame, float], DataFrame], hops: int, conf: ModelConf, step: float, reach: float) -> DataFrame:
    """All labels once ``advance(tail, front)``, which moves the labels of one job on, leaves nothing open; no arc costs more than
    ``reach``, and few labels are out of reach before everything open is farther out than that.

    A settled label has been expanded, so a node that enters its node and has an arc back has a label at most ``hold`` beyond it, and
    what is expanded later lies farther out.  This holds as long as every hop knows the whole tail.
    """
    moving = live(conf.search_radius)
    seen = {"n": F.count(F.lit(1)), "n_open": F.count_if(moving), "low": F.min(F.when(moving, F.col("dist")))}
    written, kept, front, low = [], [], step, 0.0
    while True:
        state, left = checkpoint_observed(advance(state, front), **seen, n_behind=F.count_if(out_of_reach(low)))
        few = left["n"] <= FEW_LABELS
        if not few:
            let_go(state.sparkSession)
        if not left["n_open"]:
            break
        low = left["low"]
        front = max(front + hops * step, low + step)
        if low > reach and (few or left["n_behind"] >= APART * left["n"]):
            if few:
                kept.append(settled_of(state, low))
            else:
                written.append(checkpoint(settled_of(state, low)))
            state = state.where(~out_of_reach(low))
    rest = [*kept, state.select("src", "node", "dist")]
    if kept or written:
        spark, kept, state = state.sparkSession, [], None
        rest = [checkpoint(reduce(DataFrame.unionByName, rest))]
        if written:
            let_go(spark)
    return reduce(DataFrame.unionByName, [*written, *rest])


def settled_of(state: DataFrame, low: float) -> DataFrame:
    return state.where(out_of_reach(low)).select("src", "node", "dist")


def out_of_reach(low: float) -> Column:
    """True for settled labels that no offer of a label at ``low`` or beyond can come to."""
    return F.col("dist") + F.col("hold") < F.lit(low)


def search_by_source(state: DataFrame, costs: DataFrame, conf: ModelConf, step: float = INF, reach: float = INF) -> DataFrame:
    costs, state = held(costs, state)
    stay = costs.select(F.explode(F.array(F.struct(F.col("u"), F.lit(0.0).alias("h")), F.struct(F.col("v").alias("u"), F.col("hold").alias("h")))).alias("x"))
    stay = stay.groupBy("x.u").agg(F.max("x.h").alias("hold"))
    stay = stay.select("u", F.col("u").alias("v"), F.lit(0.0).alias("cost"), "hold")
    table = checkpoint(costs.select("u", "v", "cost", "hold").unionByName(stay).withColumnRenamed("hold", "to_hold"))

    one_hop = HOP.format(within=within_sql(conf.search_radius), step=double(step))


    def several_hops(tail: DataFrame, front: float) -> DataFrame:
        return chained(one_hop, conf.hops_per_round, tail.withColumn("front", F.lit(front)), arcs=table).drop("front")

    with static_plans(state.sparkSession):
        return search(state, several_hops, conf.hops_per_round, conf, step, reach)


# One hop of the labels inside each source's partition. ``arcs`` also has a zero-cost arc from each node to itself, so an
# expanded label is passed on too, and any other label skips the lookup; a node without arcs leads nowhere. The front is a column
# that moves on with every hop: all hops read alike, and their compiled code is shared.
HOP = """
SELECT src, node, min(dist) AS dist, min(done) AS done, max(hold) AS hold, max(front) + {step} AS front FROM (
  SELECT /*+ BROADCAST(a) */ src, coalesce(v, node) AS node, dist + coalesce(cost, 0D) AS dist,
    CASE WHEN v = node THEN dist WHEN v IS NOT NULL THEN double('infinity') WHEN moves THEN dist ELSE done END AS done,
    coalesce(to_hold, hold) AS hold, front
  FROM (SELECT *, dist < done AND dist <= front{within} AS moves FROM {{rows}})
  LEFT JOIN {{arcs}} AS a ON CASE WHEN moves THEN node END = u
) GROUP BY src, node"""


def double(x: float) -> str:
    return f"double('{x!r}')"


def within_sql(radius: float) -> str:
    return "" if math.isinf(radius) else f" AND dist <= {double(radius)}"


def chained(query: str, times: int, rows: DataFrame, **tables: DataFrame) -> DataFrame:
    """``query`` over ``rows``, over its own result, and so on; as one statement, which is analysed once."""
    text = "{rows}"
    for _ in range(times):
        text = "(" + query.replace("{rows}", text) + ")"
    return rows.sparkSession.sql(f"SELECT * FROM {text}", rows=rows, **tables)


def held(costs: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``hold``; where the arcs do not tell, all labels stay in sight, as those of the sources do."""
    if "hold" not in costs.columns:
        costs = costs.withColumn("hold", F.lit(INF))
    return costs, state.withColumn("hold", F.lit(INF))


def search_by_hop(state: DataFrame, costs: DataFrame, conf: ModelConf, step: float = INF) -> DataFrame:
    """Hops that write only what they find: a layer holds the labels that the last hop made or made less, and those that wait for the front.

    What a node is known by is the least of all layers. Now and then the layers are put together, and settled labels that no
    offer can come to any more are laid aside.
    """
    spark = state.sparkSession
    arcs = large(settle(costs.select("u", "v", "cost"), "u", ordered=True))
    parts = partitions(spark)
    open_ = within(conf.search_radius)
    nothing, no = F.lit(None).cast("double").alias("offer"), F.lit(False).alias("waits")

    def next_layer(layer: DataFrame, before: list[DataFrame], front: float) -> DataFrame:
        due = F.col("dist") <= F.lit(front)
        offers = (
            layer.where(open_ & due)
            .join(arcs, F.col("node") == F.col("u"))
            .select("src", F.col("v").alias("node"), (F.col("dist") + F.col("cost")).alias("offer"))
        )
        rows = [x.select("src", "node", "dist", nothing, no) for x in before]
        rows.append(layer.select("src", "node", "dist", nothing, (open_ & ~due).alias("waits")))
        rows.append(offers.repartition(parts, "node").select("src", "node", F.lit(None).cast("double").alias("dist"), "offer", no))
        best = [F.min("dist").alias("dist"), F.min("offer").alias("offer"), F.bool_or("waits").alias("waits")]
        found = reduce(DataFrame.unionByName, rows).groupBy("src", "node").agg(*best)
        return found.where("waits OR dist IS NULL OR offer < dist").select("src", "node", F.least("dist", "offer").alias("dist"))

    seen = {"n": F.count(F.lit(1)), "n_open": F.count_if(open_), "low": F.min(F.when(open_, F.col("dist")))}
    layers, rows, aside, holds, front = [settle(state.select("src", "node", "dist"), "node")], [0], [], None, step
    with static_plans(spark):
        while True:
            found, left = checkpoint_observed(next_layer(layers[-1], layers[:-1], front), **seen)
            layers.append(found)
            rows.append(left["n"])
            if left["n"] > FEW_LABELS:
                let_go(spark)
            if not left["n_open"]:
                break
            front = max(front, left["low"]) + step
            if len(layers) > MOST_LAYERS:
                holds = checkpoint(holds_of(costs)) if holds is None else holds
                known = least_of(layers[:-1]).join(large(holds.withColumnRenamed("v", "node")), "node", "left")
                far = F.col("dist") + F.coalesce("hold", F.lit(INF)) < F.lit(left["low"])
                aside.append(checkpoint(known.where(far).select("src", "node", "dist")))
                layers = [checkpoint(known.where(~far).select("src", "node", "dist")), layers[-1]]
                rows = [sum(rows[:-1]), rows[-1]]
            slight = [i for i, n in enumerate(rows[:-1]) if n <= SLIGHT * sum(rows)]
            if len(slight) >= MOST_SLIGHT:
                together = checkpoint(reduce(DataFrame.unionByName, [layers[i] for i in slight]))
                layers = [together, *[x for i, x in enumerate(layers) if i not in slight]]
                rows = [sum(rows[i] for i in slight), *[n for i, n in enumerate(rows) if i not in slight]]
        labels, many = checkpoint(least_of(layers)), sum(rows) > FEW_LABELS
        layers.clear()
        if many:
            let_go(spark, wait=1.5)
        return reduce(DataFrame.unionByName, [*aside, labels])


def least_of(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, layers).groupBy("src", "node").agg(F.min("dist").alias("dist"))


def cost_matrix(labels: DataFrame, origins: DataFrame, destinations: DataFrame, n_zones: int, conf: ModelConf) -> DataFrame:
    """``(origin, destination, cost)``: zone pairs in reach, without pairs on the same node."""
    return zone_pairs(labels, origins, destinations, n_zones, conf).where("cost <> 0")


def zone_pairs(labels: DataFrame, origins: DataFrame, destinations: DataFrame, n_zones: int, conf: ModelConf) -> DataFrame:
    """Labels at zone nodes, named by zone instead of node; ``n_zones`` bounds ``destinations`` only."""
    at_origin = origins.select(F.col("zone_id").alias("origin"), F.col("node_id").alias("src"))
    at_dest = destinations.select(F.col("zone_id").alias("destination"), F.col("node_id").alias("node"))
    return (
        labels.join(small(at_dest, n_zones, conf.broadcast_rows), "node")
        .join(large(at_origin), "src")
        .select("origin", "destination", F.col("dist").alias("cost"))
    )
