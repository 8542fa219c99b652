"""Searches, trees and paths against a plain search over a small random network."""

import heapq
import math
import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from tripweave import Model, ModelConf, Network
from tripweave.operators import skim, trees
from tripweave.operators.contraction import contract
from tripweave.operators.paths import hits_by_shrinking, hits_by_walking
from tripweave.operators.skim import shortest_dist
from tripweave.plans.model import Skim
from tripweave.sources.tables import EDGES, ZONES, from_rows


def random_edges(seed, nodes=40, n=90, least=1):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(nodes), rng.randrange(nodes), float(rng.randint(least, 9)), 0.0, rng.random() < 0.3) for i in range(n)]
    return rows + [(n, 3, 3, 1.0, 0.0, False), (n + 1, *rows[0][1:]), (n + 2, 900, 901, 1.0, 0.0, False)]


def arcs_of(rows):
    out = defaultdict(list)
    for e, s, t, length, _, oneway in rows:
        if s != t:
            out[s].append((t, length, e))
            if not oneway:
                out[t].append((s, length, e))
    return out


def plain(rows, src, radius=math.inf):
    arcs, dist, queue = arcs_of(rows), {src: 0.0}, [(0.0, src)]
    while queue:
        d, u = heapq.heappop(queue)
        if d > radius:
            break
        if d > dist[u]:
            continue
        for v, c, _ in arcs[u]:
            if d + c < dist.get(v, math.inf):
                dist[v] = d + c
                heapq.heappush(queue, (d + c, v))
    return dist


ROWS = random_edges(7)
SOURCES = sorted({r[1] for r in ROWS if r[1] != r[2] and r[1] < 900})[:12]


def labels(df):
    return {(r.src, r.node): r.dist for r in df.collect()}


def expected(rows, radius=math.inf):
    return {(s, n): d for s in SOURCES for n, d in plain(rows, s, radius).items()}


@pytest.fixture(scope="module")
def network(spark):
    return Network.from_edges(from_rows(spark, ROWS, EDGES))


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(s,) for s in SOURCES], "src long")


@pytest.mark.parametrize("radius", [math.inf, 6.0])
@pytest.mark.parametrize("broadcast_rows", [8_000_000, 0])
def test_labels_either_way_of_joining(network, sources, radius, broadcast_rows):
    conf = ModelConf(time_coef=0.0, search_radius=radius, broadcast_rows=broadcast_rows, hops_per_round=3)
    assert labels(shortest_dist(network, sources, conf)) == expected(ROWS, radius)


def test_strict_radius(network, sources):
    conf = ModelConf(time_coef=0.0, search_radius=6.0)
    found = labels(shortest_dist(network, sources, conf, strict_radius=True))
    assert found == {k: d for k, d in expected(ROWS, 6.0).items() if d <= 6.0}


def zones_at(spark, nodes):
    return from_rows(spark, [(100 + i, n, 1.0 + i) for i, n in enumerate(nodes)], ZONES)


def check_paths(rows, model):
    ends = {r.zone_id: r.node_id for r in model.zones.collect()}
    edge = {r[0]: r for r in rows}
    found = model.shortest_paths().collect()
    for r in found:
        at, cost = ends[r.origin], 0.0
        for e in r.path:
            _, s, t, length, _, oneway = edge[e]
            assert at == s or (at == t and not oneway)
            at, cost = (t if at == s else s), cost + length
        assert at == ends[r.destination] and cost == r.cost
    return {(r.origin, r.destination): r.path for r in found}


def test_paths_are_walkable_and_cheapest(spark, network):
    model = Model(network, zones_at(spark, SOURCES), ModelConf(time_coef=0.0))
    paths = check_paths(ROWS, model)
    assert len(paths) == sum(1 for s in SOURCES for n, d in plain(ROWS, s).items() if n in SOURCES and d)
    od = model.cost_matrix().withColumnRenamed("cost", "trips")
    one = {r.edge_id: r.volume for r in model.assign(od).collect()}
    assert one == pytest.approx({r.edge_id: r.volume for r in model.assign_v1(od).collect()})
    cost = {(r.origin, r.destination): r.trips for r in od.collect()}
    by_hand = defaultdict(float)
    for pair, path in paths.items():
        for e in path:
            by_hand[e] += cost[pair]
    assert one == pytest.approx(dict(by_hand))
    counts = spark.createDataFrame([(e, 1.0) for e in list(by_hand)[::3] + [5000]], "edge_id long, traffic double")
    counted = {r[0] for r in counts.collect()}
    hits = sorted(tuple(r) for r in model.counted(od, counts).incidence.collect())
    assert hits == sorted((o, d, e) for (o, d), path in paths.items() for e in path if e in counted)
    starts = model.pairs(od).select("src", "node").distinct()
    links = counts.selectExpr("edge_id AS link_id")
    walked = hits_by_walking(starts, model.skim.tree, model.skim.levels).join(links, "link_id")
    shrunk = hits_by_shrinking(starts, model.skim.tree, links, links.count(), model.conf).join(links, "link_id")
    columns = ["src", "node", "link_id"]
    assert sorted(map(tuple, walked.select(columns).collect())) == sorted(map(tuple, shrunk.select(columns).collect()))


def test_assignment_from_some_origins(spark, network):
    model = Model(network, zones_at(spark, SOURCES), ModelConf(time_coef=0.0))
    few = model.zones.where("zone_id < 103")
    od = model.cost_matrix(few).withColumnRenamed("cost", "trips")
    partial = {r.edge_id: r.volume for r in model.assign(od, model.skim_of(few)).collect()}
    assert partial == pytest.approx({r.edge_id: r.volume for r in model.assign(od).collect()})
    everything = model.cost_matrix().withColumnRenamed("cost", "trips")
    assert partial == pytest.approx({r.edge_id: r.volume for r in model.assign_v1(everything, few).collect()})


def test_free_arcs_give_walkable_paths(spark):
    rows = random_edges(11, least=0)
    model = Model(Network.from_edges(from_rows(spark, rows, EDGES)), zones_at(spark, SOURCES[:6]), ModelConf(time_coef=0.0))
    check_paths(rows, model)


def test_equal_parallel_edges_take_the_smallest_id(spark):
    rows = [(9, 1, 2, 1.0, 0.0, False), (4, 1, 2, 1.0, 0.0, False), (6, 2, 1, 1.0, 0.0, False)]
    model = Model(Network.from_edges(from_rows(spark, rows, EDGES)), zones_at(spark, [1, 2]), ModelConf())
    assert all(p == [4] for p in check_paths(rows, model).values())


def test_co_located_zones_share_a_search(spark, network):
    model = Model(network, zones_at(spark, [SOURCES[0], SOURCES[0], SOURCES[1]]), ModelConf(time_coef=0.0))
    cost = {(r.origin, r.destination) for r in model.cost_matrix().collect()}
    assert (100, 101) not in cost and (101, 100) not in cost
    assert ((100, 102) in cost) == ((101, 102) in cost)


def chain_rows():
    rows = []
    for i, (s, t, oneway) in enumerate([(1, 2, False), (2, 3, True), (3, 1, False), (1, 4, False), (2, 4, False)]):
        inner = [s] + [1000 + 10 * i + j for j in range(i + 1)] + [t]
        for j, (a, b) in enumerate(zip(inner, inner[1:])):
            flip = j % 2 == 1 and not oneway
            rows.append((50 * i + j, b if flip else a, a if flip else b, float(1 + j), 0.0, oneway))
    ring = [(700, 71, 72, 1.0, 0.0, False), (701, 72, 73, 1.0, 0.0, False), (702, 73, 71, 1.0, 0.0, False)]
    dead = [(800, 1, 81, 0.5, 0.0, True), (801, 4, 81, 0.5, 0.0, True)]
    back = [(900, 2, 91, 1.0, 0.0, False), (901, 91, 92, 1.0, 0.0, False), (902, 92, 2, 1.0, 0.0, False)]
    return rows + ring + dead + back


def test_contraction_keeps_costs_paths_and_volumes(spark):
    rows = chain_rows()
    network = Network.from_edges(from_rows(spark, rows, EDGES))
    zones = zones_at(spark, [1, 2, 3, 4])
    small = contract(network, spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long"))
    assert small.link_count() == 5 + 3
    conf = ModelConf(time_coef=0.0)
    full, merged = Model(network, zones, conf), Model(small, zones, conf)
    as_dict = lambda df: {(r.origin, r.destination): r.cost for r in df.collect()}
    assert as_dict(full.cost_matrix()) == as_dict(merged.cost_matrix())
    assert check_paths(rows, merged) == check_paths(rows, full)
    od = full.cost_matrix().withColumnRenamed("cost", "trips")
    volumes = lambda m: {r.edge_id: r.volume for r in m.assign(od).collect()}
    assert volumes(merged) == pytest.approx(volumes(full))
    counts = spark.createDataFrame([(0, 1.0), (1, 1.0), (51, 1.0), (151, 2.0)], "edge_id long, traffic double")
    incidence = lambda m: sorted(map(tuple, m.counted(od, counts).incidence.collect()))
    assert incidence(merged) == incidence(full)
    with pytest.raises(ValueError, match="already"):
        contract(small, zones.selectExpr("node_id AS node"))


def test_skim_is_computed_once(network, sources):
    skim = Skim(network, sources, ModelConf(time_coef=0.0))
    assert skim.labels is skim.labels and skim.levels is skim.levels


def test_levels_move_no_rows(spark, network, sources, monkeypatch):
    plans, real = [], trees.checkpoint
    monkeypatch.setattr(trees, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    levels = Skim(network, sources, ModelConf(time_coef=0.0)).levels
    assert levels.keys == ("src",) and len(levels) > 2 and len(plans) >= len(levels) - 1
    assert all("Exchange" not in plan for plan in plans)
    loads = levels[0].select("src", "node", F.lit(1.0).alias("load"))
    plans.clear()
    trees.sum_up(loads, levels)
    assert plans[0].count("Exchange") <= 1  # the loads come to their sources once at most


@pytest.mark.parametrize("band", [0.25, 1.0, math.inf])
@pytest.mark.parametrize("broadcast_rows", [8_000_000, 0])
def test_bands_give_the_same_labels(spark, sources, band, broadcast_rows):
    rows = random_edges(11, nodes=60, n=200, least=0)
    net = Network.from_edges(from_rows(spark, rows, EDGES))
    conf = ModelConf(time_coef=0.0, broadcast_rows=broadcast_rows, hops_per_round=2, band=band)
    assert labels(shortest_dist(net, sources, conf)) == {(s, n): d for s in SOURCES for n, d in plain(rows, s).items()}


def test_a_round_is_one_job(spark, network, sources, monkeypatch):
    rounds, real = [], skim.checkpoint_observed
    monkeypatch.setattr(skim, "checkpoint_observed", lambda df, **m: rounds.append(real(df, **m)) or rounds[-1])
    costs = network.arc_costs(1.0, 0.0)
    start = sources.repartition(8, "src").select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.lit(math.inf).alias("done"))
    spark.sparkContext.setJobGroup("rounds", "search")
    skim.search_by_source(start, costs, ModelConf(time_coef=0.0, hops_per_round=2), 4.0, 9.0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    assert len(rounds) > 3
    # Each round sends the arcs to all tasks and writes the labels; before the first the table of arcs is made, at the end all labels are put together.
    assert jobs <= 2 * len(rounds) + 4
    assert rounds[-1][1]["n_open"] == 0 and all(r[1]["n_open"] for r in rounds[:-1])


def test_settled_labels_are_not_written_again(spark, monkeypatch):
    rows = [(i, i, i + 1, 1.0, 0.0, False) for i in range(60)]
    net = Network.from_edges(from_rows(spark, rows, EDGES))
    sizes, real = [], skim.checkpoint_observed
    monkeypatch.setattr(skim, "checkpoint_observed", lambda df, **m: sizes.append(real(df, **m)) or sizes[-1])
    found = shortest_dist(net, spark.createDataFrame([(0,)], "src long"), ModelConf(time_coef=0.0, hops_per_round=4))
    assert labels(found) == {(0, i): float(i) for i in range(61)}
    written = [df.count() for df, _ in sizes[1:]]
    assert len(written) > 10 and max(written) <= 8


@pytest.mark.parametrize("some", [1, 12])
@pytest.mark.parametrize("step", [0.0, 3.0, math.inf])
def test_sweep_sums_subtrees(network, sources, some, step):
    tree = Skim(network, sources.limit(some), ModelConf(time_coef=0.0)).tree
    loads = tree.where("node % 3 <> 0").select("src", "node", F.when(F.col("node") % 5 != 0, F.col("node") - 7.0).alias("load"))
    above = {(r.src, r.node): (r.up, r.link_id) for r in tree.collect()}
    expect = {}
    for r in loads.collect():
        at = r.node
        while at != r.src:
            up, link = above[r.src, at]
            expect.setdefault((r.src, at, link), []).append(r.load)
            at = up
    total = {k: None if all(x is None for x in v) else sum(x for x in v if x is not None) for k, v in expect.items()}
    found = trees.sweep_up(loads, tree, step, 3).collect()
    assert {(r.src, r.node, r.link_id): r.load for r in found} == total and len(found) == len(total)
    assert trees.sweep_up(loads.limit(0), tree, step, 3).collect() == []


def test_assignment_builds_no_levels(spark, network, monkeypatch):
    model = Model(network, zones_at(spark, SOURCES), ModelConf(time_coef=0.0))
    od = model.cost_matrix().withColumnRenamed("cost", "trips")
    volumes = {r.edge_id: r.volume for r in model.assign(od, sweep=True).collect()}
    assert "levels" not in model.skim.__dict__
    assert volumes == pytest.approx({r.edge_id: r.volume for r in model.assign(od).collect()})
    assert volumes == pytest.approx({r.edge_id: r.volume for r in model.assign_v1(od).collect()})
