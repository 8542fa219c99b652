"""Tables whose size Spark takes to be small are joined by shuffle where only their rows tell how large they are."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tripweave import Model, ModelConf, Network
from tests.test_search import SOURCES, labels, plain, random_edges
from tripweave.operators import skim, trees
from tripweave.operators.contraction import contract
from tripweave.operators.skim import shortest_dist
from tripweave.sources.tables import EDGES, ZONES, from_rows

N = 24


@pytest.fixture
def plans(monkeypatch):
    """The plans of everything that is checkpointed."""
    found, real = [], DataFrame.checkpoint

    def seen(self, *args, **options):
        found.append(self._jdf.queryExecution().executedPlan().toString())
        return real(self, *args, **options)

    monkeypatch.setattr(DataFrame, "checkpoint", seen)
    return found


def line(spark, n):
    """A street of ``n`` edges of length 1; Spark guesses that it is tiny, whatever ``n`` is."""
    return spark.range(n).selectExpr(
        "id AS edge_id", "id AS source_node", "id + 1 AS target_node", "1.0D AS length", "0.0D AS travel_time", "false AS is_oneway"
    )


def test_contraction_sends_no_table_to_all(spark, plans):
    ends = spark.range(2).select((F.col("id") * N).alias("node"))
    small = contract(Network.from_edges(line(spark, N)), ends)
    assert [tuple(r) for r in small.links.select("source_node", "target_node", "length").collect()] in ([(0, N, 24.0)], [(N, 0, 24.0)])
    assert sorted(r.edge_id for r in small.members.collect()) == list(range(N))
    members = small.members.where("seq > 0")
    assert len(plans) > 6 and not any("Broadcast" in plan for plan in plans)
    assert members.count() == N


def test_chain_merge_joins_members_by_shuffle(spark):
    from tripweave.plans.catalog import queries

    assert "Broadcast" not in queries()["chain_merge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_arcs_of_a_large_network_are_not_sent(spark, plans):
    """By default already some ten megabytes of arcs are too many to send to all in every round."""
    net = Network.from_edges(line(spark, 120_000))
    found = shortest_dist(net, spark.createDataFrame([(5,), (60_000,)], "src long"), ModelConf(time_coef=0.0, search_radius=3.0))
    assert {(r.src, r.node): r.dist for r in found.collect()} == {(s, s + i): abs(i) for s in (5, 60_000) for i in range(-4, 5)}
    assert not any("Broadcast" in plan for plan in plans)


def test_a_hop_moves_offers_only(spark, plans):
    sources = spark.range(N).withColumnRenamed("id", "src")
    found = shortest_dist(Network.from_edges(line(spark, N)), sources, ModelConf(time_coef=0.0, broadcast_rows=0))
    assert {(r.src, r.node): r.dist for r in found.collect()} == {(s, n): abs(s - n) for s in range(N) for n in range(N + 1)}
    hops = [plan for plan in plans if "Union" in plan and "SortMergeJoin" in plan]
    assert len(hops) >= N / 2 and all(plan.count("Exchange") == 1 for plan in hops)


def test_a_model_sends_no_table_beyond_its_bound(spark, plans):
    zones = spark.range(0, N + 1, 4).selectExpr("id AS zone_id", "id AS node_id", "id + 1.0D AS trips")
    counts = spark.range(0, N, 5).selectExpr("id AS edge_id", "10.0D + id AS traffic")
    results = []
    for bound in (0, 1_000):
        plans.clear()
        conf = ModelConf(time_coef=0.0, alpha=1.0, beta=-0.3, search_radius=math.inf, broadcast_rows=bound)
        model = Model(Network.from_edges(line(spark, N)), zones, conf)
        od = model.gravity_od()
        counted = model.counted(model.costs, counts).settle()
        fitted, _, fit = model.gravity_od_simplex((0.0, 0.05, 1.0), counted, 1, 0.1)
        limit = lambda trips, mode, level: trips * (0.5 if mode == "lo" else 2.0)
        tables = [
            od, fitted, model.assign(od), model.assign_v1(od), model.calibrate(od, counted, 1, "PR")[0].select("origin", "destination", "trips"),
            model.calibrate_lagrange(od, counted, 0, 0, 1.0, limit)["cells"].select("origin", "destination", "trips"),
            model.paths_with_trips(od).select("origin", "destination", F.size("path")),
        ]
        if bound == 0:
            assert len(plans) > 40 and not any("Broadcast" in plan for plan in plans)
            assert not any("Broadcast" in t._jdf.queryExecution().executedPlan().toString() for t in tables)
        results.append([{tuple(r[:-1]): r[-1] for r in t.collect()} for t in tables])
    assert all(results[0]) and all(a == pytest.approx(b) for a, b in zip(*results, strict=True))


def grid(spark, width=7):
    """Streets both ways in a square, of many lengths, with faster ones across; every third is one-way."""
    rows = []
    for k in range(width * width):
        steps = [(k + 1, (k + 1) % width), (k + width, k + width < width * width), (k + 3, k % 4 == 0)]
        rows += [(k, to, float(1 + (5 * k + to) % 7), k % 3 == 1) for to, there in steps if there and to < width * width]
    return from_rows(spark, [(i, s, t, cost, 0.0, oneway) for i, (s, t, cost, oneway) in enumerate(rows)], EDGES), width * width


def test_hops_write_each_label_a_few_times_only(spark, monkeypatch):
    edges, n = grid(spark)
    written, real = [], skim.checkpoint_observed
    monkeypatch.setattr(skim, "checkpoint_observed", lambda df, **m: written.append(real(df, **m)) or written[-1])
    sources = spark.range(n).withColumnRenamed("id", "src")
    found = labels(shortest_dist(Network.from_edges(edges), sources, ModelConf(time_coef=0.0, broadcast_rows=0)))
    rows = [tuple(r) for r in edges.collect()]
    assert found == {(s, v): d for s in range(n) for v, d in plain(rows, s).items()}
    assert len(written) > 8 and sum(df.count() for df, _ in written) <= 2 * len(found)


@pytest.mark.parametrize("layers, slight, share", [(3, 6, 0.02), (40, 2, 0.9), (2, 2, 0.3)])
def test_layers_put_together_lose_nothing(spark, monkeypatch, layers, slight, share):
    monkeypatch.setattr(skim, "MOST_LAYERS", layers)
    monkeypatch.setattr(skim, "MOST_SLIGHT", slight)
    monkeypatch.setattr(skim, "SLIGHT", share)
    rows = random_edges(5, nodes=60, n=200, least=0)
    sources = spark.createDataFrame([(s,) for s in SOURCES], "src long")
    for radius in (math.inf, 7.0):
        conf = ModelConf(time_coef=0.0, broadcast_rows=0, search_radius=radius)
        found = shortest_dist(Network.from_edges(from_rows(spark, rows, EDGES)), sources, conf)
        assert found.count() == len(labels(found))
        assert labels(found) == {(s, v): d for s in SOURCES for v, d in plain(rows, s, radius).items()}
    edges, n = grid(spark)
    found = shortest_dist(Network.from_edges(edges), sources.where(f"src < {n}"), ModelConf(time_coef=0.0, broadcast_rows=0))
    want = [tuple(r) for r in edges.collect()]
    assert labels(found) == {(s, v): d for s in SOURCES if s < n for v, d in plain(want, s).items()} and found.count() == len(labels(found))


def test_settled_labels_written_apart_are_all_there(spark, monkeypatch):
    monkeypatch.setattr(skim, "FEW_LABELS", 0)
    monkeypatch.setattr(skim, "APART", 0.01)
    edges, n = grid(spark)
    conf = ModelConf(time_coef=0.0, hops_per_round=1, band=0.5)
    found = shortest_dist(Network.from_edges(edges), spark.range(n).withColumnRenamed("id", "src"), conf)
    rows = [tuple(r) for r in edges.collect()]
    assert labels(found) == {(s, v): d for s in range(n) for v, d in plain(rows, s).items()} and found.count() == len(labels(found))


def test_a_hold_is_the_dearest_way_back(spark):
    rows = [(1, 0, 1, 2.0, 0.0, False), (2, 0, 1, 5.0, 0.0, False), (3, 2, 1, 3.0, 0.0, False), (4, 1, 3, 1.0, 0.0, True)]
    costs = Network.from_edges(from_rows(spark, rows, EDGES)).arc_costs(1.0, 0.0)
    assert {r.v: r.hold for r in skim.holds_of(costs).collect()} == {0: 2.0, 1: 3.0, 2: 3.0, 3: math.inf}


def test_paths_are_walked_by_shares_of_the_sources(spark, monkeypatch):
    edges, n = grid(spark)
    zones = from_rows(spark, [(100 + i, i, 1.0 + i) for i in range(0, n, 2)] + [(7, 900, 1.0)], ZONES)
    edges = edges.unionByName(from_rows(spark, [(999, 900, 901, 1.0, 0.0, False)], EDGES))
    network, results, grown, real = Network.from_edges(edges), [], [], trees.shortest_tree
    monkeypatch.setattr(trees, "shortest_tree", lambda *args: grown.append(real(*args)) or grown[-1])
    for most in (10_000_000, 200):
        grown.clear()
        model = Model(network, zones, ModelConf(time_coef=0.0, tree_rows=most))
        od = model.zones.select(model.zones.zone_id.alias("origin")).crossJoin(model.zones.select(model.zones.zone_id.alias("destination")))
        od = od.withColumn("trips", F.col("origin") * 1.0)
        results.append({(r.origin, r.destination): (r.trips, r.path) for r in model.paths_with_trips(od).collect()})
        sizes = [t.count() for t in grown]
    assert results[0] == results[1] and results[1][7, 100] == (7.0, []) and len(results[1]) == 26 * 26
    assert len(sizes) > 4 and max(sizes) < 700


def test_networks_of_one_folder_share_their_links(spark):
    from tripweave.plans.catalog import driver_network

    near, far = (driver_network(spark, "/root/testdata/sf0.001", **o) for o in ({"search_radius": 3.0}, {}))
    assert near.network is far.network and near.zones is far.zones
    assert (near.conf.search_radius, far.conf.search_radius) == (3.0, 40.0) and near.model is not far.model
