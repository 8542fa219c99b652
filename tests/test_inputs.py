"""Bad or odd inputs, searches from some origins, and the derived tables."""

import math

import pytest
from pyspark.sql import functions as F

from tripweave import Model, ModelConf, Network
from tripweave.operators.skim import search_by_hop, shortest_dist
from tripweave.plans.driver_network import derive_chains, derive_counts, derive_edges, derive_zones, table
from tripweave.sources.tables import COUNTS, EDGES, ZONES, from_rows

LINE = [(1, 10, 20, 2.0, 1.0, False), (2, 20, 30, 3.0, 1.0, False), (3, 30, 40, math.inf, 1.0, False), (4, 20, 50, 1.0, 1.0, True)]
ZONE_ROWS = [(1, 10, 5.0), (2, 20, 3.0), (3, 30, 4.0), (4, 40, 2.0)]


def model(spark, edges=LINE, zones=ZONE_ROWS, **options):
    conf = ModelConf(time_coef=0.0, alpha=1.0, beta=-0.1, deterrence="exponencial", **options)
    return Model(Network.from_edges(from_rows(spark, edges, EDGES)), from_rows(spark, zones, ZONES), conf)


@pytest.mark.parametrize("broadcast_rows", [8_000_000, 0])
def test_an_edge_of_infinite_length_leads_nowhere(spark, broadcast_rows):
    m = model(spark, broadcast_rows=broadcast_rows)
    near = {1: {2: 2.0, 3: 5.0}, 2: {1: 2.0, 3: 3.0}, 3: {1: 5.0, 2: 3.0}}
    want = {(o, d): c for o, row in near.items() for d, c in row.items()}
    assert {(r.origin, r.destination): r.cost for r in m.cost_matrix().collect()} == want
    od = m.gravity_od()
    assert {(r.origin, r.destination) for r in od.collect() if r.trips > 0} == set(want)
    assert {(r.origin, r.destination): r.path for r in m.shortest_paths().collect()}[1, 3] == [1, 2]
    assert {r.edge_id for r in m.assign(od).collect()} == {1, 2}


@pytest.mark.parametrize("value", [None, math.nan, math.inf, -1.0])
def test_amounts_are_checked(spark, value):
    with pytest.raises(ValueError, match=r"zones: trips .*\(2, "):
        model(spark, zones=[(1, 10, 1.0), (2, 20, value)])
    with pytest.raises(ValueError, match=r"counts: traffic .*\(2, "):
        model(spark).counts(from_rows(spark, [(1, 1.0), (2, value)], COUNTS))


def test_weights_are_checked(spark):
    with pytest.raises(ValueError, match="negative"):
        ModelConf().set("length_coef", -1)
    with pytest.raises(ValueError, match="negative"):
        Network.from_edges(from_rows(spark, LINE, EDGES)).arc_costs(1.0, -0.5)


def test_pairs_of_unknown_zones_raise(spark):
    m = model(spark)
    od = spark.createDataFrame([(1, 2, 1.0), (1, 77, 1.0)], "origin long, destination long, trips double")
    for run in (m.assign, m.paths_with_trips, m.path_links):
        with pytest.raises(ValueError, match="77"):
            run(od)


def test_only_origins_in_use_are_searched(spark):
    m, whole = model(spark), model(spark)
    od = spark.createDataFrame([(1, 3, 2.0), (1, 2, 1.0)], "origin long, destination long, trips double")
    assert {r.src for r in m.skim_for(od).labels.select("src").distinct().collect()} == {10}
    volumes = lambda x: {r.edge_id: r.volume for r in x.collect()}
    assert volumes(m.assign(od)) == volumes(whole.assign(od, whole.skim)) == {1: 3.0, 2: 2.0}
    assert "skim" not in m.__dict__ and whole.skim_for(od) is whole.skim
    some = m.zones.where("zone_id = 1")
    assert {r.origin for r in m.shortest_paths(origins=some).collect()} == {1}
    counts = from_rows(spark, [(1, 10.0)], COUNTS)
    assert {r.origin for r in m.gravity_od_k((0, 0.01, 1), counts, some).collect()} == {1}
    assert {r.origin for r in m.gravity_od_simplex((0, 0.01, 1), counts, 1, 0.1, some)[0].collect()} == {1}


def test_one_hop_at_a_time_with_arcs_sent_to_all(spark):
    m = model(spark)
    sources = spark.createDataFrame([(10,), (30,)], "src long")
    start = sources.select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.lit(math.inf).alias("done"))
    found = search_by_hop(start, F.broadcast(m.network.arc_costs(1.0, 0.0)), m.conf)
    rows = lambda df: sorted((r.src, r.node, r.dist) for r in df.collect())
    assert rows(found) == rows(shortest_dist(m.network, sources, m.conf))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_derived_tables_lose_nothing(spark, sf):
    read = lambda name: table(spark, f"/root/testdata/{sf}", name)
    counts = derive_counts(read("customer"), read("lineitem"))
    zones = derive_zones(read("customer"), read("orders"))
    total = lambda df, c: df.agg(F.sum(c)).first()[0]
    assert total(counts, "traffic") == read("lineitem").count() and total(zones, "trips") == read("orders").count()
    edges = derive_edges(read("customer")).where("source_node <> target_node")
    assert counts.join(edges, "edge_id", "left_anti").count() == 0
    assert zones.join(read("customer"), F.col("node_id") == F.col("c_custkey"), "left_anti").count() == 0


def test_chain_ids_never_meet(spark):
    customers = spark.range(300_000).selectExpr("id c_custkey", "id % 25 c_nationkey", "double(id % 100) c_acctbal")
    chains = derive_chains(derive_edges(customers))
    assert chains.groupBy("edge_id").count().where("count > 1").count() == 0
    new = chains.selectExpr("explode(array(source_node, target_node)) node").where("node < 0").groupBy("node").count()
    assert new.where("count <> 2").count() == 0
