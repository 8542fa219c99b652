"""The two-edge example, with results worked out by hand."""

import math

import pytest

from tripweave import Model, ModelConf, Network
from tripweave.operators import demand
from tripweave.sources.tables import COUNTS, EDGES, ZONES, from_rows


@pytest.fixture(scope="module")
def example(spark):
    # Fixed values of the published example.
    edges = from_rows(spark, [(1, 1, 2, 10.0, 15.0, False), (2, 2, 3, 17.0, 13.0, False)], EDGES)
    zones = from_rows(spark, [(1, 1, 20.0), (2, 3, 30.0)], ZONES)
    counts = from_rows(spark, [(1, 25.0), (2, 45.0)], COUNTS)
    conf = ModelConf()
    for name, value in (("length_coef", "0.7"), ("time_coef", "0.3"), ("alpha", "1"), ("beta", "-0.3"), ("gamma", "1"),
                        ("F", "log_normal"), ("search_radius", "50")):
        conf = conf.set(name, value)
    return Model(Network.from_edges(edges), zones, conf), counts


def pairs(df, value="trips"):
    return {(r["origin"], r["destination"]): pytest.approx(r[value], abs=1e-9) for r in df.collect()}


def test_cost(example):
    assert pairs(example[0].cost_matrix(), "cost") == {(1, 2): 27.3, (2, 1): 27.3}


def test_gravity(example):
    assert pairs(example[0].gravity_od()) == {(1, 2): 30.0, (2, 1): 20.0}


def test_scaled_gravity(example):
    model, counts = example
    assert pairs(model.gravity_od_k((0, 0.012, 1), counts)) == {(1, 2): 21.0, (2, 1): 14.0}


def test_paths(example):
    model, _ = example
    assert {(r.origin, r.destination): r.path for r in model.shortest_paths().collect()} == {(1, 2): [1, 2], (2, 1): [2, 1]}


def test_assignment(example):
    model, _ = example
    od = model.gravity_od()
    for volumes in (model.assign(od), model.assign_v1(od)):
        assert {r.edge_id: r.volume for r in volumes.collect()} == {1: 50.0, 2: 50.0}


def test_error(example):
    model, counts = example
    volumes = model.assign(model.gravity_od())
    c = model.counts(counts)
    assert demand.rmse(volumes, c.table, c.n, model.conf).first()[0] == pytest.approx(math.sqrt(325))


@pytest.mark.parametrize("method", ["GM", "FR", "PR"])
def test_calibration_stays_at_its_fixpoint(example, method):
    model, counts = example
    od, history = model.calibrate(model.gravity_od(), counts, 3, method)
    assert pairs(od) == {(1, 2): 21.0, (2, 1): 14.0}
    assert history[0]["step"] == pytest.approx(0.01)
    assert [h["rmse"] for h in history] == pytest.approx([math.sqrt(325), 10.0, 10.0])
    assert {r.edge_id: r.volume for r in model.assign(od).collect()} == {1: 35.0, 2: 35.0}


def test_fit_improves(example):
    model, counts = example
    _, _, found = model.gravity_od_simplex((0, 0.05, 1), counts, 4, 0.1)
    assert len(found.history) == 4
    assert found.z <= found.history[0]["z"]
