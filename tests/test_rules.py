"""Input checks, guards and properties of the models."""

import math

import pytest
from pyspark.sql import functions as F

from tripweave import Model, ModelConf, Network
from tripweave.operators import calibration, constrained, fit
from tripweave.sources.tables import COUNTS, EDGES, ZONES, from_rows

GRID = [(10 * x + y, 10 * x + y, 10 * x + y + 1, 1.0 + (x * y) % 3, 1.0, False) for x in range(4) for y in range(3)]
GRID += [(100 + 10 * x + y, 10 * x + y, 10 * x + y + 10, 2.0 + (x + y) % 2, 1.0, (x + y) % 5 == 4) for x in range(3) for y in range(4)]
ZONE_ROWS = [(1, 0, 40.0), (2, 3, 25.0), (3, 30, 10.0), (4, 33, 55.0), (5, 12, 20.0)]


@pytest.fixture(scope="module")
def model(spark):
    conf = ModelConf(length_coef=1.0, time_coef=0.5, alpha=1.0, beta=-0.2, deterrence="exponencial")
    return Model(Network.from_edges(from_rows(spark, GRID, EDGES)), from_rows(spark, ZONE_ROWS, ZONES), conf)


@pytest.fixture(scope="module")
def counts(spark):
    return from_rows(spark, [(0, 12.0), (20, 30.0), (102, 9.0), (111, 14.0), (9999, 7.0)], COUNTS)


@pytest.fixture(scope="module")
def od(model):
    return model.gravity_od()


def test_unknown_settings_raise(spark):
    with pytest.raises(ValueError):
        ModelConf().set("searchRadius", "50")
    with pytest.raises(ValueError):
        ModelConf().set("F", "linear")
    with pytest.raises(ValueError):
        ModelConf().set("F", "top_log_normal").deterrence_of(F.lit(1.0))


def test_own_deterrence_function(model):
    conf = model.conf.set("F", lambda cost: 1.0 / (cost + 1.0))
    row = model.costs.select("cost", conf.deterrence_of(F.col("cost")).alias("f")).first()
    assert row.f == pytest.approx(1 / (row.cost + 1))


def test_bad_inputs_raise(spark, model, counts, od):
    with pytest.raises(ValueError, match="more than once"):
        model.counts(counts.union(counts))
    zones = from_rows(spark, ZONE_ROWS, ZONES)
    with pytest.raises(ValueError, match="more than once"):
        Model(model.network, zones.union(zones), model.conf)
    with pytest.raises(ValueError, match="do not exist"):
        Model(model.network, zones.union(from_rows(spark, [(9, 555, 1.0)], ZONES)), model.conf)
    with pytest.raises(ValueError, match="negative"):
        Network.from_edges(from_rows(spark, [(1, 1, 2, -1.0, 1.0, False)], EDGES))
    with pytest.raises(ValueError, match="unknown method"):
        model.calibrate(od, counts, 1, "XX")


def test_no_counted_edge_on_any_path(spark, model, od):
    with pytest.raises(ValueError, match="no counted edge"):
        model.calibrate(od, from_rows(spark, [(9999, 1.0)], COUNTS), 1, "GM")


def test_columns_match_after_one_pass(model, od):
    totals = {r.destination: r.t for r in od.groupBy("destination").agg(F.sum("trips").alias("t")).collect()}
    assert totals == pytest.approx({z: t for z, _, t in ZONE_ROWS})


def test_more_passes_match_rows_too(model):
    od = model.gravity_od(max_iter=30)
    totals = {r.origin: r.t for r in od.groupBy("origin").agg(F.sum("trips").alias("t")).collect()}
    assert totals == pytest.approx({z: t for z, _, t in ZONE_ROWS}, rel=0.03)


def test_zone_without_trips_is_left_out(spark, model):
    zones = from_rows(spark, ZONE_ROWS[:-1] + [(5, 12, 0.0)], ZONES)
    other = Model(model.network, zones, model.conf)
    assert [r.zone_id for r in other.idle_zones().collect()] == [5]
    od = other.gravity_od().collect()
    assert od and all(5 not in (r.origin, r.destination) and r.trips == r.trips for r in od)


def test_gradient_round_does_not_raise_the_error(model, counts, od):
    calibrated, history = model.calibrate(od, counts, 5, "GM")
    errors = [h["rmse"] for h in history]
    assert errors == sorted(errors, reverse=True)
    assert calibrated.where("trips < -1e-9").count() == 0
    hit = model.counted(od, counts).incidence.select("origin", "destination").distinct()
    keep = od.join(hit, ["origin", "destination"], "left_anti")
    same = keep.join(calibrated.withColumnRenamed("trips", "new"), ["origin", "destination"]).where("trips <> new")
    assert same.count() == 0


def test_unreachable_pair_keeps_its_trips(spark, model):
    rows = GRID + [(900, 90, 91, 1.0, 1.0, False)]
    zones = from_rows(spark, ZONE_ROWS + [(6, 90, 5.0)], ZONES)
    apart = Model(Network.from_edges(from_rows(spark, rows, EDGES)), zones, model.conf)
    od = spark.createDataFrame([(1, 4, 10.0), (1, 6, 3.0)], "origin long, destination long, trips double")
    paths = {(r.origin, r.destination): (r.trips, r.path) for r in apart.paths_with_trips(od).collect()}
    assert paths[(1, 6)] == (3.0, []) and paths[(1, 4)][1]
    on_path = from_rows(spark, [(paths[(1, 4)][1][0], 4.0)], COUNTS)
    calibrated, _ = apart.calibrate(od, on_path, 2, "GM")
    trips = {(r.origin, r.destination): r.trips for r in calibrated.collect()}
    assert trips == {(1, 4): pytest.approx(4.0), (1, 6): 3.0}


def limit(trips, mode, level):
    return trips * F.lit({"lo": (0.5, 0.8, 0.9), "up": (2.0, 1.2, 1.1)}[mode][level])


@pytest.mark.parametrize("terms, update", [("all", "raw"), ("rows", "bracket")])
def test_limits_hold_in_every_cell(model, counts, od, terms, update):
    run = model.calibrate_lagrange(od, counts, 1, 1, 1.0, limit, terms, update)
    assert len(run["history"]) == 4
    assert constrained.constraint_check_cell(run["cells"]).first()[0] == 1.0
    rows = {r.origin: r.total for r in run["rows"].collect()}
    assert rows == pytest.approx({r.origin: r.t for r in run["cells"].groupBy("origin").agg(F.sum("trips").alias("t")).collect()})


def test_unknown_options_raise(model, counts, od):
    with pytest.raises(ValueError):
        model.calibrate_lagrange(od, counts, 1, 1, 1.0, limit, penalty_terms="columns")


def test_shuffled_and_broadcast_calibration_agree(model, counts, od):
    counted = model.counted(od, counts)
    plain, _ = calibration.calibrate(od, counted, 3, "PR")
    wide = calibration.Counted(counted.incidence, counted.counts, counted.n_counts, ModelConf(broadcast_rows=0))
    shuffled, _ = calibration.calibrate(od, wide, 3, "PR")
    as_dict = lambda df: {(r.origin, r.destination): r.trips for r in df.collect()}
    assert as_dict(plain) == pytest.approx(as_dict(shuffled))


def brute_fit(cost, incidence, counts, zones, init, rounds, size):
    """The same search over plain dictionaries."""

    def z(point):
        a, b, k = fit.real(point)
        t = {p: zones[p[0]] * zones[p[1]] * c**a * 2.718281828459045 ** (-b * c) for p, c in cost.items()}
        for side in (0, 1):
            total = {s: sum(v for p, v in t.items() if p[side] == s) for s in zones}
            t = {p: v * zones[p[side]] / total[p[side]] for p, v in t.items()}
        volume = {}
        for o, d, e in incidence:
            volume[e] = volume.get(e, 0.0) + k * t[(o, d)]
        return sum((v - counts[e]) ** 2 for e, v in volume.items())

    far = size / math.sqrt(2)  # the published start: corners move by this in two of the three parameters
    simplex = [(10 * init[0] + a * far, 10 * init[1] + b * far, init[2] + k * far) for a, b, k in ((0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0))]
    values = [z(p) for p in simplex]
    last, done = None, 0
    while done < rounds:
        worst, best = values.index(max(values)), values.index(min(values))
        if worst == last:
            simplex = [p if i == best else tuple((x + y) / 2 for x, y in zip(p, simplex[best])) for i, p in enumerate(simplex)]
            values, last = [z(p) for p in simplex], None
            continue
        rest = [p for i, p in enumerate(simplex) if i != worst]
        simplex[worst] = tuple(2 / 3 * sum(xs) - w for *xs, w in zip(*rest, simplex[worst]))
        values[worst], last, done = z(simplex[worst]), worst, done + 1
    return min(values)


def test_fit_follows_the_plain_search(model, counts):
    counted = model.counted(model.costs, counts)
    base = fit.base_cells(model.costs, model.zoning)
    found = fit.fit_simplex(base, counted.settle(), model.zoning, (0.1, 0.1, 1.0), 6, 0.4)
    cost = {(r.origin, r.destination): r.cost for r in model.costs.collect()}
    known = {r.edge_id: r.traffic for r in counts.collect()}
    plain = brute_fit(cost, [tuple(r) for r in counted.incidence.collect()], known, {z: t for z, _, t in ZONE_ROWS}, (0.1, 0.1, 1.0), 6, 0.4)
    assert found.z == pytest.approx(plain, rel=1e-9)


def test_settings_from_a_table(spark):
    from tripweave.conf import ModelConf, checked_settings, from_settings

    values = ["1.5", "-1", "NaN", "much", "kvadratic", "", None]
    names = ["length_coef", "time_coef", "alpha", "F", "search_radius", "nothing", None]
    table = spark.createDataFrame([(n, v) for n in names for v in values], "variable string, value string")
    for row in checked_settings(table).collect():
        try:
            ModelConf().set(row["variable"], row["value"])
            taken = True
        except (ValueError, TypeError):
            taken = False
        assert taken == (row["refusal"] is None), row
    good = spark.createDataFrame([("F", "kvadratic"), ("alpha", "2"), ("search_radius", "7")], "variable string, value string")
    assert from_settings(good) == ModelConf(deterrence="kvadratic", alpha=2.0, search_radius=7.0)
    assert from_settings(good.limit(0)) == ModelConf()
    with pytest.raises(ValueError, match="unknown variable"):
        from_settings(good.union(spark.createDataFrame([("delta", "1")], good.schema)))
    with pytest.raises(ValueError, match="more than once"):
        from_settings(good.union(good))
