"""Every operator as a query over the driver's tables; ``oracle.py`` holds the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.conf import SETTERS, checked_settings
from tripweave.functions import formulas
from tripweave.operators import assignment, calibration, constrained, contraction, demand, fit, network, paths, skim
from tripweave.plans.driver_network import DriverNetwork, derive_chains, table
from tripweave.operators.network import Network
from tripweave.runtime import checkpoint, checkpoint_observed, large

# Parameters shared with the oracle.
TANNER = (0.5, 0.05)
RADIUS = 30.0
FIT_INIT, FIT_SIZE, FIT_ITERATIONS = (0.0, 0.05, 1.0), 0.1, 5
LIMITS = {"lo": (0.5, 0.8, 0.9), "up": (2.0, 1.2, 1.1)}
LAGRANGE_M, LAGRANGE_S, LAGRANGE_SCALE = 1, 1, 1.0
ROUNDS = 2

_networks: dict[tuple, DriverNetwork] = {}


def driver_network(spark: SparkSession, sf_dir: str, **options) -> DriverNetwork:
    """The network of a data folder, shared by all queries of a session while the folder holds the same files.

    Networks of ended sessions are let go.
    """
    application = spark.sparkContext.applicationId
    for old in [k for k in _networks if k[0] != application]:
        del _networks[old]
    files = tuple(sorted(f for name in ("customer", "orders", "lineitem") for f in table(spark, sf_dir, name).inputFiles()))
    key = (application, sf_dir, files, tuple(sorted(options.items())))
    if key not in _networks:
        base = driver_network(spark, sf_dir) if options else None
        _networks[key] = DriverNetwork(spark, sf_dir, base, **options)
    return _networks[key]


def rounded(column, name: str, digits: int = 6):
    return F.round(column, digits).alias(name)


def od_rows(df: DataFrame, value: str = "trips") -> DataFrame:
    return df.select("origin", "destination", rounded(value, value))


def limit(trips, mode: str, level: int):
    return trips * F.lit(LIMITS[mode][level])


# network


def network_load(d: DriverNetwork) -> DataFrame:
    return d.network.arcs.select(F.col("link_id").alias("edge_id"), "u", "v", "length", "travel_time")


def node_degree(d: DriverNetwork) -> DataFrame:
    return network.node_degree(d.network.links)


def link_count(d: DriverNetwork) -> DataFrame:
    return d.network.links.agg(F.count("*").alias("links"))


def edge_cost(d: DriverNetwork) -> DataFrame:
    cost = formulas.edge_cost(F.col("length"), F.col("travel_time"), d.conf.length_coef, d.conf.time_coef)
    return d.network.links.select(F.col("link_id").alias("edge_id"), cost.alias("cost"))


def zones_load(d: DriverNetwork) -> DataFrame:
    return d.model.zones


def counts_load(d: DriverNetwork) -> DataFrame:
    return d.model.counts(d.counts).table


def node_lookup(d: DriverNetwork) -> DataFrame:
    """Zones that have lost their node: the model's zones, moved to nodes of which the network has only some."""
    return network.missing_nodes(d.model.zones.withColumn("node_id", F.col("node_id") * 3), d.network)


def chain_network(d: DriverNetwork) -> Network:
    return Network.from_edges(derive_chains(d.edges))


def chain_contraction(d: DriverNetwork) -> DataFrame:
    """Only zone nodes are mandatory, so original nodes of degree 2 vanish too."""
    mandatory = d.model.zones.select(F.col("node_id").alias("node"))
    return contraction.contract(chain_network(d), mandatory).links.select(
        "source_node", "target_node", "length", "travel_time", "is_oneway"
    )


def chain_merge(d: DriverNetwork) -> DataFrame:
    """With all original nodes mandatory the chains fold back into the original edges."""
    small_network = contraction.contract(chain_network(d), d.network.nodes)
    members = small_network.members.groupBy("link_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_id"))), lambda x: x["edge_id"]), ",")
        .alias("members")
    )
    return small_network.links.join(large(members), "link_id").select(
        "link_id", "source_node", "target_node", "length", "travel_time", "is_oneway", "members"
    )


def conf_set(d: DriverNetwork) -> DataFrame:
    """Settings taken from the customers, and how many of each the configuration takes or refuses."""
    turn = F.col("c_custkey") % 8
    names = F.array(*[F.lit(x) for x in (*SETTERS, "delta")])
    functions = F.array(*[F.lit(x) for x in (*formulas.DETERRENCE, "linear", "")])
    name = F.get(names, turn.cast("int"))
    value = F.when(name == "F", F.get(functions, (F.col("c_nationkey") % 6).cast("int"))).when(F.col("c_nationkey") == 0, "much")
    settings = d.table("customer").select(name.alias("variable"), F.coalesce(value, F.col("c_acctbal").cast("string")).alias("value"))
    return checked_settings(settings).groupBy("variable", "field", "refusal").agg(F.count("*").alias("n"))


# search


def shortest_dist(d: DriverNetwork) -> DataFrame:
    return d.model.skim.labels


def radius_prune(d: DriverNetwork) -> DataFrame:
    return driver_network(d.spark, d.sf_dir, search_radius=RADIUS).model.skim.labels


def zone_pair_expand(d: DriverNetwork) -> DataFrame:
    m = d.model
    return skim.zone_pairs(m.skim.labels, m.zones, m.zones, m.zoning.n, m.conf)


def reachable_filter(d: DriverNetwork) -> DataFrame:
    """Pairs within the radius model, before and after the filter."""
    near = driver_network(d.spark, d.sf_dir, search_radius=RADIUS).model
    pairs = skim.zone_pairs(near.skim.labels, near.zones, near.zones, near.zoning.n, near.conf)
    return pairs.agg(F.count("*").alias("labelled"), F.count_if(F.col("cost") != 0).alias("kept"))


def cost_matrix(d: DriverNetwork) -> DataFrame:
    return d.model.costs


def with_text_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", ","))


def shortest_paths(d: DriverNetwork) -> DataFrame:
    return with_text_path(d.model.shortest_paths())


def paths_with_trips(d: DriverNetwork) -> DataFrame:
    """The full matrix on the paths of the radius model, so that far pairs have none."""
    near = driver_network(d.spark, d.sf_dir, search_radius=RADIUS).model
    return with_text_path(near.paths_with_trips(d.od)).withColumn("trips", F.round("trips", 6))


def counted_incidence(d: DriverNetwork) -> DataFrame:
    return d.counted.incidence


def counted_edge_filter(d: DriverNetwork) -> DataFrame:
    """Path edges kept by a semi-join to the counts; written-out paths instead of the shrunk tree."""
    counts = d.counted.small(d.counted.counts.select("edge_id"))
    return d.model.path_links(d.model.costs).join(counts, "edge_id", "left_semi").select(
        "origin", "destination", "seq", "edge_id"
    )


# distribution


def deterrence(name: str, alpha: float, beta: float, gamma: float):
    def run(d: DriverNetwork) -> DataFrame:
        conf = d.conf.set("alpha", alpha).set("beta", beta).set("gamma", gamma).set("F", name)
        return d.model.costs.select("origin", "destination", rounded(conf.deterrence_of(F.col("cost")), "value", 9))

    return run


def udf_deterrence(d: DriverNetwork) -> DataFrame:
    """A deterrence function of the user's own."""
    conf = d.conf.set("F", lambda cost: 1.0 / (1.0 + cost))
    return d.model.costs.select("origin", "destination", rounded(conf.deterrence_of(F.col("cost")), "value", 9))


def tanner_od(d: DriverNetwork) -> DataFrame:
    return demand.tanner_seed(d.model.costs, d.model.zoning, *TANNER)


def deterrence_tanner(d: DriverNetwork) -> DataFrame:
    return od_rows(tanner_od(d))


def seed(d: DriverNetwork) -> DataFrame:
    return demand.gravity_seed(d.model.costs, d.model.zoning, d.conf.deterrence_of(F.col("cost")))


def gravity_seed(d: DriverNetwork) -> DataFrame:
    return od_rows(seed(d))


def row_factor_join(d: DriverNetwork) -> DataFrame:
    s, zoning = seed(d), d.model.zoning
    return od_rows(demand.scale_by(s, demand.factors(s, "origin", zoning), "origin", zoning))


def col_factor_join(d: DriverNetwork) -> DataFrame:
    s, zoning = seed(d), d.model.zoning
    return od_rows(demand.scale_by(s, demand.factors(s, "destination", zoning), "destination", zoning))


def gravity_od(d: DriverNetwork) -> DataFrame:
    return od_rows(d.od)


def balance(d: DriverNetwork) -> DataFrame:
    return od_rows(d.model.balance(tanner_od(d)))


def balance_coef(d: DriverNetwork) -> DataFrame:
    """Mean column factor of the pass, and mean row factor left after it."""
    _, col_factor = demand.one_pass(seed(d), d.model.zoning)
    before = demand.mean_factor(col_factor).select(rounded("coef", "column_coef"))
    after = demand.mean_factor(demand.factors(d.od, "origin", d.model.zoning)).select(rounded("coef", "row_coef"))
    return before.select("column_coef", F.lit(None).cast("double").alias("row_coef")).unionByName(
        after.select(F.lit(None).cast("double").alias("column_coef"), "row_coef")
    ).agg(F.max("column_coef").alias("column_coef"), F.max("row_coef").alias("row_coef"))


def row_sum(d: DriverNetwork) -> DataFrame:
    return demand.margin(d.od, "origin").select("origin", rounded("total", "total"))


def col_sum(d: DriverNetwork) -> DataFrame:
    return demand.margin(d.od, "destination").select("destination", rounded("total", "total"))


def total_trips(d: DriverNetwork) -> DataFrame:
    return demand.total_trips(d.od).select(rounded("total", "total"))


def margin_join(d: DriverNetwork) -> DataFrame:
    return demand.with_margins(d.od, d.model.zoning).select(
        "origin", "destination", rounded("trips", "trips"), rounded("row_total", "row_total"),
        rounded("col_total", "col_total"),
    )


def od_by_origin(d: DriverNetwork) -> DataFrame:
    return demand.by_origin(d.od).withColumn("destinations", F.array_join("destinations", ","))


def gravity_od_k(d: DriverNetwork) -> DataFrame:
    return od_rows(d.model.gravity_od_k((*TANNER, 1.0), d.counted))


def base_cells(d: DriverNetwork) -> DataFrame:
    return fit.base_cells(d.model.costs, d.model.zoning)


def z_rows(d: DriverNetwork, points) -> DataFrame:
    return fit.objectives(base_cells(d), d.counted, points, d.model.zoning).select("point", rounded("z", "z", 3))


def simplex_objective(d: DriverNetwork) -> DataFrame:
    return z_rows(d, [fit.real(p) for p in fit.start_simplex(FIT_INIT, FIT_SIZE)])


def simplex_shrink(d: DriverNetwork) -> DataFrame:
    """Objectives after the start simplex is halved towards its best corner."""
    simplex = fit.start_simplex(FIT_INIT, FIT_SIZE)
    base = base_cells(d)
    z = fit.objectives(base, d.counted, [fit.real(p) for p in simplex], d.model.zoning)
    best = z.orderBy("z", "point").first()["point"]
    points = [fit.real(p) for p in fit.shrink(simplex, best)]
    return fit.objectives(base, d.counted, points, d.model.zoning).select("point", rounded("z", "z", 3))


def simplex_reflect(d: DriverNetwork) -> DataFrame:
    """Objectives after the worst corner of the start simplex is reflected once."""
    simplex = fit.start_simplex(FIT_INIT, FIT_SIZE)
    base = base_cells(d)
    z = fit.objectives(base, d.counted, [fit.real(p) for p in simplex], d.model.zoning)
    worst = z.orderBy(F.desc("z"), "point").first()["point"]
    simplex[worst] = fit.reflect(simplex, worst)
    points = [fit.real(p) for p in simplex]
    return fit.objectives(base, d.counted, points, d.model.zoning).select("point", rounded("z", "z", 3))


def gravity_od_simplex(d: DriverNetwork) -> DataFrame:
    base = base_cells(d)
    found = fit.fit_simplex(base, d.counted, d.model.zoning, FIT_INIT, FIT_ITERATIONS, FIT_SIZE)
    return od_rows(fit.balanced_points(base, [found.point], d.model.zoning))


# assignment and counts


def assign_v2(d: DriverNetwork) -> DataFrame:
    return d.model.assign(d.od).select("edge_id", rounded("volume", "volume"))


def assign_v1(d: DriverNetwork) -> DataFrame:
    return d.model.assign_v1(d.od).select("edge_id", rounded("volume", "volume"))


def od_path_join(d: DriverNetwork) -> DataFrame:
    return d.od.join(large(d.model.path_links(d.model.costs)), ["origin", "destination"]).select(
        "origin", "destination", "seq", "edge_id", rounded("trips", "trips")
    )


def volumes(d: DriverNetwork) -> DataFrame:
    return demand.edge_volume_counted(d.od, d.counted.incidence)


def edge_volume_counted(d: DriverNetwork) -> DataFrame:
    return volumes(d).select("edge_id", rounded("volume", "volume"))


def objective_z(d: DriverNetwork) -> DataFrame:
    c = d.counted
    return demand.objective_z(volumes(d), c.counts, c.n_counts, c.conf).select(rounded("z", "z", 3), "uncovered_counts")


def rmse(d: DriverNetwork) -> DataFrame:
    c = d.counted
    return demand.rmse(volumes(d), c.counts, c.n_counts, c.conf).select(rounded("rmse", "rmse"))


def lsq_scale_k(d: DriverNetwork) -> DataFrame:
    c = d.counted
    return demand.lsq_scale_k(volumes(d), c.counts, c.n_counts, c.conf).select(rounded("k", "k"))


# calibration


def first_state(d: DriverNetwork):
    cells = calibration.first_cells(d.od)
    return cells, d.counted.edge_state(cells)


def residual_lookup(d: DriverNetwork) -> DataFrame:
    _, edges = first_state(d)
    return calibration.residual_lookup(d.counted, edges).select(
        "origin", "destination", "edge_id", rounded("resid", "resid")
    )


def bracket(d: DriverNetwork) -> DataFrame:
    _, edges = first_state(d)
    return calibration.residuals(edges).select("edge_id", rounded(formulas.bracket(F.col("resid")), "value"))


def gradient(d: DriverNetwork) -> DataFrame:
    cells, edges = first_state(d)
    return calibration.gradient(cells, d.counted, edges).select("origin", "destination", rounded("g", "grad"))


def first_direction(d: DriverNetwork):
    cells, edges = first_state(d)
    cells = calibration.with_gradient(cells, d.counted, edges).withColumn("dir", F.col("grad"))
    return cells, edges


def step_bounds(d: DriverNetwork) -> DataFrame:
    return calibration.step_bounds(first_direction(d)[0]).select(rounded("lower", "lower", 9), rounded("upper", "upper", 9))


def line_search(d: DriverNetwork) -> DataFrame:
    """Cells after one step along the first gradient."""
    cells, edges = first_direction(d)
    step = calibration.best_step(calibration.edge_slopes(cells, d.counted, edges)).first()["step"]
    bounds = calibration.step_bounds(cells).first()
    return od_rows(calibration.take_step(cells, calibration.clip(step, bounds["lower"], bounds["upper"])))


def second_gradient(d: DriverNetwork) -> DataFrame:
    """Cells with the gradients of the first two rounds."""
    od, _ = calibration.calibrate(d.od, d.counted, 1, "GM")
    first = calibration.with_gradient(*_with_edges(d, d.od))
    second = calibration.with_gradient(*_with_edges(d, od))
    return second.select("origin", "destination", "grad").join(
        large(first.select("origin", "destination", F.col("grad").alias("grad_old"))), ["origin", "destination"]
    )


def _with_edges(d: DriverNetwork, od: DataFrame):
    cells = calibration.first_cells(od)
    return cells, d.counted, d.counted.edge_state(cells)


def cg_beta(name: str):
    def run(d: DriverNetwork) -> DataFrame:
        return calibration.cg_beta(second_gradient(d)).select(rounded(name, "beta"))

    return run


def calibrate(method: str):
    def run(d: DriverNetwork) -> DataFrame:
        return od_rows(calibration.calibrate(d.od, d.counted, ROUNDS, method)[0])

    return run


# calibration under limits


def udf_limit(d: DriverNetwork) -> DataFrame:
    """Limits of the cells by a function of the user's own."""
    cells = constrained.with_limits(d.od, limit)
    return cells.select("origin", "destination", *[rounded(c, c) for c in ("trips", "lo", "up")])


def lagrange_state(d: DriverNetwork):
    """Cells, sums and total before the first step, with multipliers as after one update so that penalties act."""
    cells = checkpoint(constrained.with_limits(d.od, limit))
    marks = checkpoint(constrained.updated_multipliers(constrained.margin_limits(cells, d.counted, limit), "raw"))
    return cells, marks, constrained.updated_total(constrained.total_limits(cells, limit), "raw")


def lagrange_graded(d: DriverNetwork):
    cells, marks, total = lagrange_state(d)
    graded = constrained.lagrange_gradient(cells, d.counted, marks, total, LAGRANGE_SCALE, "all", d.model.zoning)
    return graded, marks, total


def lagrange_gradient(d: DriverNetwork) -> DataFrame:
    return od_rows(lagrange_graded(d)[0], "grad")


def directed(graded: DataFrame) -> DataFrame:
    c = [F.col(n) for n in ("grad", "trips", "lo", "up")]
    return graded.withColumn("dir", formulas.feasible_direction(*c))


def fw_direction(d: DriverNetwork) -> DataFrame:
    return od_rows(directed(lagrange_graded(d)[0]), "dir")


def lagrange_line_search(d: DriverNetwork) -> DataFrame:
    graded, marks, total = lagrange_graded(d)
    cells = checkpoint(directed(graded))
    _, sums = checkpoint_observed(constrained.moved_marks(cells, d.counted, marks, d.model.zoning), **constrained.slope_sums(LAGRANGE_SCALE))
    p0, p1 = constrained.whole_slopes(sums, total, LAGRANGE_SCALE)
    ends = d.spark.createDataFrame([(p0, p1, constrained.line_step(p0, p1))], "p0 double, p1 double, step double")
    return ends.select(rounded("p0", "p0", 2), rounded("p1", "p1", 2), rounded("step", "step", 9))


def lagrange_run(d: DriverNetwork) -> dict:
    if "lagrange" not in d.__dict__:
        d.__dict__["lagrange"] = constrained.calibrate_lagrange(
            d.od, d.counted, d.model.zoning, LAGRANGE_M, LAGRANGE_S, LAGRANGE_SCALE, limit
        )
    return d.__dict__["lagrange"]


def calibrate_lagrange(d: DriverNetwork) -> DataFrame:
    return od_rows(lagrange_run(d)["cells"])


def margins(d: DriverNetwork, columns: list[str]) -> DataFrame:
    run = lagrange_run(d)
    parts = [
        run[name].select(F.lit(side).alias("side"), zone.alias("zone"), *[rounded(c, c) for c in columns])
        for name, side, zone in (
            ("rows", "row", F.col("origin")), ("cols", "column", F.col("destination")),
            ("total", "total", F.lit(0).cast("long")),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lagrange_multipliers(d: DriverNetwork) -> DataFrame:
    return margins(d, ["total", "beta", "delta"])


def lagrange_limits(d: DriverNetwork) -> DataFrame:
    cells = constrained.with_limits(d.od, limit).agg(
        F.lit("cells").alias("side"), F.lit(0).cast("long").alias("zone"), rounded(F.sum("lo"), "lo"),
        rounded(F.sum("up"), "up"),
    )
    return margins(d, ["lo", "up"]).unionByName(cells)


def multiplier_lookup(d: DriverNetwork) -> DataFrame:
    """Row totals with limits and multipliers, and the penalty slope that follows."""
    return lagrange_run(d)["rows"].select(
        "origin", *[rounded(c, c) for c in ("total", "lo", "up", "beta", "delta")],
        rounded(constrained.penalty_of(LAGRANGE_SCALE), "penalty"),
    )


def constraint_check_cell(d: DriverNetwork) -> DataFrame:
    return constrained.constraint_check_cell(lagrange_run(d)["cells"]).select(rounded("share", "share"))


def constraint_check_row(d: DriverNetwork) -> DataFrame:
    return constrained.constraint_check_margin(lagrange_run(d)["rows"]).select(rounded("share", "share"))


def constraint_check_total(d: DriverNetwork) -> DataFrame:
    return constrained.constraint_check_total(lagrange_run(d)["total"])


QUERIES: dict[str, Callable[[DriverNetwork], DataFrame]] = {
    "cost_matrix": cost_matrix,
    "conf_set": conf_set,
    "network_load": network_load,
    "zones_load": zones_load,
    "counts_load": counts_load,
    "node_lookup": node_lookup,
    "udf_deterrence": udf_deterrence,
    "udf_limit": udf_limit,
    "node_degree": node_degree,
    "link_count": link_count,
    "edge_cost": edge_cost,
    "deterrence_log_normal": deterrence("log_normal", 2.0, -0.3, 0.0),
    "deterrence_top_log_normal": deterrence("top_log_normal", 2.0, -0.3, 10.0),
    "deterrence_exponential": deterrence("exponencial", 2.0, -0.05, 0.0),
    "deterrence_quadratic": deterrence("kvadratic", 2.0, 0.0, 0.0),
    "deterrence_tanner": deterrence_tanner,
    "gravity_seed": gravity_seed,
    "bracket": bracket,
    "fw_direction": fw_direction,
    "step_bounds": step_bounds,
    "reachable_filter": reachable_filter,
    "counted_edge_filter": counted_edge_filter,
    "radius_prune": radius_prune,
    "constraint_check_cell": constraint_check_cell,
    "constraint_check_row": constraint_check_row,
    "constraint_check_total": constraint_check_total,
    "row_factor_join": row_factor_join,
    "col_factor_join": col_factor_join,
    "od_path_join": od_path_join,
    "residual_lookup": residual_lookup,
    "margin_join": margin_join,
    "multiplier_lookup": multiplier_lookup,
    "zone_pair_expand": zone_pair_expand,
    "shortest_dist": shortest_dist,
    "shortest_paths": shortest_paths,
    "paths_with_trips": paths_with_trips,
    "counted_incidence": counted_incidence,
    "chain_contraction": chain_contraction,
    "chain_merge": chain_merge,
    "row_sum": row_sum,
    "col_sum": col_sum,
    "total_trips": total_trips,
    "balance_coef": balance_coef,
    "edge_volume_counted": edge_volume_counted,
    "objective_z": objective_z,
    "rmse": rmse,
    "lsq_scale_k": lsq_scale_k,
    "cg_beta_pr": cg_beta("pr"),
    "cg_beta_fr": cg_beta("fr"),
    "gradient": gradient,
    "line_search": line_search,
    "od_by_origin": od_by_origin,
    "gravity_od": gravity_od,
    "balance": balance,
    "gravity_od_k": gravity_od_k,
    "gravity_od_simplex": gravity_od_simplex,
    "simplex_objective": simplex_objective,
    "simplex_shrink": simplex_shrink,
    "simplex_reflect": simplex_reflect,
    "assign_v1": assign_v1,
    "assign_v2": assign_v2,
    "calibrate_gm": calibrate("GM"),
    "calibrate_fr": calibrate("FR"),
    "calibrate_pr": calibrate("PR"),
    "calibrate_lagrange": calibrate_lagrange,
    "lagrange_gradient": lagrange_gradient,
    "lagrange_line_search": lagrange_line_search,
    "lagrange_multipliers": lagrange_multipliers,
    "lagrange_limits": lagrange_limits,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run):
        return lambda spark, sf_dir: run(driver_network(spark, sf_dir))

    return {name: bind(run) for name, run in QUERIES.items()}
