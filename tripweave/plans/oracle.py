"""SQL for DuckDB that must return the same rows as the queries in ``catalog.py``.

Each statement is put together from named common table expressions; ``statement`` adds the ones it needs.
"""

from __future__ import annotations

import re

from tripweave.plans.catalog import (
    FIT_INIT, FIT_ITERATIONS, FIT_SIZE, LAGRANGE_M, LAGRANGE_S, LAGRANGE_SCALE, LIMITS, RADIUS, ROUNDS, TANNER,
)
from tripweave.plans.driver_network import SEARCH_RADIUS

CTES: dict[str, str] = {}


def cte(name: str, body: str, columns: str = "") -> None:
    CTES[name] = (columns, body)


cte("dims", "SELECT count(*)::BIGINT n, floor(sqrt(count(*)::DOUBLE))::BIGINT w FROM customer")
cte("cust", """SELECT c_custkey k, (1 + c_nationkey % 7)::DOUBLE len,
  (1 + floor(abs(c_acctbal))::BIGINT % 5)::DOUBLE tim, c_custkey % 13 = 5 ow FROM customer""")
cte("edges", """SELECT 5*k edge_id, k source_node, k+1 target_node, len length, tim travel_time, ow is_oneway
  FROM cust, dims WHERE k+1 < n AND (k+1) % w <> 0
  UNION ALL SELECT 5*k+1, k, k+w, len+1, tim, ow FROM cust, dims WHERE k+w < n
  UNION ALL SELECT 5*k+2, k, k+8, len+9, tim+4, false FROM cust, dims WHERE k+8 < n AND k%8 = 0
  UNION ALL SELECT 5*k+3, k, k+8*w, len+9, tim+4, false FROM cust, dims WHERE k+8*w < n AND k%8 = 0
  UNION ALL SELECT 5*k+4, k, k, len, tim, false FROM cust WHERE k%97 = 0""")
cte("links", "SELECT * FROM edges WHERE source_node <> target_node")
cte("arcs", """SELECT edge_id, source_node u, target_node v, length, travel_time, 0.75*length + 0.25*travel_time c FROM links
  UNION ALL SELECT edge_id, target_node, source_node, length, travel_time, 0.75*length + 0.25*travel_time
  FROM links WHERE NOT is_oneway""")
cte("zones", """SELECT floor(node_id/53.0)::BIGINT zone_id, node_id, count(*)::DOUBLE trips FROM
  (SELECT CASE WHEN o_custkey - o_custkey % 53 + 7 < n THEN o_custkey - o_custkey % 53 + 7
    ELSE greatest(o_custkey - o_custkey % 53 - 46, 0) END node_id FROM orders, dims) GROUP BY node_id""")
cte("counts", """SELECT 5 * (11 * (coalesce(l_suppkey, 0) % places) + 5) + 1 edge_id, count(*)::DOUBLE traffic
  FROM lineitem, (SELECT greatest(1, (n - w - 6) // 11 + 1) places FROM dims) GROUP BY 1""")
cte("degree", "SELECT node, count(*) degree FROM (SELECT source_node node FROM links UNION ALL SELECT target_node FROM links) GROUP BY 1")


def labels(name: str, radius: float) -> None:
    near = f"WHERE l.dist <= {radius}"
    cte(name, f"""SELECT DISTINCT node_id, node_id, 0.0::DOUBLE FROM zones
  UNION
  SELECT n.src, n.node, n.dist FROM
    (SELECT l.src, a.v node, min(l.dist + a.c) dist FROM {name} l JOIN arcs a ON l.node = a.u {near} GROUP BY 1, 2) n
    LEFT JOIN recurring.{name} r ON r.src = n.src AND r.node = n.node
  WHERE r.dist IS NULL OR n.dist < r.dist""", "(src, node, dist) USING KEY (src, node)")


def tree(name: str, labels_name: str, radius: float) -> None:
    near = f"AND l.dist <= {radius}"
    cte(name, f"""SELECT v.src, v.node, min(a.edge_id) edge_id, arg_min(a.u, a.edge_id) up
  FROM {labels_name} v JOIN arcs a ON a.v = v.node
  JOIN {labels_name} l ON l.src = v.src AND l.node = a.u AND l.dist + a.c = v.dist {near}
  WHERE v.src <> v.node GROUP BY 1, 2""")


def walk(name: str, pairs: str, tree_name: str) -> None:
    """Path edges of each pair, from the destination back."""
    cte(f"{name}_back", f"""SELECT o.zone_id, d.zone_id, o.node_id, t.up, t.edge_id, 1::BIGINT
  FROM {pairs} p JOIN zones o ON o.zone_id = p.origin JOIN zones d ON d.zone_id = p.destination
  JOIN {tree_name} t ON t.src = o.node_id AND t.node = d.node_id
  UNION ALL
  SELECT w.origin, w.destination, w.src, t.up, t.edge_id, w.back + 1
  FROM {name}_back w JOIN {tree_name} t ON t.src = w.src AND t.node = w.here""", "(origin, destination, src, here, edge_id, back)")
    cte(name, f"""SELECT origin, destination, edge_id,
  max(back) OVER (PARTITION BY origin, destination) - back + 1 seq FROM {name}_back""")


labels("lab", SEARCH_RADIUS)
labels("lab_near", RADIUS)
tree("tree", "lab", SEARCH_RADIUS)
tree("tree_near", "lab_near", RADIUS)
for suffix in ("", "_near"):
    cte(f"pairs{suffix}", f"""SELECT o.zone_id origin, d.zone_id destination, l.dist AS cost FROM lab{suffix} l
  JOIN zones o ON o.node_id = l.src JOIN zones d ON d.node_id = l.node""")
cte("cost", "SELECT * FROM pairs WHERE cost <> 0")
walk("walk", "cost", "tree")
walk("walk_near", "cost", "tree_near")
cte("inc", "SELECT w.origin, w.destination, w.edge_id FROM walk w JOIN counts c ON c.edge_id = w.edge_id")


def seed(name: str, factor: str) -> None:
    cte(name, f"""SELECT c.origin, c.destination, o.trips * d.trips * {factor} trips
  FROM cost c JOIN zones o ON o.zone_id = c.origin JOIN zones d ON d.zone_id = c.destination""")


def factored(name: str, od: str, side: str) -> None:
    cte(f"{name}_factor", f"""SELECT z.zone_id, z.trips / sum(t.trips) factor FROM {od} t
  JOIN zones z ON z.zone_id = t.{side} GROUP BY z.zone_id, z.trips""")
    cte(name, f"""SELECT t.origin, t.destination, t.trips * f.factor trips FROM {od} t
  JOIN {name}_factor f ON f.zone_id = t.{side}""")


TANNER_FACTOR = f"pow(c.cost, {TANNER[0]}) * exp(-{TANNER[1]} * c.cost)"
seed("seed", "exp(-0.05 * c.cost)")
factored("seed_rows", "seed", "origin")
factored("seed_cols", "seed", "destination")
factored("od", "seed_rows", "destination")
seed("tanner", TANNER_FACTOR)
factored("tanner_rows", "tanner", "origin")
factored("tanner_od", "tanner_rows", "destination")


def volumes(name: str, od: str) -> None:
    cte(name, f"""SELECT i.edge_id, c.traffic, sum(t.trips) volume FROM inc i JOIN {od} t USING (origin, destination)
  JOIN counts c ON c.edge_id = i.edge_id GROUP BY 1, 2""")


volumes("vol", "od")
volumes("tanner_vol", "tanner_od")


def gradient(name: str, od: str, vol: str) -> None:
    cte(name, f"""SELECT t.origin, t.destination, t.trips, coalesce(g.g, 0) g FROM {od} t LEFT JOIN
  (SELECT i.origin, i.destination, sum(v.volume - v.traffic) g FROM inc i JOIN {vol} v USING (edge_id) GROUP BY 1, 2) g
  USING (origin, destination)""")


def beta_sql(method: str) -> str:
    top = "sum((grad - grad_old) * grad)" if method == "pr" else "sum(grad * grad)"
    return f"CASE WHEN sum(grad_old * grad_old) = 0 THEN 0 ELSE {top} / sum(grad_old * grad_old) END"


def rounds(method: str) -> str:
    """Unrolled rounds; returns the name of the final matrix."""
    od, vol, old = "od", "vol", None
    for i in range(1, ROUNDS + 1):
        p = f"{method}{i}"
        gradient(f"{p}_grad", od, vol)
        if old is None:
            cte(f"{p}_cell", f"SELECT origin, destination, trips, g grad, 0.0 grad_old, 0.0 dir_old FROM {p}_grad")
            cte(f"{p}_beta", "SELECT 0.0 beta")
        else:
            cte(f"{p}_cell", f"""SELECT n.origin, n.destination, n.trips, n.g grad, o.grad grad_old, o.dir dir_old
  FROM {p}_grad n JOIN {old}_dir o USING (origin, destination)""")
            cte(f"{p}_beta", "SELECT 0.0 beta" if method == "gm" else f"SELECT {beta_sql(method)} beta FROM {p}_cell")
        cte(f"{p}_dir", f"SELECT *, grad + beta * dir_old dir FROM {p}_cell, {p}_beta")
        cte(f"{p}_slope", f"""SELECT v.*, s.slope FROM {vol} v JOIN
  (SELECT i.edge_id, sum(-t.dir * t.trips) slope FROM inc i JOIN {p}_dir t USING (origin, destination) GROUP BY 1) s
  USING (edge_id)""")
        cte(f"{p}_bound", f"""SELECT coalesce(max(CASE WHEN dir < 0 THEN 1/dir END), '-inf'::DOUBLE) lower_,
  coalesce(min(CASE WHEN dir > 0 THEN 1/dir END), 'inf'::DOUBLE) upper_ FROM {p}_dir""")
        cte(f"{p}_step", f"""SELECT least(greatest(step, lower_), upper_) step FROM {p}_bound,
  (SELECT CASE WHEN sum(slope*slope) = 0 THEN 0 ELSE sum(slope*(traffic - volume)) / sum(slope*slope) END step FROM {p}_slope)""")
        cte(f"{p}_od", f"SELECT origin, destination, trips * (1 - step * dir) trips FROM {p}_dir, {p}_step")
        volumes(f"{p}_vol", f"{p}_od")
        od, vol, old = f"{p}_od", f"{p}_vol", p
    return od


FINAL = {method: rounds(method) for method in ("gm", "fr", "pr")}

# augmented Lagrangian


def bracket(x: str) -> str:
    return f"least({x}, 0)"


def limits(side: str) -> str:
    level = {"cell": 0, "origin": 1, "destination": 1, "total": 2}[side]
    return f"x * {LIMITS['lo'][level]} lo, x * {LIMITS['up'][level]} up"


cte("l_cell", f"SELECT origin, destination, trips x, trips, {limits('cell')} FROM od")
for side_, zone_ in (("origin", "origin"), ("destination", "destination"), ("total", "0::BIGINT")):
    cte(f"l_{side_}", f"""SELECT zone, x total, {limits(side_)}, 0.0 beta, 0.0 delta FROM
  (SELECT {zone_} zone, sum(trips) x FROM od GROUP BY 1)""")
SIDES = ("origin", "destination", "total")


def update_multipliers(name: str, source: str) -> None:
    cte(name, f"SELECT zone, total, lo, up, total - lo + beta beta, up - total + delta delta FROM {source}")


def penalty(total: str, t: str) -> str:
    s = LAGRANGE_SCALE
    return f"2*{s}*({bracket(f'{total} - {t}.lo + {t}.beta')} - {bracket(f'{t}.up - ({total}) + {t}.delta')})"


def lagrange_step(p: str, cell: str, vol: str, sides: dict[str, str]) -> None:
    gradient(f"{p}_g", cell, vol)
    cte(f"{p}_dir", f"""SELECT *, CASE WHEN grad > 0 THEN lo - trips WHEN grad < 0 THEN up - trips ELSE 0 END dir FROM
  (SELECT c.*, 2*g.g + {penalty('r.total', 'r')} + {penalty('k.total', 'k')} + {penalty('w.total', 'w')} grad
   FROM {cell} c JOIN {p}_g g USING (origin, destination) JOIN {sides['origin']} r ON r.zone = c.origin
   JOIN {sides['destination']} k ON k.zone = c.destination, {sides['total']} w)""")
    cte(f"{p}_edge", f"""SELECT v.edge_id, v.traffic, v.volume, m.move FROM {vol} v JOIN
  (SELECT i.edge_id, sum(t.dir) move FROM inc i JOIN {p}_dir t USING (origin, destination) GROUP BY 1) m USING (edge_id)""")
    for side, zone in (("origin", "origin"), ("destination", "destination"), ("total", "0::BIGINT")):
        cte(f"{p}_{side}", f"""SELECT t.*, m.move FROM {sides[side]} t JOIN
  (SELECT {zone} zone, sum(dir) move FROM {p}_dir GROUP BY 1) m USING (zone)""")
    ends = []
    for at in (0, 1):
        parts = [f"(SELECT sum(2*move*(volume - traffic + {at}*move)) FROM {p}_edge)"] + [
            f"(SELECT sum(move * {penalty(f't.total + {at}*t.move', 't')}) FROM {p}_{side} t)" for side in SIDES
        ]
        ends.append(" + ".join(parts))
    cte(f"{p}_ends", f"SELECT {ends[0]} p0, {ends[1]} p1")
    cte(f"{p}_step", f"""SELECT p0, p1, CASE WHEN p0*p1 < 0 THEN abs(p0)/(abs(p0)+abs(p1))
  WHEN abs(p0) < abs(p1) THEN 0 ELSE 1 END step FROM {p}_ends""")
    cte(f"{p}_cell", f"SELECT origin, destination, trips + step*dir trips, lo, up FROM {p}_dir, {p}_step")
    volumes(f"{p}_vol", f"{p}_cell")
    for side in SIDES:
        cte(f"{p}_{side}_new", f"SELECT zone, total + step*move total, lo, up, beta, delta FROM {p}_{side}, {p}_step")


def lagrange_run() -> tuple[str, dict[str, str]]:
    cell, vol, sides = "l_cell", "vol", {s: f"l_{s}" for s in SIDES}
    for i in range(LAGRANGE_S + 1):
        for j in range(LAGRANGE_M + 1):
            p = f"lr{i}{j}"
            lagrange_step(p, cell, vol, sides)
            cell, vol, sides = f"{p}_cell", f"{p}_vol", {s: f"{p}_{s}_new" for s in SIDES}
        for side in SIDES:
            update_multipliers(f"lr{i}_{side}", sides[side])
        sides = {s: f"lr{i}_{s}" for s in SIDES}
    return cell, sides


L_CELL, L_SIDES = lagrange_run()
for side_ in SIDES:
    update_multipliers(f"first_{side_}", f"l_{side_}")
lagrange_step("one", "l_cell", "vol", {s: f"first_{s}" for s in SIDES})


def all_sides(columns: str) -> str:
    names = {"origin": "row", "destination": "column", "total": "total"}
    return " UNION ALL ".join(f"SELECT '{names[s]}' side, zone, {columns} FROM {L_SIDES[s]}" for s in SIDES)


# simplex fit


def z_of(name: str, points: str) -> None:
    """Objective of each row of ``points(point, a, b, k)``, with a and b ten times the real parameters."""
    cte(f"{name}_seed", f"""SELECT q.point, q.k, c.origin, c.destination,
  o.trips*d.trips*pow(c.cost, q.a/10)*exp(-(q.b/10)*c.cost) trips, o.trips sent, d.trips drawn
  FROM {points} q, cost c JOIN zones o ON o.zone_id = c.origin JOIN zones d ON d.zone_id = c.destination""")
    cte(f"{name}_rows", f"SELECT * REPLACE (trips*sent/sum(trips) OVER (PARTITION BY point, origin) AS trips) FROM {name}_seed")
    cte(f"{name}_od", f"SELECT * REPLACE (k*trips*drawn/sum(trips) OVER (PARTITION BY point, destination) AS trips) FROM {name}_rows")
    cte(f"{name}_z", f"""SELECT point, sum((volume - traffic)*(volume - traffic)) z FROM
  (SELECT t.point, i.edge_id, c.traffic, sum(t.trips) volume FROM {name}_od t JOIN inc i USING (origin, destination)
   JOIN counts c ON c.edge_id = i.edge_id GROUP BY 1, 2, 3) GROUP BY 1""")


# The published start: one corner, and three that lie 3 * size / (3 * sqrt(2)) from it in two of the three parameters.
cte("corners", f"""SELECT point, {FIT_INIT[0]}*10 + da*far a, {FIT_INIT[1]}*10 + db*far b, {FIT_INIT[2]} + dk*far k
  FROM (VALUES (0::INTEGER, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0, 1, 1), (2, 1, 0, 1), (3, 1, 1, 0)) c(point, da, db, dk),
  (SELECT {FIT_SIZE}::DOUBLE / sqrt(2) far)""")
z_of("corner", "corners")
# Every corner as the one to halve towards; the corner itself stays where it is, so row (t, t) is its own objective.
cte("halved", """SELECT 4*t.point + c.point point, (c.a - t.a)*0.5 + t.a a, (c.b - t.b)*0.5 + t.b b, (c.k - t.k)*0.5 + t.k k
  FROM corners c CROSS JOIN corners t""")
z_of("halved", "halved")

# Every corner as the worst one, numbered as above: row (w, w) is the reflection, the others stay; set 4 is the start.
cte("mirrored", """SELECT 4*w.point + c.point point, CASE WHEN c.point = w.point THEN 2*(s.a - w.a)/3 - w.a ELSE c.a END a,
  CASE WHEN c.point = w.point THEN 2*(s.b - w.b)/3 - w.b ELSE c.b END b,
  CASE WHEN c.point = w.point THEN 2*(s.k - w.k)/3 - w.k ELSE c.k END k
  FROM corners c CROSS JOIN corners w CROSS JOIN (SELECT sum(a) a, sum(b) b, sum(k) k FROM corners) s
  UNION ALL SELECT 16 + point, a, b, k FROM corners""")
z_of("mirrored", "mirrored")

# The whole fit, one statement a step: reflect the worst corner, or halve the simplex if the same one is worst again.
STEPS = 2 * FIT_ITERATIONS - 1  # a halving never follows a halving, and the first step reflects


def fit_step(i: int) -> None:
    """Simplex ``fit{i}(point, a, b, k, z, last, done)`` after one more step; once all reflections are done it stays."""
    old = f"fit{i - 1}"
    cte(f"fit{i}_plan", f"""SELECT *, CASE WHEN done >= {FIT_ITERATIONS} THEN 'stay' WHEN worst = last THEN 'halve' ELSE 'reflect' END what FROM
  (SELECT min(last) last, min(done) done, sum(a) sa, sum(b) sb, sum(k) sk FROM {old}),
  (SELECT point worst FROM {old} ORDER BY z DESC, point LIMIT 1),
  (SELECT point best, a best_a, b best_b, k best_k FROM {old} ORDER BY z, point LIMIT 1)""")
    new = lambda x: f"""CASE WHEN what = 'reflect' AND point = worst THEN 2*(s{x} - {x})/3.0 - {x}
    WHEN what = 'halve' AND point <> best THEN ({x} - best_{x})*0.5 + best_{x} ELSE {x} END"""  # noqa: E731
    cte(f"fit{i}_moved", f"""SELECT point, {new('a')} a, {new('b')} b, {new('k')} k, z,
    CASE what WHEN 'reflect' THEN worst WHEN 'halve' THEN -1 ELSE last END new_last, done + (what = 'reflect')::INTEGER done,
    what = 'reflect' AND point = worst OR what = 'halve' fresh FROM (SELECT point, a, b, k, z FROM {old}), fit{i}_plan""")
    z_of(f"fit{i}_new", f"(SELECT point, a, b, k FROM fit{i}_moved WHERE fresh)")
    cte(f"fit{i}", f"SELECT m.point, a, b, k, coalesce(n.z, m.z) z, new_last last, done FROM fit{i}_moved m LEFT JOIN fit{i}_new_z n USING (point)")


cte("fit0", "SELECT c.point, a, b, k, z, -1 last, 0 done FROM corners c JOIN corner_z USING (point)")
for i_ in range(1, STEPS + 1):
    fit_step(i_)
cte("fit_best", f"SELECT 0 point, a, b, k FROM fit{STEPS} ORDER BY z, point LIMIT 1")
z_of("fit_last", "fit_best")

# chains

cte("chain_edges", """SELECT 4*edge_id edge_id, source_node, target_node, length, travel_time, is_oneway FROM links WHERE source_node % 9 <> 0
  UNION ALL
  SELECT 4*edge_id + 1 + i, CASE i WHEN 0 THEN source_node WHEN 1 THEN -2*edge_id - 1 ELSE -2*edge_id - 2 END,
    CASE i WHEN 0 THEN -2*edge_id - 1 WHEN 1 THEN -2*edge_id - 2 ELSE target_node END,
    length*share, travel_time*share, is_oneway
  FROM links, (VALUES (0, 0.25), (1, 0.25), (2, 0.5)) s(i, share) WHERE source_node % 9 = 0""")
cte("chain_ways", """SELECT edge_id, source_node a, target_node b, length, travel_time, true is_open FROM chain_edges
  UNION ALL SELECT edge_id, target_node, source_node, length, travel_time, NOT is_oneway FROM chain_edges""")
cte("chain_inner", """SELECT node FROM (SELECT a node, count(*) n FROM chain_ways GROUP BY 1)
  WHERE n = 2 AND node NOT IN (SELECT node_id FROM zones)""")
cte("chain_runs", """SELECT w.a, w.edge_id, w.edge_id, w.b, w.length, w.travel_time, w.is_open FROM chain_ways w
  WHERE w.a NOT IN (SELECT node FROM chain_inner)
  UNION ALL
  SELECT r.start, r.first_edge, w.edge_id, w.b, r.length + w.length, r.travel_time + w.travel_time, r.is_open AND w.is_open
  FROM chain_runs r JOIN chain_inner n ON n.node = r.node JOIN chain_ways w ON w.a = r.node AND w.edge_id <> r.last_edge""",
    "(start, first_edge, last_edge, node, length, travel_time, is_open)")
cte("chain_done", """SELECT * FROM chain_runs WHERE node NOT IN (SELECT node FROM chain_inner) AND node <> start""")
cte("chain_pair", """SELECT f.start, f.node, f.length, f.travel_time, f.is_open along, b.is_open against
  FROM chain_done f JOIN chain_done b ON b.first_edge = f.last_edge AND b.last_edge = f.first_edge AND b.start = f.node
  WHERE f.first_edge < f.last_edge
     OR (f.first_edge = f.last_edge AND f.start = (SELECT e.source_node FROM chain_edges e WHERE e.edge_id = f.first_edge))""")


def needed(text: str, known: set[str]) -> None:
    for word in re.findall(r"[a-z_0-9]+", text):
        if word in CTES and word not in known:
            known.add(word)
            needed(CTES[word][1], known)


def statement(select: str) -> str:
    known: set[str] = set()
    needed(select, known)
    parts = []
    for name in CTES:
        if name in known:
            columns, body = CTES[name]
            recursive = bool(columns)
            parts.append(f"{name}{columns} AS {'' if recursive else 'MATERIALIZED '}(\n  {body}\n)")
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select


def od(name: str, value: str = "trips", digits: int = 6) -> str:
    return f"SELECT origin, destination, round({value}, {digits}) {value} FROM {name}"


def deterrence(expression: str) -> str:
    return f"SELECT origin, destination, round({expression}, 9) AS \"value\" FROM cost"


def path_text(name: str) -> str:
    return f"(SELECT origin, destination, string_agg(edge_id::VARCHAR, ',' ORDER BY seq) path FROM {name} GROUP BY 1, 2)"


CONF_SET = """SELECT variable, CASE variable WHEN 'F' THEN 'deterrence' WHEN 'delta' THEN NULL ELSE variable END AS field,
  CASE WHEN variable = 'delta' THEN 'unknown variable'
    WHEN variable = 'F' THEN CASE WHEN value NOT IN ('log_normal', 'top_log_normal', 'exponencial', 'kvadratic') THEN 'unknown deterrence function' END
    WHEN try_cast(value AS DOUBLE) IS NULL THEN 'not a number'
    WHEN variable IN ('length_coef', 'time_coef') AND try_cast(value AS DOUBLE) < 0 THEN 'negative or undefined' END AS refusal, count(*) AS n
FROM (
  SELECT variable, CASE WHEN variable = 'F' THEN ['log_normal', 'top_log_normal', 'exponencial', 'kvadratic', 'linear', ''][c_nationkey % 6 + 1]
    WHEN c_nationkey = 0 THEN 'much' ELSE c_acctbal::VARCHAR END AS value
  FROM (SELECT *, ['length_coef', 'time_coef', 'alpha', 'beta', 'gamma', 'F', 'search_radius', 'delta'][c_custkey % 8 + 1] AS variable FROM customer)
) GROUP BY ALL"""

SELECTS = {
    "cost_matrix": "SELECT origin, destination, cost FROM cost",
    "conf_set": CONF_SET,
    "network_load": "SELECT edge_id, u, v, length, travel_time FROM arcs",
    "zones_load": "SELECT zone_id, node_id, trips FROM zones",
    "counts_load": "SELECT edge_id, traffic FROM counts",
    "node_lookup": "SELECT zone_id, 3*node_id node_id FROM zones WHERE 3*node_id NOT IN (SELECT node FROM degree)",
    "udf_deterrence": deterrence("1.0/(1.0 + cost)"),
    "udf_limit": "SELECT origin, destination, round(trips, 6) trips, round(lo, 6) lo, round(up, 6) up FROM l_cell",
    "node_degree": "SELECT node, degree FROM degree",
    "link_count": "SELECT count(*) links FROM (SELECT * FROM links)",
    "edge_cost": "SELECT edge_id, 0.75*length + 0.25*travel_time AS cost FROM links",
    "deterrence_log_normal": deterrence("2.0*exp(-0.3*ln(cost + 1))"),
    "deterrence_top_log_normal": deterrence("2.0*exp(-0.3*ln(cost/10.0))"),
    "deterrence_exponential": deterrence("2.0*exp(-0.05*cost)"),
    "deterrence_quadratic": deterrence("1.0/(cost*cost)"),
    "deterrence_tanner": od("tanner"),
    "gravity_seed": od("seed"),
    "bracket": 'SELECT edge_id, round(least(volume - traffic, 0), 6) AS "value" FROM vol',
    "fw_direction": od("one_dir", "dir"),
    "step_bounds": "SELECT round(lower_, 9) AS \"lower\", round(upper_, 9) AS \"upper\" FROM gm1_bound",
    "reachable_filter": "SELECT count(*) labelled, count(*) FILTER (cost <> 0) kept FROM pairs_near",
    "counted_edge_filter": "SELECT origin, destination, seq, edge_id FROM walk WHERE edge_id IN (SELECT edge_id FROM counts)",
    "radius_prune": "SELECT src, node, dist FROM lab_near",
    "constraint_check_cell": f"SELECT round(avg(CASE WHEN lo <= trips AND trips <= up THEN 1.0 ELSE 0.0 END), 6) share FROM {L_CELL}",
    "constraint_check_row": f"SELECT round(avg(CASE WHEN lo < total AND total < up THEN 1.0 ELSE 0.0 END), 6) share FROM {L_SIDES['origin']}",
    "constraint_check_total": f"SELECT lo <= total AND total <= up AS ok FROM {L_SIDES['total']}",
    "row_factor_join": od("seed_rows"),
    "col_factor_join": od("seed_cols"),
    "od_path_join": "SELECT w.origin, w.destination, w.seq, w.edge_id, round(t.trips, 6) trips FROM walk w JOIN od t USING (origin, destination)",
    "residual_lookup": "SELECT i.origin, i.destination, i.edge_id, round(v.volume - v.traffic, 6) resid FROM inc i JOIN vol v USING (edge_id)",
    "margin_join": """SELECT origin, destination, round(trips, 6) trips, round(sum(trips) OVER (PARTITION BY origin), 6) row_total,
  round(sum(trips) OVER (PARTITION BY destination), 6) col_total FROM od""",
    "multiplier_lookup": f"""SELECT t.zone origin, round(total, 6) total, round(lo, 6) lo, round(up, 6) up, round(beta, 6) beta,
  round(delta, 6) delta, round({penalty('t.total', 't')}, 6) penalty FROM {L_SIDES['origin']} t""",
    "zone_pair_expand": "SELECT origin, destination, cost FROM pairs",
    "shortest_dist": "SELECT src, node, dist FROM lab",
    "shortest_paths": f"SELECT c.origin, c.destination, c.cost, p.path FROM cost c JOIN {path_text('walk')} p USING (origin, destination)",
    "paths_with_trips": f"""SELECT t.origin, t.destination, round(t.trips, 6) trips, coalesce(p.path, '') path
  FROM od t LEFT JOIN {path_text('walk_near')} p USING (origin, destination)""",
    "counted_incidence": "SELECT origin, destination, edge_id FROM inc",
    "chain_contraction": """SELECT CASE WHEN along THEN start ELSE node END source_node, CASE WHEN along THEN node ELSE start END target_node,
  length, travel_time, NOT (along AND against) is_oneway FROM chain_pair WHERE along OR against""",
    "chain_merge": """SELECT CASE WHEN source_node % 9 = 0 THEN 4*edge_id + 1 ELSE 4*edge_id END link_id, source_node, target_node,
  length, travel_time, is_oneway, CASE WHEN source_node % 9 = 0
  THEN concat_ws(',', 4*edge_id + 1, 4*edge_id + 2, 4*edge_id + 3) ELSE (4*edge_id)::VARCHAR END members FROM links""",
    "row_sum": "SELECT origin, round(sum(trips), 6) total FROM od GROUP BY 1",
    "col_sum": "SELECT destination, round(sum(trips), 6) total FROM od GROUP BY 1",
    "total_trips": "SELECT round(sum(trips), 6) total FROM od",
    "balance_coef": """SELECT (SELECT round(avg(factor), 6) FROM od_factor) column_coef, (SELECT round(avg(z.trips / t.total), 6)
  FROM (SELECT origin, sum(trips) total FROM od GROUP BY 1) t JOIN zones z ON z.zone_id = t.origin) row_coef""",
    "edge_volume_counted": "SELECT edge_id, round(volume, 6) volume FROM vol",
    "objective_z": """SELECT round(sum((traffic - volume)*(traffic - volume)), 3) z,
  (SELECT count(*) FROM counts) - count(*) uncovered_counts FROM vol""",
    "rmse": "SELECT round(sqrt(sum((traffic - volume)*(traffic - volume)) / (SELECT count(*) FROM counts)), 6) rmse FROM vol",
    "lsq_scale_k": "SELECT round(sum(traffic*volume) / sum(volume*volume), 6) k FROM vol",
    "cg_beta_pr": f"SELECT round({beta_sql('pr')}, 6) beta FROM gm2_cell",
    "cg_beta_fr": f"SELECT round({beta_sql('fr')}, 6) beta FROM gm2_cell",
    "gradient": "SELECT origin, destination, round(g, 6) grad FROM gm1_grad",
    "line_search": od("gm1_od"),
    "od_by_origin": "SELECT origin, count(*) n_destinations, string_agg(destination::VARCHAR, ',' ORDER BY destination) destinations FROM od GROUP BY 1",
    "gravity_od": od("od"),
    "balance": od("tanner_od"),
    "gravity_od_k": """SELECT origin, destination, round(trips * (SELECT sum(traffic*volume) / sum(volume*volume) FROM tanner_vol), 6) trips
  FROM tanner_od""",
    "gravity_od_simplex": od("fit_last_od"),
    "simplex_objective": "SELECT point, round(z, 3) z FROM corner_z",
    "simplex_shrink": """SELECT (point % 4)::INTEGER point, round(z, 3) z FROM halved_z
  WHERE point // 4 = (SELECT arg_min(point // 4, z) FROM halved_z WHERE point // 4 = point % 4)""",
    "simplex_reflect": """SELECT (point % 4)::INTEGER point, round(z, 3) z FROM mirrored_z
  WHERE point // 4 = (SELECT arg_max(point % 4, z) FROM mirrored_z WHERE point // 4 = 4)""",
    "assign_v1": "SELECT w.edge_id, round(sum(t.trips), 6) volume FROM walk w JOIN od t USING (origin, destination) GROUP BY 1",
    "assign_v2": "SELECT w.edge_id, round(sum(t.trips), 6) volume FROM walk w JOIN od t USING (origin, destination) GROUP BY 1",
    "calibrate_gm": od(FINAL["gm"]),
    "calibrate_fr": od(FINAL["fr"]),
    "calibrate_pr": od(FINAL["pr"]),
    "calibrate_lagrange": od(L_CELL),
    "lagrange_gradient": od("one_dir", "grad"),
    "lagrange_line_search": "SELECT round(p0, 2) p0, round(p1, 2) p1, round(step, 9) step FROM one_step",
    "lagrange_multipliers": all_sides("round(total, 6) total, round(beta, 6) beta, round(delta, 6) delta"),
    "lagrange_limits": all_sides("round(lo, 6) lo, round(up, 6) up")
    + " UNION ALL SELECT 'cells' side, 0::BIGINT zone, round(sum(lo), 6) lo, round(sum(up), 6) up FROM l_cell",
}


def oracle_sql() -> dict[str, str]:
    return {name: statement(select) for name, select in SELECTS.items()}
