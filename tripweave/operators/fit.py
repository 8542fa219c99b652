"""Fit of the gravity parameters (alpha, beta, k) to counts by a shrinking regular simplex.

The driver holds four points of three numbers.  Objectives of all pending points come from one Spark job that
carries the points along as an extra key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions.formulas import tanner
from tripweave.operators.calibration import PAIR, Counted
from tripweave.operators.demand import Zoning, with_zone_trips
from tripweave.runtime import large, settle

Point = tuple[float, float, float]


def base_cells(cost: DataFrame, zoning: Zoning) -> DataFrame:
    """Cost and zone trips per pair, partitioned like the incidence; shared by every objective."""
    return settle(with_zone_trips(cost, zoning).select(*PAIR, "cost", "sent", "drawn"), *PAIR)


def with_points(df: DataFrame, points: list[Point]) -> DataFrame:
    """One copy of each row per parameter point; a simplex has four at most."""
    rows = [
        F.struct(F.lit(i).alias("point"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(k).alias("k"))
        for i, (a, b, k) in enumerate(points)
    ]
    return df.select("*", F.inline(F.array(*rows)))


def balanced_points(base: DataFrame, points: list[Point], zoning: Zoning) -> DataFrame:
    """Balanced and scaled trips ``(point, origin, destination, trips)`` for each parameter point."""
    seed = with_points(base, points).withColumn(
        "trips", F.col("sent") * F.col("drawn") * tanner(F.col("cost"), F.col("alpha"), F.col("beta"))
    )
    for side, target in (("origin", "sent"), ("destination", "drawn")):
        factor = seed.groupBy("point", side).agg(
            F.try_divide(F.max(target), F.sum("trips")).alias("factor")
        )
        seed = seed.join(zoning.small(factor, len(points)), ["point", side]).withColumn(
            "trips", F.col("trips") * F.col("factor")
        ).drop("factor")
    return seed.select("point", *PAIR, (F.col("k") * F.col("trips")).alias("trips"))


def objectives(base: DataFrame, counted: Counted, points: list[Point], zoning: Zoning) -> DataFrame:
    """``(point, z)`` for real parameters (alpha, beta, k)."""
    trips = balanced_points(base, points, zoning)
    volumes = trips.join(large(counted.incidence), PAIR).groupBy("point", "edge_id").agg(F.sum("trips").alias("volume"))
    off = F.col("volume") - F.col("traffic")
    return volumes.join(counted.small(counted.counts), "edge_id").groupBy("point").agg(F.sum(off * off).alias("z"))


def real(point: Point) -> Point:
    """The search runs on alpha and beta times ten."""
    return (point[0] / 10, point[1] / 10, point[2])


def start_simplex(init: Point, size: float) -> list[Point]:
    """A regular simplex with edge ``size`` whose first corner is ``init``."""
    unit = size / (3 * math.sqrt(2))
    near, far = 0.0 * unit, 3.0 * unit
    corners = [(0.0, 0.0, 0.0), (near, far, far), (far, near, far), (far, far, near)]
    base = (init[0] * 10, init[1] * 10, init[2])
    return [tuple(c + b for c, b in zip(corner, base)) for corner in corners]


def shrink(simplex: list[Point], best: int) -> list[Point]:
    """Halve the simplex towards its best corner."""
    to = simplex[best]
    return [p if i == best else tuple((x - b) * 0.5 + b for x, b in zip(p, to)) for i, p in enumerate(simplex)]


def reflect(simplex: list[Point], worst: int) -> Point:
    """Mirror the worst corner in the middle of the others."""
    others = [p for i, p in enumerate(simplex) if i != worst]
    return tuple(2 * sum(x) / 3.0 - w for x, w in zip(zip(*others), simplex[worst]))


@dataclass
class Fit:
    point: Point
    z: float
    history: list[dict] = field(default_factory=list)


def fit_simplex(base: DataFrame, counted: Counted, zoning: Zoning, init: Point, max_iter: int, size: float) -> Fit:
    """Reflect the worst corner ``max_iter`` times; shrink whenever the same corner is worst twice running."""

    def evaluate(points: list[Point]) -> list[float]:
        rows = {r["point"]: r["z"] for r in objectives(base, counted, [real(p) for p in points], zoning).collect()}
        if len(rows) < len(points):
            raise ValueError("no counted edge lies on any path")
        return [rows[i] for i in range(len(points))]

    simplex = start_simplex(init, size)
    z = evaluate(simplex)
    last_worst = None
    history: list[dict] = []
    done = 0
    while done < max_iter:
        worst, best = z.index(max(z)), z.index(min(z))
        if worst == last_worst:
            simplex = shrink(simplex, best)
            z = evaluate(simplex)
            last_worst = None
            continue
        alpha, beta, k = real(simplex[best])
        history.append({"iter": done, "alpha": alpha, "beta": beta, "k": k, "z": z[best]})
        simplex[worst] = reflect(simplex, worst)
        z[worst] = evaluate([simplex[worst]])[0]
        last_worst = worst
        done += 1
    best = z.index(min(z))
    return Fit(real(simplex[best]), z[best], history)
