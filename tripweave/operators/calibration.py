"""Calibration of a matrix to counts by gradient and conjugate-gradient steps.

State is two tables: cells ``(origin, destination, trips, grad, grad_old, dir)`` and counted edges
``(edge_id, traffic, volume)``.  Cells and incidence are hash-partitioned alike, so a round joins and groups them
without a shuffle; only per-edge partial sums cross the network, and only scalars reach the driver.
Volumes are linear in the step, so one pass over the incidence per round gives both the step length and the
next volumes.  A round is two jobs: one writes the gradients and adds up the conjugacy sums on the way, the other writes
the edges' slopes and adds up what the step and its bounds need.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.conf import ModelConf
from tripweave.functions.formulas import step_lower, step_upper
from tripweave.operators.demand import edge_volume_counted
from tripweave.runtime import checkpoint, checkpoint_observed, large, settle, small, static_plans

METHODS = ("GM", "FR", "PR")
PAIR = ["origin", "destination"]


@dataclass
class Counted:
    """Incidence of zone pairs with counted edges, and the counts, with their checked sizes."""

    incidence: DataFrame
    counts: DataFrame
    n_counts: int
    conf: ModelConf
    settled: bool = field(default=False)

    def settle(self) -> Counted:
        if self.settled:
            return self
        return Counted(settle(self.incidence, *PAIR), self.counts, self.n_counts, self.conf, True)

    def small(self, df: DataFrame) -> DataFrame:
        return small(df, self.n_counts, self.conf.broadcast_rows)

    def edge_state(self, cells: DataFrame) -> DataFrame:
        volumes = edge_volume_counted(cells, self.incidence)
        return volumes.join(self.small(self.counts), "edge_id").select("edge_id", "traffic", "volume")


def residuals(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", (F.col("volume") - F.col("traffic")).alias("resid"))


def residual_lookup(counted: Counted, edges: DataFrame) -> DataFrame:
    """Incidence with the residual of each edge."""
    return counted.incidence.join(counted.small(residuals(edges)), "edge_id")


def gradient(cells: DataFrame, counted: Counted, edges: DataFrame) -> DataFrame:
    """``cells`` with ``g``: the residuals summed over each cell's counted edges, 0 where there are none."""
    sums = residual_lookup(counted, edges).groupBy(*PAIR).agg(F.sum("resid").alias("g"))
    return cells.join(large(sums), PAIR, "left").withColumn("g", F.coalesce("g", F.lit(0.0)))


def cg_sums() -> dict[str, Column]:
    """What the conjugacy coefficients are made of."""
    grad, old = F.col("grad"), F.col("grad_old")
    return {"pr_top": F.sum((grad - old) * grad), "fr_top": F.sum(grad * grad), "old": F.sum(old * old)}


def cg_beta(cells: DataFrame) -> DataFrame:
    """Both conjugate-gradient coefficients, from ``grad`` and ``grad_old``; 0 once the old gradient has vanished."""
    sums = cells.agg(*[value.alias(name) for name, value in cg_sums().items()])
    over_old = lambda top: F.when(F.col("old") == 0, F.lit(0.0)).otherwise(F.try_divide(top, "old"))
    return sums.select(over_old("pr_top").alias("pr"), over_old("fr_top").alias("fr"))


def step_bounds(cells: DataFrame) -> DataFrame:
    """The interval of steps that keeps every cell at or above zero."""
    return cells.agg(F.max(step_lower(F.col("dir"))).alias("lower"), F.min(step_upper(F.col("dir"))).alias("upper"))


def edge_slopes(cells: DataFrame, counted: Counted, edges: DataFrame) -> DataFrame:
    """``edges`` with ``slope``: how each volume changes with the step."""
    slopes = (
        counted.incidence.join(large(cells.select(*PAIR, "trips", "dir")), PAIR)
        .groupBy("edge_id").agg(F.sum(-F.col("dir") * F.col("trips")).alias("slope"))
    )
    return edges.join(counted.small(slopes), "edge_id").select("edge_id", "traffic", "volume", "slope")


def edge_slopes_and_bounds(cells: DataFrame, counted: Counted, edges: DataFrame) -> DataFrame:
    """As ``edge_slopes``, with ``lower`` and ``upper`` of the cells' steps in one more row, whose ``edge_id`` is null."""
    none = F.lit(None)
    slopes = counted.incidence.join(large(cells.select(*PAIR, "trips", "dir")), PAIR).select(
        "edge_id", (-F.col("dir") * F.col("trips")).alias("slope"), none.cast("double").alias("lower"), none.cast("double").alias("upper")
    )
    bounds = cells.select(
        none.cast("long").alias("edge_id"), none.cast("double").alias("slope"),
        step_lower(F.col("dir")).alias("lower"), step_upper(F.col("dir")).alias("upper"),
    )
    moves = slopes.unionByName(bounds).groupBy("edge_id").agg(
        F.sum("slope").alias("slope"), F.max("lower").alias("lower"), F.min("upper").alias("upper")
    )
    return moves.join(counted.small(edges), "edge_id", "left").select("edge_id", "traffic", "volume", "slope", "lower", "upper")


def step_sums() -> dict[str, Column]:
    """What the least-squares step and the error are made of."""
    off = F.col("traffic") - F.col("volume")
    return {"top": F.sum(F.col("slope") * off), "bottom": F.sum(F.col("slope") * F.col("slope")), "z": F.sum(off * off)}


def best_step(sloped: DataFrame) -> DataFrame:
    """The unbounded least-squares step; 0 when no volume responds."""
    sums = sloped.agg(*[value.alias(name) for name, value in step_sums().items()])
    step = F.when(F.col("bottom") == 0, F.lit(0.0)).otherwise(F.try_divide("top", "bottom"))
    return sums.select(step.alias("step"), "z")


def ratio(top: float, bottom: float) -> float:
    return top / bottom if bottom else 0.0


def clip(step: float, lower: float, upper: float) -> float:
    return min(max(step, lower), upper)


def take_step(cells: DataFrame, step: float) -> DataFrame:
    return cells.withColumn("trips", F.col("trips") * (F.lit(1.0) - F.lit(step) * F.col("dir")))


def first_cells(od: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return od.select(*PAIR, "trips", zero.alias("grad"), zero.alias("grad_old"), zero.alias("dir"))


def with_gradient(cells: DataFrame, counted: Counted, edges: DataFrame) -> DataFrame:
    return gradient(cells, counted, edges).select(
        *PAIR, "trips", F.col("g").alias("grad"), F.col("grad").alias("grad_old"), "dir"
    )


def calibrate(od: DataFrame, counted: Counted, rounds: int, method: str) -> tuple[DataFrame, list[dict]]:
    """Run a fixed number of rounds of method GM, FR or PR.

    Returns the matrix and, per round, the error before it, the step and the conjugacy coefficient.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; use one of {', '.join(METHODS)}")
    spark = od.sparkSession
    counted = counted.settle()
    cells = settle(first_cells(od), *PAIR)
    edges = checkpoint(counted.edge_state(cells))
    history: list[dict] = []
    for i in range(rounds):
        with static_plans(spark):
            cells, sums = checkpoint_observed(with_gradient(cells, counted, edges), **cg_sums())
        beta = 0.0
        if i > 0 and method != "GM":
            beta = ratio(sums[f"{method.lower()}_top"], sums["old"])
        cells = cells.withColumn("dir", F.col("grad") + F.lit(beta) * F.col("dir"))
        sloped, fit = checkpoint_observed(
            edge_slopes_and_bounds(cells, counted, edges), **step_sums(), lower=F.max("lower"), upper=F.min("upper")
        )
        if fit["z"] is None:
            raise ValueError("no counted edge lies on any path")
        step = clip(ratio(fit["top"], fit["bottom"]), fit["lower"], fit["upper"])
        history.append({"round": i, "rmse": math.sqrt(fit["z"] / counted.n_counts), "step": step, "beta": beta})
        cells = take_step(cells, step)
        edges = sloped.where("edge_id IS NOT NULL").select(
            "edge_id", "traffic", (F.col("volume") + F.lit(step) * F.col("slope")).alias("volume")
        )
    return cells.select(*PAIR, "trips"), history
