"""Calibration under cell, row, column and total limits: augmented Lagrangian with Frank-Wolfe steps.

Beside the cells there is one table of sums over them, ``(side, key, total, lo, up, beta, delta)``: a row per origin, a row per
destination, and a row per counted edge, whose volume is ``total`` and whose count is ``lo``. All of them are linear in the
step. So a step is two jobs: one writes the cells' directions, the other sums these directions over all three sides in
one grouping and adds up, on the way, the slope of the objective at both ends of the step. The total is a few numbers on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.formulas import bracket, feasible_direction
from tripweave.operators.calibration import PAIR, Counted, gradient
from tripweave.operators.demand import Zoning
from tripweave.runtime import checkpoint, checkpoint_observed, large, settle, small, static_plans

Limit = Callable[[Column, str, int], Column]
# The level a limit is asked for.
CELL, MARGIN, TOTAL = 0, 1, 2


def with_limits(od: DataFrame, limit: Limit) -> DataFrame:
    """Cells with limits frozen from the matrix they start from."""
    return od.select(
        *PAIR, "trips", limit(F.col("trips"), "lo", CELL).alias("lo"), limit(F.col("trips"), "up", CELL).alias("up")
    )


MARGINS = {"row": "origin", "col": "destination"}
EDGE = "edge"
LIMITED = ("total", "lo", "up", "beta", "delta")


def sums_by_side(cells: DataFrame, counted: Counted, value: str, name: str) -> DataFrame:
    """``side, key`` and the sum of a cell value over each origin, each destination and each counted edge."""
    margins = cells.select(
        F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.col(zone).alias("key"), F.col(value).alias(name)) for side, zone in MARGINS.items()]))
    )
    edges = counted.incidence.join(large(cells.select(*PAIR, value)), PAIR).select(
        F.lit(EDGE).alias("side"), F.col("edge_id").alias("key"), F.col(value).alias(name)
    )
    return margins.unionByName(edges).groupBy("side", "key").agg(F.sum(name).alias(name))


def margin_limits(cells: DataFrame, counted: Counted, limit: Limit) -> DataFrame:
    """The sums of the matrix to start from, margins with limits frozen, edges with their counts."""
    zero = F.lit(0.0)
    counts = counted.counts.select(F.lit(EDGE).alias("side"), F.col("edge_id").alias("key"), "traffic")
    found = sums_by_side(cells, counted, "trips", "total").join(counted.small(counts), ["side", "key"], "left")
    is_edge = F.col("side") == EDGE
    return found.where(~is_edge | F.col("traffic").isNotNull()).select(
        "side", "key", "total", F.when(is_edge, F.col("traffic")).otherwise(limit(F.col("total"), "lo", MARGIN)).alias("lo"),
        F.when(~is_edge, limit(F.col("total"), "up", MARGIN)).alias("up"), zero.alias("beta"), zero.alias("delta"),
    )


def side_of(marks: DataFrame, side: str) -> DataFrame:
    return marks.where(F.col("side") == side)


def margin_of(marks: DataFrame, side: str) -> DataFrame:
    """``origin`` or ``destination`` with its total, limits and multipliers."""
    return side_of(marks, side).select(F.col("key").alias(MARGINS[side]), *LIMITED)


def edges_of(marks: DataFrame) -> DataFrame:
    return side_of(marks, EDGE).select(F.col("key").alias("edge_id"), F.col("lo").alias("traffic"), F.col("total").alias("volume"))


def total_limits(od: DataFrame, limit: Limit) -> dict[str, float]:
    total = F.col("total")
    found = od.agg(F.sum("trips").alias("total")).select("total", limit(total, "lo", TOTAL).alias("lo"), limit(total, "up", TOTAL).alias("up")).first()
    return {**found.asDict(), "beta": 0.0, "delta": 0.0}


def penalty(total, lo, up, beta, delta, scale: float) -> Column:
    """Slope of the penalty in a sum: negative below its limits, positive above, 0 inside."""
    return F.lit(2.0 * scale) * (bracket(total - lo + beta) - bracket(up - total + delta))


def penalty_of(scale: float, moved: Column | None = None) -> Column:
    total, *rest = (F.col(c) for c in LIMITED)
    return penalty(total if moved is None else moved, *rest, scale)


def total_penalty(total: dict[str, float], moved: float, scale: float) -> float:
    below = min(total["total"] + moved - total["lo"] + total["beta"], 0.0)
    above = min(total["up"] - total["total"] - moved + total["delta"], 0.0)
    return 2.0 * scale * (below - above)


def margin_join(cells: DataFrame, table: DataFrame, side: str, scale: float, zoning: Zoning) -> DataFrame:
    """``cells`` with the penalty slope of their row or column."""
    slopes = table.select(side, penalty_of(scale).alias(f"{side}_penalty"))
    return cells.join(zoning.small(slopes), side)


def lagrange_gradient(cells: DataFrame, counted: Counted, marks: DataFrame, total: dict[str, float], scale: float,
                      penalty_terms: str, zoning: Zoning) -> DataFrame:
    """``cells`` with ``grad``: twice the residual sum plus the penalty slopes.

    ``penalty_terms='all'`` takes rows, columns and total, as published; ``'rows'`` takes rows only.
    """
    cells = gradient(cells, counted, edges_of(marks))
    grad = 2.0 * F.col("g")
    for side in MARGINS if penalty_terms == "all" else ("row",):
        cells = margin_join(cells, margin_of(marks, side), MARGINS[side], scale, zoning)
        grad = grad + F.col(f"{MARGINS[side]}_penalty")
    if penalty_terms == "all":
        grad = grad + F.lit(total_penalty(total, 0.0, scale))
    return cells.withColumn("grad", grad)


def moved_marks(directed: DataFrame, counted: Counted, marks: DataFrame, zoning: Zoning) -> DataFrame:
    """``marks`` with ``move``: how each sum changes over the whole step."""
    moves = sums_by_side(directed, counted, "dir", "move")
    bound = 2 * zoning.n + counted.n_counts
    return small(marks, bound, counted.conf.broadcast_rows).join(moves, ["side", "key"])


def slope_sums(scale: float) -> dict[str, Column]:
    """Slope of edges and margins along the step at its start and end, the squared error, and how the total changes."""
    is_edge, move = F.col("side") == EDGE, F.col("move")
    gap = F.col("total") - F.col("lo")

    def slope(at: float) -> Column:
        moved = F.col("total") + F.lit(at) * move
        return F.sum(F.when(is_edge, 2.0 * move * (gap + F.lit(at) * move)).otherwise(move * penalty_of(scale, moved)))

    return {"p0": slope(0.0), "p1": slope(1.0), "z": F.sum(F.when(is_edge, gap * gap)), "move": F.sum(F.when(F.col("side") == "row", move))}


def whole_slopes(sums: dict, total: dict[str, float], scale: float) -> tuple[float, float]:
    """Slope of the whole objective at step 0 and step 1."""
    move = sums["move"]
    return sums["p0"] + move * total_penalty(total, 0.0, scale), sums["p1"] + move * total_penalty(total, move, scale)


def line_step(p0: float, p1: float) -> float:
    """Secant point when the slope changes sign inside the step, else the end with the flatter slope."""
    if p0 * p1 < 0:
        return abs(p0) / (abs(p0) + abs(p1))
    return 0.0 if abs(p0) < abs(p1) else 1.0


def updated_multipliers(marks: DataFrame, rule: str) -> DataFrame:
    """Add what is left to each limit: ``raw`` as it is, ``bracket`` its negative part only; edges have no multipliers."""
    below = F.col("total") - F.col("lo") + F.col("beta")
    above = F.col("up") - F.col("total") + F.col("delta")
    if rule == "bracket":
        below, above = bracket(below), bracket(above)
    kept = F.col("side") == EDGE
    return marks.withColumns({"beta": F.when(kept, F.col("beta")).otherwise(below), "delta": F.when(kept, F.col("delta")).otherwise(above)})


def updated_total(total: dict[str, float], rule: str) -> dict[str, float]:
    below = total["total"] - total["lo"] + total["beta"]
    above = total["up"] - total["total"] + total["delta"]
    if rule == "bracket":
        below, above = min(below, 0.0), min(above, 0.0)
    return {**total, "beta": below, "delta": above}


def constraint_check_cell(cells: DataFrame) -> DataFrame:
    return cells.agg(F.avg(F.expr("CASE WHEN lo <= trips AND trips <= up THEN 1.0D ELSE 0.0D END")).alias("share"))


def constraint_check_margin(table: DataFrame) -> DataFrame:
    """Share of zones strictly inside their limits."""
    return table.agg(F.avg(F.expr("CASE WHEN lo < total AND total < up THEN 1.0D ELSE 0.0D END")).alias("share"))


def constraint_check_total(table: DataFrame) -> DataFrame:
    return table.select(F.expr("lo <= total AND total <= up").alias("ok"))


def check_options(penalty_terms: str, multiplier_update: str) -> None:
    if penalty_terms not in ("all", "rows"):
        raise ValueError("penalty_terms must be 'all' or 'rows'")
    if multiplier_update not in ("raw", "bracket"):
        raise ValueError("multiplier_update must be 'raw' or 'bracket'")


def calibrate_lagrange(od: DataFrame, counted: Counted, zoning: Zoning, m: int, s: int, scale: float, limit: Limit,
                       penalty_terms: str = "all", multiplier_update: str = "raw") -> dict:
    """``s + 1`` subproblems of ``m + 1`` Frank-Wolfe steps each.

    Returns the matrix as ``cells`` (with limits), the margin tables and the history of steps.
    """
    check_options(penalty_terms, multiplier_update)
    spark = od.sparkSession
    counted = counted.settle()
    cells = settle(with_limits(od, limit), *PAIR)
    marks = checkpoint(margin_limits(cells, counted, limit))
    total = total_limits(cells, limit)
    history: list[dict] = []
    for i in range(s + 1):
        for j in range(m + 1):
            graded = lagrange_gradient(cells, counted, marks, total, scale, penalty_terms, zoning)
            directed = graded.select(
                *PAIR, "trips", "lo", "up",
                feasible_direction(F.col("grad"), F.col("trips"), F.col("lo"), F.col("up")).alias("dir"),
            )
            with static_plans(spark):
                directed = checkpoint(directed)
            marks, sums = checkpoint_observed(moved_marks(directed, counted, marks, zoning), **slope_sums(scale))
            if sums["z"] is None:
                raise ValueError("no counted edge lies on any path")
            step = line_step(*whole_slopes(sums, total, scale))
            history.append({"subproblem": i, "round": j, "z": sums["z"], "step": step})
            cells = directed.withColumn("trips", F.col("trips") + F.lit(step) * F.col("dir")).drop("dir")
            moved = (F.col("total") + F.lit(step) * F.col("move")).alias("total")
            marks = marks.select(*[moved if c == "total" else c for c in marks.columns if c != "move"])
            total["total"] += step * sums["move"]
        marks, total = updated_multipliers(marks, multiplier_update), updated_total(total, multiplier_update)
    whole = spark.createDataFrame([tuple(total[c] for c in LIMITED)], ", ".join(f"{c} double" for c in LIMITED))
    return {"cells": cells, "rows": margin_of(marks, "row"), "cols": margin_of(marks, "col"), "total": whole, "history": history}
