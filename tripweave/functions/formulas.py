"""Scalar formulas as column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_cost(length: Column, travel_time: Column, length_coef: float, time_coef: float) -> Column:
    return F.lit(float(length_coef)) * length + F.lit(float(time_coef)) * travel_time


def log_normal(cost: Column, alpha: float, beta: float, gamma: float) -> Column:
    return F.lit(float(alpha)) * F.exp(F.lit(float(beta)) * F.log(cost + F.lit(1.0)))


def top_log_normal(cost: Column, alpha: float, beta: float, gamma: float) -> Column:
    return F.lit(float(alpha)) * F.exp(F.lit(float(beta)) * F.log(cost / F.lit(float(gamma))))


def exponential(cost: Column, alpha: float, beta: float, gamma: float) -> Column:
    """Grows with the cost for a positive ``beta``: the sign is the caller's."""
    return F.lit(float(alpha)) * F.exp(F.lit(float(beta)) * cost)


def inverse_square(cost: Column, alpha: float, beta: float, gamma: float) -> Column:
    """Takes no parameter, not even ``alpha``."""
    return F.pow(cost, F.lit(-2.0))


def tanner(cost: Column, alpha, beta) -> Column:
    """Combined power-exponential; here ``beta`` enters with a minus sign."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    beta = beta if isinstance(beta, Column) else F.lit(float(beta))
    return F.pow(cost, alpha) * F.exp(-beta * cost)


# The names under which a configuration selects a deterrence function.
DETERRENCE = {
    "log_normal": log_normal,
    "top_log_normal": top_log_normal,
    "exponencial": exponential,
    "kvadratic": inverse_square,
}


def bracket(x: Column) -> Column:
    """The negative part of ``x``."""
    return F.least(x, F.lit(0.0))


def feasible_direction(grad: Column, trips: Column, lo: Column, up: Column) -> Column:
    """Step from ``trips`` to the end of [lo, up] that lowers the objective."""
    return F.when(grad > 0, lo - trips).when(grad < 0, up - trips).otherwise(F.lit(0.0))


def step_lower(direction: Column) -> Column:
    return F.when(direction < 0, 1.0 / direction).otherwise(F.lit(float("-inf")))


def step_upper(direction: Column) -> Column:
    return F.when(direction > 0, 1.0 / direction).otherwise(F.lit(float("inf")))
