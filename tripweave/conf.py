"""Model parameters."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.formulas import DETERRENCE

# The setter names a caller may use, with the field each one fills.
SETTERS = {
    "length_coef": "length_coef",
    "time_coef": "time_coef",
    "alpha": "alpha",
    "beta": "beta",
    "gamma": "gamma",
    "F": "deterrence",
    "search_radius": "search_radius",
}

# Settings that must not be negative or undefined.
WEIGHTS = ("length_coef", "time_coef")


@dataclass(frozen=True)
class ModelConf:
    """Cost weights, deterrence function and search limits.

    ``deterrence`` is one of the names in ``DETERRENCE`` or a function that takes the cost column and
    returns a column.  ``broadcast_rows`` bounds every table the engine broadcasts: a table whose counted rows exceed
    it is joined by shuffle instead.  The default is some 10 MB, as each such table goes through the driver, in each round anew.  ``hops_per_round`` is the number of
    arcs a label may advance per Spark job when the search runs without a shuffle.  ``tree_rows`` is about how many rows
of trees are held at a time where paths are walked from so many sources that theirs have more.  ``band`` is how many mean arc
    costs the front of the search moves on per hop: less means fewer labels expanded too early, but more hops;
    infinity expands every label at once.
    """

    length_coef: float = 1.0
    time_coef: float = 1.0
    alpha: float = 0.0
    beta: float = 0.0
    gamma: float = 0.0
    deterrence: str | Callable[[Column], Column] = "log_normal"
    search_radius: float = math.inf
    broadcast_rows: int = 200_000
    hops_per_round: int = 8
    tree_rows: int = 10_000_000
    band: float = 1.25

    def set(self, variable: str, value) -> ModelConf:
        """Return a copy with one parameter changed; unknown names raise."""
        if variable not in SETTERS:
            raise ValueError(f"unknown variable {variable!r}; use one of {', '.join(SETTERS)}")
        if variable in WEIGHTS and not float(value) >= 0:
            raise ValueError(f"{variable} must not be negative or undefined: {value}")
        if variable != "F":
            return replace(self, **{SETTERS[variable]: float(value)})
        if not callable(value) and value not in DETERRENCE:
            raise ValueError(f"unknown deterrence function {value!r}; use one of {', '.join(DETERRENCE)}")
        return replace(self, deterrence=value)

    def deterrence_of(self, cost: Column) -> Column:
        if callable(self.deterrence):
            return self.deterrence(cost)
        if self.deterrence == "top_log_normal" and self.gamma <= 0:
            raise ValueError("top_log_normal needs gamma > 0")
        return DETERRENCE[self.deterrence](cost, self.alpha, self.beta, self.gamma)


def checked_settings(settings: DataFrame) -> DataFrame:
    """``settings(variable, value)``, all strings, with ``field``, what the variable sets, and ``refusal``, null where
    ``ModelConf.set`` would take the value."""
    number = F.expr("try_cast(value AS DOUBLE)")
    field = F.coalesce(*[F.when(F.col("variable") == name, F.lit(to)) for name, to in SETTERS.items()])
    refusal = (
        F.when(field.isNull(), "unknown variable")
        .when(F.col("variable") == "F", F.when(~F.coalesce(F.col("value").isin(*DETERRENCE), F.lit(False)), "unknown deterrence function"))
        .when(number.isNull(), "not a number")
        .when(F.col("variable").isin(*WEIGHTS) & ((number < 0) | F.isnan(number)), "negative or undefined")
    )
    return settings.select("variable", "value", field.alias("field"), refusal.alias("refusal"))


def from_settings(settings: DataFrame, conf: ModelConf | None = None) -> ModelConf:
    """``conf``, the default one if none is given, with every setting of a table that names each variable at most once."""
    rows = checked_settings(settings).limit(len(SETTERS) + 1).collect()  # more rows than variables cannot all be right
    for row in rows:
        if row["refusal"]:
            raise ValueError(f"{row['variable']} = {row['value']}: {row['refusal']}")
    if len(rows) != len({row["variable"] for row in rows}):
        raise ValueError("a variable is set more than once")
    conf = conf or ModelConf()
    for row in rows:
        conf = conf.set(row["variable"], row["value"])
    return conf
