"""Trip distribution: gravity seed, balancing, scaling to counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.conf import ModelConf
from tripweave.functions.formulas import tanner
from tripweave.runtime import checkpoint, large, small


class Zoning:
    """Zones with their checked count, so that one-row-per-zone tables can be broadcast safely."""

    def __init__(self, zones: DataFrame, conf: ModelConf):
        self.zones = zones
        self.conf = conf
        self.n = zones.count()

    def small(self, df: DataFrame, copies: int = 1) -> DataFrame:
        return small(df, self.n * copies, self.conf.broadcast_rows)

    def trips_at(self, side: str, name: str) -> DataFrame:
        """Trips by ``side`` (origin or destination); zones without trips take no part in a gravity model."""
        return self.zones.where("trips <> 0").select(F.col("zone_id").alias(side), F.col("trips").alias(name))


def with_zone_trips(cost: DataFrame, zoning: Zoning) -> DataFrame:
    return cost.join(zoning.small(zoning.trips_at("origin", "sent")), "origin").join(
        zoning.small(zoning.trips_at("destination", "drawn")), "destination"
    )


def gravity_seed(cost: DataFrame, zoning: Zoning, deterrence: Column) -> DataFrame:
    """Unbalanced trips: what the origin sends, times what the destination draws, times the deterrence."""
    return with_zone_trips(cost, zoning).select(
        "origin", "destination", (F.col("sent") * F.col("drawn") * deterrence).alias("trips")
    )


def tanner_seed(cost: DataFrame, zoning: Zoning, alpha, beta) -> DataFrame:
    return gravity_seed(cost, zoning, tanner(F.col("cost"), alpha, beta))


def margin(od: DataFrame, side: str) -> DataFrame:
    """Trips per origin or per destination; partial sums are formed before the shuffle."""
    return od.groupBy(side).agg(F.sum("trips").alias("total"))


def total_trips(od: DataFrame) -> DataFrame:
    return od.agg(F.sum("trips").alias("total"))


def factors(od: DataFrame, side: str, zoning: Zoning) -> DataFrame:
    """Balance factor per zone: its trips over its margin."""
    return margin(od, side).join(zoning.small(zoning.trips_at(side, "target")), side).select(
        side, F.try_divide("target", "total").alias("factor")
    )


def scale_by(od: DataFrame, factor: DataFrame, side: str, zoning: Zoning) -> DataFrame:
    """Multiply each cell by its zone's factor; the factor table has one row per zone and is broadcast if checked."""
    return od.join(zoning.small(factor), side).select(
        "origin", "destination", (F.col("trips") * F.col("factor")).alias("trips")
    )


def mean_factor(factor: DataFrame) -> DataFrame:
    return factor.agg(F.avg("factor").alias("coef"))


def one_pass(od: DataFrame, zoning: Zoning) -> tuple[DataFrame, DataFrame]:
    """Rows, then columns: afterwards columns match exactly and rows nearly.  Also returns the column factors."""
    rows = scale_by(od, factors(od, "origin", zoning), "origin", zoning)
    col_factor = factors(rows, "destination", zoning)
    return scale_by(rows, col_factor, "destination", zoning), col_factor


def balance(od: DataFrame, zoning: Zoning, max_iter: int = 1, tolerance: float = 0.01) -> DataFrame:
    """Alternate row and column scaling until the mean column factor is within ``tolerance`` of 1, at most ``max_iter`` times."""
    for i in range(max_iter):
        od, col_factor = one_pass(od, zoning)
        if i + 1 < max_iter:
            od = checkpoint(od)
            coef = mean_factor(col_factor).first()["coef"]
            if coef is not None and abs(coef - 1.0) <= tolerance:
                break
    return od


def gravity_od(cost: DataFrame, zoning: Zoning, conf: ModelConf, max_iter: int = 1) -> DataFrame:
    return balance(gravity_seed(cost, zoning, conf.deterrence_of(F.col("cost"))), zoning, max_iter)


def edge_volume_counted(od: DataFrame, incidence: DataFrame) -> DataFrame:
    """Modelled flow on the counted edges that any path uses."""
    return incidence.join(large(od), ["origin", "destination"]).groupBy("edge_id").agg(F.sum("trips").alias("volume"))


def compare(volumes: DataFrame, counts: DataFrame, n_counts: int, conf: ModelConf) -> DataFrame:
    return volumes.join(small(counts, n_counts, conf.broadcast_rows), "edge_id")


def objective_z(volumes: DataFrame, counts: DataFrame, n_counts: int, conf: ModelConf) -> DataFrame:
    """Squared error over edges with flow; counted edges on no path are left out and reported."""
    off = F.col("traffic") - F.col("volume")
    return compare(volumes, counts, n_counts, conf).agg(
        F.sum(off * off).alias("z"), (F.lit(n_counts) - F.count("*")).alias("uncovered_counts")
    )


def rmse(volumes: DataFrame, counts: DataFrame, n_counts: int, conf: ModelConf) -> DataFrame:
    """Root of the squared error over the number of all counts, used or not."""
    return objective_z(volumes, counts, n_counts, conf).select(F.sqrt(F.col("z") / F.lit(float(n_counts))).alias("rmse"))


def lsq_scale_k(volumes: DataFrame, counts: DataFrame, n_counts: int, conf: ModelConf) -> DataFrame:
    """The factor on all trips that fits the counts best in least squares."""
    return compare(volumes, counts, n_counts, conf).agg(
        F.try_divide(F.sum(F.col("traffic") * F.col("volume")), F.sum(F.col("volume") * F.col("volume"))).alias("k")
    )


def with_margins(od: DataFrame, zoning: Zoning) -> DataFrame:
    """Each cell with the total of its row and of its column."""
    rows = margin(od, "origin").withColumnRenamed("total", "row_total")
    cols = margin(od, "destination").withColumnRenamed("total", "col_total")
    return od.join(zoning.small(rows), "origin").join(zoning.small(cols), "destination")


def by_origin(od: DataFrame) -> DataFrame:
    """Each origin with its destinations: an array of the zones within the search radius, which bounds it."""
    return od.groupBy("origin").agg(
        F.count("*").alias("n_destinations"), F.array_sort(F.collect_list("destination")).alias("destinations")
    )
