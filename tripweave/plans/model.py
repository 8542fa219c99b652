"""The model a user works with: a network, zones and a configuration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.conf import ModelConf
from tripweave.operators import assignment, calibration, constrained, demand, fit, paths, skim, trees
from tripweave.operators.network import Network, check_nodes
from tripweave.runtime import checkpoint, large, let_go
from tripweave.sources.tables import load_counts, load_zones


class Skim:
    """Searches from a set of nodes, done once: labels, trees and their lifted tables."""

    def __init__(self, network: Network, sources: DataFrame, conf: ModelConf):
        self.network, self.sources, self.conf = network, sources, conf

    @cached_property
    def labels(self) -> DataFrame:
        return skim.shortest_dist(self.network, self.sources, self.conf)

    @cached_property
    def tree(self) -> DataFrame:
        return trees.shortest_tree(self.labels, self.network, self.conf)

    @cached_property
    def levels(self) -> list[DataFrame]:
        return trees.lift(self.tree)

    def shares(self) -> Iterator[tuple[Column, Skim]]:
        """The searches from a share of the sources at a time, such that its trees have some ``ModelConf.tree_rows`` rows; with the condition that takes its sources.

        Trees and lifted tables take several times the room of the labels. A share has its own and they go with it; all sources
        are one share if they are within the bound, or if their trees are there already.
        """
        n = 1 if "tree" in self.__dict__ else math.ceil(self.labels.count() / self.conf.tree_rows)
        if n <= 1:
            yield F.lit(True), self
            return
        for i in range(n):
            taken = F.pmod(F.xxhash64("src"), F.lit(n)) == i
            share = Skim(self.network, self.sources.where(taken), self.conf)
            share.__dict__["labels"] = self.labels.where(taken)
            yield taken, share


@dataclass
class Counts:
    table: DataFrame
    n: int


class Model:
    def __init__(self, network: Network, zones: DataFrame, conf: ModelConf):
        self.network = network
        self.conf = conf
        self.zones = checkpoint(load_zones(zones))
        check_nodes(self.zones, network)
        self.zoning = demand.Zoning(self.zones, conf)

    @cached_property
    def skim(self) -> Skim:
        """The searches from all zones."""
        return self.skim_of(self.zones)

    def skim_of(self, origins: DataFrame) -> Skim:
        """Searches from some zones only, to pass to the methods below."""
        return Skim(self.network, origins.select(F.col("node_id").alias("src")), self.conf)

    def skim_for(self, od: DataFrame) -> Skim:
        """Searches from the origins of ``od`` only, unless those from all zones are done already."""
        if "skim" in self.__dict__:
            return self.skim
        used = od.select(F.col("origin").alias("zone_id")).distinct()
        return self.skim_of(self.zones.join(large(used), "zone_id", "left_semi"))

    def counts(self, counts: DataFrame) -> Counts:
        table = checkpoint(load_counts(counts))
        return Counts(table, table.count())

    def idle_zones(self) -> DataFrame:
        """Zones without trips, which the gravity models leave out."""
        return self.zones.where("trips = 0")

    # distribution

    def cost_matrix(self, origins: DataFrame | None = None, skim_: Skim | None = None) -> DataFrame:
        """Costs from ``origins`` (all zones by default) to the model's zones."""
        if origins is not None and skim_ is None:
            skim_ = self.skim_of(origins)
        labels = (skim_ or self.skim).labels
        return skim.cost_matrix(labels, self.zones if origins is None else origins, self.zones, self.zoning.n, self.conf)

    @cached_property
    def costs(self) -> DataFrame:
        """The full cost matrix, written once."""
        return checkpoint(self.cost_matrix())

    def gravity_od(self, cost: DataFrame | None = None, max_iter: int = 1) -> DataFrame:
        """Balanced gravity matrix with the configured deterrence function."""
        return demand.gravity_od(self.costs if cost is None else cost, self.zoning, self.conf, max_iter)

    def balance(self, od: DataFrame, max_iter: int = 1) -> DataFrame:
        return demand.balance(od, self.zoning, max_iter)

    def costs_from(self, origins: DataFrame | None) -> tuple[DataFrame, Skim]:
        """The cost matrix from ``origins``, all zones by default, and the searches it comes from."""
        if origins is None:
            return self.costs, self.skim
        searched = self.skim_of(origins)
        return checkpoint(self.cost_matrix(origins, searched)), searched

    def gravity_od_k(self, init: tuple[float, float, float], counts: DataFrame, origins: DataFrame | None = None) -> DataFrame:
        """Balanced power-exponential gravity matrix, scaled to the counts; the third value of ``init`` is not used."""
        cost, searched = self.costs_from(origins)
        counted = self.counted(cost, counts, searched)
        od = checkpoint(demand.balance(demand.tanner_seed(cost, self.zoning, init[0], init[1]), self.zoning))
        volumes = demand.edge_volume_counted(od, counted.incidence)
        k = demand.lsq_scale_k(volumes, counted.counts, counted.n_counts, self.conf).first()["k"]
        if k is None:
            raise ValueError("no counted edge lies on any path")
        return od.withColumn("trips", F.col("trips") * F.lit(k))

    def gravity_od_simplex(self, init: tuple[float, float, float], counts: DataFrame, max_iter: int, size: float,
                           origins: DataFrame | None = None):
        """Gravity matrix whose (alpha, beta, k) are fitted to the counts: (matrix, incidence, fit)."""
        cost, searched = self.costs_from(origins)
        counted = self.counted(cost, counts, searched).settle()
        base = fit.base_cells(cost, self.zoning)
        found = fit.fit_simplex(base, counted, self.zoning, init, max_iter, size)
        od = fit.balanced_points(base, [found.point], self.zoning).drop("point")
        return od, counted.incidence, found

    # paths and assignment

    def pairs(self, od: DataFrame) -> DataFrame:
        return paths.at_nodes(od, self.zones, self.zoning.n, self.conf)

    def path_links(self, od: DataFrame, skim_: Skim | None = None) -> DataFrame:
        """``(origin, destination, seq, edge_id)`` along the path of each pair of ``od``."""
        s, pairs, written = skim_ or self.skim_for(od), self.pairs(od), []
        for taken, share in s.shares():
            if share is s:
                return paths.path_links(pairs, s.tree, s.levels, self.network)
            tree = share.tree
            let_go(pairs.sparkSession, wait=1.5)  # what the tree was sorted out of
            written.append(checkpoint(paths.path_links(pairs.where(taken), tree, share.levels, self.network)))
            tree = None
            share.__dict__.clear()
            let_go(pairs.sparkSession, wait=1.5)
        return reduce(DataFrame.unionByName, written)

    def shortest_paths(self, cost: DataFrame | None = None, origins: DataFrame | None = None) -> DataFrame:
        """``(origin, destination, cost, path)`` for all pairs in reach, of ``cost`` or from ``origins``."""
        searched = None
        if cost is None:
            cost, searched = self.costs_from(origins)
        return paths.collect_paths(cost, self.path_links(cost, searched))

    def paths_with_trips(self, od: DataFrame, skim_: Skim | None = None) -> DataFrame:
        """``od`` with the path of each pair; a pair out of reach keeps its trips and an empty path."""
        return paths.collect_paths(od, self.path_links(od, skim_))

    def assign(self, od: DataFrame, skim_: Skim | None = None, sweep: bool = False) -> DataFrame:
        """Volume per edge when all trips take the shortest path.

        ``sweep`` sums trips up by distance, in more rounds but without the ancestor tables, which take about as much disk
        as three times the trees; walks on paths share these tables.
        """
        s = skim_ or self.skim_for(od)
        return assignment.assign(self.pairs(od), s.tree, self.network, self.conf, None if sweep else s.levels)

    def assign_v1(self, od: DataFrame, origins: DataFrame | None = None) -> DataFrame:
        """The older form: joins written-out paths from ``origins`` to the matrix, so other origins add nothing."""
        cost = self.costs
        if origins is not None:
            cost = cost.join(large(origins.select(F.col("zone_id").alias("origin"))), "origin", "left_semi")
        return assignment.assign_by_paths(od, self.path_links(cost))

    # calibration

    def counted(self, od: DataFrame, counts: DataFrame | calibration.Counted, skim_: Skim | None = None) -> calibration.Counted:
        """Which counted edges lie on the path of each pair of ``od``.

        The methods that take counts also take this result, so that several of them share one set of walks.
        """
        if isinstance(counts, calibration.Counted):
            return counts
        c, s = self.counts(counts), skim_ or self.skim_for(od)
        incidence = checkpoint(
            paths.counted_incidence(self.pairs(od), s.tree, s.levels, self.network, c.table, c.n, self.conf)
        )
        return calibration.Counted(incidence, c.table, c.n, self.conf)

    def calibrate(self, od: DataFrame, counts: DataFrame, rounds: int, method: str) -> tuple[DataFrame, list[dict]]:
        """Calibrate by GM, FR or PR: (matrix, history)."""
        if method not in calibration.METHODS:
            raise ValueError(f"unknown method {method!r}; use one of {', '.join(calibration.METHODS)}")
        return calibration.calibrate(od, self.counted(od, counts), rounds, method)

    def calibrate_lagrange(self, od: DataFrame, counts: DataFrame, m: int, s: int, scale: float, limit,
                           penalty_terms: str = "all", multiplier_update: str = "raw") -> dict:
        """Calibrate under limits; ``limit(trips, 'lo' | 'up', level)`` takes and returns a column."""
        constrained.check_options(penalty_terms, multiplier_update)
        return constrained.calibrate_lagrange(
            od, self.counted(od, counts), self.zoning, m, s, scale, limit, penalty_terms, multiplier_update
        )

    def objective_z(self, volumes: DataFrame, counts: DataFrame) -> DataFrame:
        c = self.counts(counts)
        return demand.objective_z(volumes, c.table, c.n, self.conf)
