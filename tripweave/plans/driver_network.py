"""A road network derived from the driver's order tables, so that it grows with them.

Customers stand on a grid of streets with express links; a zone is a block of 53 neighbours that sends and draws as
many trips as the block has orders; every supplier's line items pass one counter on the streets. Customer keys count from 0.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.conf import ModelConf
from tripweave.operators.network import Network
from tripweave.plans.model import Model
from tripweave.runtime import checkpoint

# Fixed values of the derived network.
BLOCK, CENTRE = 53, 7
EXPRESS = 8
COUNTER_STEP, COUNTER_FIRST = 11, 5
LENGTH_COEF, TIME_COEF = 0.75, 0.25
# How far the model's trips go: a parameter of the model like the weights, the same at every size of the tables.
SEARCH_RADIUS = 40.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_edges(customers: DataFrame) -> DataFrame:
    n = customers.count()
    width = math.isqrt(n)
    k = F.col("c_custkey")
    length = (1 + F.col("c_nationkey") % 7).cast("double")
    time = (1 + F.floor(F.abs("c_acctbal")).cast("long") % 5).cast("double")
    oneway = k % 13 == 5

    def edge(i: int, to, length, time, oneway, exists):
        row = F.struct(
            (5 * k + i).alias("edge_id"), k.alias("source_node"), to.alias("target_node"), length.alias("length"),
            time.alias("travel_time"), oneway.alias("is_oneway"),
        )
        return F.when(exists, row)

    never = F.lit(False)
    on_express = k % EXPRESS == 0
    rows = F.array(
        edge(0, k + 1, length, time, oneway, (k + 1 < n) & ((k + 1) % width != 0)),
        edge(1, k + width, length + 1, time, oneway, k + width < n),
        edge(2, k + EXPRESS, length + 9, time + 4, never, (k + EXPRESS < n) & on_express),
        edge(3, k + EXPRESS * width, length + 9, time + 4, never, (k + EXPRESS * width < n) & on_express),
        edge(4, k, length, time, never, k % 97 == 0),
    )
    return customers.select(F.inline(F.array_compact(rows)))


def derive_zones(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Trips per block; customers behind the last centre belong to the block before."""
    n = customers.count()
    centre = F.col("o_custkey") - F.col("o_custkey") % BLOCK + CENTRE
    node = F.when(centre < n, centre).otherwise(F.greatest(centre - BLOCK, F.lit(0)))
    trips = orders.groupBy(node.alias("node_id")).agg(F.count("*").cast("double").alias("trips"))
    return trips.select(F.floor(F.col("node_id") / float(BLOCK)).cast("long").alias("zone_id"), "node_id", "trips")


def counter_places(customers: DataFrame) -> int:
    """Number of counters: on every eleventh node's street down the grid, where there is one."""
    n = customers.count()
    return max(1, (n - math.isqrt(n) - COUNTER_FIRST - 1) // COUNTER_STEP + 1)


def derive_counts(customers: DataFrame, lineitem: DataFrame) -> DataFrame:
    place = F.pmod(F.coalesce("l_suppkey", F.lit(0)), F.lit(counter_places(customers)))
    edge = 5 * (COUNTER_STEP * place + COUNTER_FIRST) + 1
    return lineitem.groupBy(edge.cast("long").alias("edge_id")).agg(F.count("*").cast("double").alias("traffic"))


def derive_chains(edges: DataFrame) -> DataFrame:
    """Split every ninth node's outgoing edges in three, which makes chains to merge again.

    Edge ``e`` keeps the id ``4 * e``, its parts get the three behind; new nodes have negative ids, so no two ever meet.
    """
    split = (F.col("source_node") != F.col("target_node")) & (F.col("source_node") % 9 == 0)
    first, second = -2 * F.col("edge_id") - 1, -2 * F.col("edge_id") - 2

    def part(i: int, start, end, share: float):
        return F.struct(
            (4 * F.col("edge_id") + 1 + i).alias("edge_id"), start.alias("source_node"), end.alias("target_node"),
            (F.col("length") * share).alias("length"), (F.col("travel_time") * share).alias("travel_time"), "is_oneway",
        )

    whole = F.struct((4 * F.col("edge_id")).alias("edge_id"), "source_node", "target_node", "length", "travel_time", "is_oneway")
    parts = F.array(
        part(0, F.col("source_node"), first, 0.25), part(1, first, second, 0.25),
        part(2, second, F.col("target_node"), 0.5),
    )
    return edges.select(F.inline(F.when(split, parts).otherwise(F.array(whole))))


class DriverNetwork:
    """The derived tables and a model on them, each built once per session and data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, base: DriverNetwork | None = None, **options):
        """``base`` is one of the same folder, whose tables this one takes instead of building them again."""
        self.spark, self.sf_dir, self.base = spark, sf_dir, base
        self.conf = ModelConf(
            length_coef=LENGTH_COEF, time_coef=TIME_COEF, alpha=1.0, beta=-0.05, deterrence="exponencial",
            **{"search_radius": SEARCH_RADIUS} | options,
        )

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def edges(self) -> DataFrame:
        """Derived anew by each query that reads them, most of which read the network's links instead."""
        return self.base.edges if self.base else derive_edges(self.table("customer"))

    @cached_property
    def zones(self) -> DataFrame:
        return self.base.zones if self.base else checkpoint(derive_zones(self.table("customer"), self.table("orders")))

    @cached_property
    def counts(self) -> DataFrame:
        return derive_counts(self.table("customer"), self.table("lineitem"))

    @cached_property
    def network(self) -> Network:
        return self.base.network if self.base else Network.from_edges(self.edges)

    @cached_property
    def model(self) -> Model:
        return Model(self.network, self.zones, self.conf)

    @cached_property
    def od(self) -> DataFrame:
        return checkpoint(self.model.gravity_od())

    @cached_property
    def counted(self):
        return self.model.counted(self.model.costs, self.counts).settle()
