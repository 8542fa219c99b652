"""The three input relations: schemas, checks, and the way in from Python rows or any Spark source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = T.StructType(
    [
        T.StructField("edge_id", T.LongType()),
        T.StructField("source_node", T.LongType()),
        T.StructField("target_node", T.LongType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("travel_time", T.DoubleType()),
        T.StructField("is_oneway", T.BooleanType()),
    ]
)
ZONES = T.StructType(
    [
        T.StructField("zone_id", T.LongType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("trips", T.DoubleType()),
    ]
)
COUNTS = T.StructType(
    [
        T.StructField("edge_id", T.LongType()),
        T.StructField("traffic", T.DoubleType()),
    ]
)


def from_rows(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small hand-written table, such as a worked example."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of ``schema``; a missing column raises at analysis."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """Return ``df``, or raise naming some of the keys that occur more than once."""
    twice = df.groupBy(key).count().where("count > 1").select(key).take(5)
    if twice:
        raise ValueError(f"{what}: {key} occurs more than once, e.g. {[r[0] for r in twice]}")
    return df


def amounts(df: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """Return ``df``, or raise naming some of the rows without a key or with a missing, negative, infinite or undefined value."""
    good = F.col(key).isNotNull() & (F.col(value) >= 0) & (F.col(value) < float("inf"))
    bad = df.where(~F.coalesce(good, F.lit(False))).select(key, value).take(5)
    if bad:
        raise ValueError(f"{what}: {value} must be a number from 0 on, e.g. not {[tuple(r) for r in bad]}")
    return df


def load_zones(df: DataFrame) -> DataFrame:
    """Zones keyed by ``zone_id``; ``trips`` is both what a zone sends and what it attracts."""
    return unique(amounts(conform(df, ZONES), "zone_id", "trips", "zones"), "zone_id", "zones")


def load_counts(df: DataFrame) -> DataFrame:
    """Observed traffic keyed by ``edge_id``."""
    return unique(amounts(conform(df, COUNTS), "edge_id", "traffic", "counts"), "edge_id", "counts")
