"""Lineage cuts, partition-keeping tables and size-checked broadcasts."""

from __future__ import annotations

import os
import threading
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_changing = threading.RLock()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, where unset, in a local session only, one beside its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``checkpoint``, with aggregates over the rows, which the job that writes them computes on the way."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    written = df.observe(seen, *[value.alias(name) for name, value in metrics.items()]).checkpoint(eager=True)
    return written, seen.get


@contextmanager
def static_plans(spark: SparkSession):
    """Plan without runtime re-planning, so that a checkpoint keeps the hash partitioning it was built with.

    Used only around jobs whose shuffle keys are spread evenly; everything else runs with the
    session's own adaptive setting. One thread at a time changes the session's settings.
    """
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        yield


@contextmanager
def kept_together(spark: SparkSession):
    """As ``static_plans``, and a join on more columns than a table is partitioned by leaves that table where it is."""
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        yield


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    with _changing:
        before = {name: spark.conf.get(name) for name in values}
        for name, value in values.items():
            spark.conf.set(name, value)
        try:
            yield
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(df: DataFrame, *keys: str, ordered: bool = False) -> DataFrame:
    """Checkpoint ``df`` hash-partitioned by ``keys``; later joins and groupings on them need no shuffle.

    ``ordered`` also sorts each partition by the keys, for tables that several merge joins will read.
    """
    return settle_observed(df, *keys, ordered=ordered, n=F.count(F.lit(1)))[0]


def settle_observed(df: DataFrame, *keys: str, ordered: bool = False, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``settle``, with aggregates over the rows from the same job."""
    spark = df.sparkSession
    with static_plans(spark):
        df = df.repartition(partitions(spark), *keys)
        return checkpoint_observed(df.sortWithinPartitions(*keys) if ordered else df, **metrics)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` when its known row bound is within ``limit``; join it by shuffle otherwise."""
    return F.broadcast(df) if rows <= limit else large(df)


def large(df: DataFrame) -> DataFrame:
    """``df`` to be joined by shuffle, whatever Spark takes its size to be.

    A written table keeps the size that was guessed from the files it comes from; compressed files and rows made out of
    arrays make that far too low, and a table of millions of rows would go through the driver.
    """
    return df.hint("merge")


def let_go(spark: SparkSession, wait: float = 0.0) -> None:
    """Have the files of tables and shuffles that nothing refers to any more deleted now.

    Spark deletes them once the driver's collector has found the references gone. It runs when the driver's memory fills, not
    when a disk does, and a driver that only steers jobs fills its memory slowly. The JVM hears within a second or so of what Python has
    dropped, and some of it is only found once the rest is gone: ``wait`` so many seconds, or the latest goes with a later call.
    """
    for pause in (wait, 0.2) if wait else (0.0,):
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
