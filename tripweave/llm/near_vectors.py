"""Near-duplicate vectors: p-stable hashing of normalised vectors into buckets, then exact cosines inside buckets.

A table's bucket is the tuple of ``floor((a . x + b) / width)`` over a few random directions ``a``; close vectors share a bucket
in one of several tables with a chance that the parameters set. Equal vectors are one class first. Large buckets are cut
into blocks, and every pair of blocks is compared, so no bucket is capped and none has to fit one task. A pair that shares
several buckets counts in the first only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import mix, saved, signed
from tripweave.llm.components import components

LEAST_COSINE = 0.93
# At cosine 0.93 (distance 0.374) a direction agrees with chance 0.81, six with 0.29, and one of 20 tables with 0.999.
TABLES, DIRECTIONS, WIDTH = 20, 6, 1.6
BLOCK = 512


@lru_cache(maxsize=4)
def _directions(dim: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    dice = np.random.default_rng(seed)
    return dice.normal(size=(TABLES * DIRECTIONS, dim)), dice.uniform(0, WIDTH, TABLES * DIRECTIONS)


def _buckets(vectors: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per vector and table, of vectors of length 1."""
    a, b = _directions(vectors.shape[1])
    cells = np.floor((vectors @ a.T + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), TABLES, DIRECTIONS)
    found = np.zeros((len(vectors), TABLES), np.uint64)
    for i in range(DIRECTIONS):
        found = mix(found * np.uint64(0x9FB21C651E98DF25) + cells[:, :, i])
    return found


def _compare(ids, weights, vectors, codes, table, two: np.ndarray | None):
    """Links of one group: rows whose block flag ``two`` is set are compared with the others only (None: all pairs)."""
    sides = np.flatnonzero(~two) if two is not None else np.arange(len(ids)), np.flatnonzero(two) if two is not None else np.arange(len(ids))
    left, right = sides
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    cosine = vectors[left] @ vectors[right].T / np.outer(lengths[left], lengths[right])
    linked = cosine >= LEAST_COSINE
    for i, j in np.argwhere(np.abs(cosine - LEAST_COSINE) < 1e-9):  # the last digits depend on the order of the sum
        x, y = vectors[left[i]], vectors[right[j]]
        linked[i, j] = float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))) >= LEAST_COSINE
    if two is None:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    fresh = linked.copy()
    for t in range(table):
        fresh &= codes[left, t][:, None] != codes[right, t][None, :]
    counts = np.zeros(len(ids), np.int64)
    counts[left] += fresh @ weights[right]
    if two is not None:
        counts[right] += weights[left] @ fresh
    # Each linked vector points at the smallest id of its part of the group.
    label = ids.copy()
    while True:
        new = label.copy()
        new[left] = np.minimum(new[left], np.where(linked, label[right][None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        new[right] = np.minimum(new[right], np.where(linked, new[left][:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
        if (new == label).all():
            break
        label = new
    return counts, label


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows``; ids are integers.

    Rows link when their labels are equal and not null, their vectors have the same number of components and their cosine
    is at least ``LEAST_COSINE``. Null and empty vectors, zero vectors and those with null or non-finite components link with nothing, and
    neither do rows without an id. Every row counts as a vector of its own, also if ids or whole rows repeat. Other columns are not read.
    """
    element = "double" if "double" in rows.schema[vector].dataType.simpleString() else "float"
    dtype = np.float64 if element == "double" else np.float32
    source = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).cast(f"array<{element}>").alias("vector"))
    good = F.col("key").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    source = source.withColumn("class", F.when(good, F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256)))
    members = saved(source.select("key", "label", "class"))
    classes = source.where("class is not null").groupBy("label", "class").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    classes = saved(saved(classes).withColumn("id", F.monotonically_increasing_id()))
    label_type = classes.schema["label"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten()).astype(dtype)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            codes = np.zeros((batch.num_rows, TABLES), np.int64)
            for dim in set(sizes.tolist()):
                at = np.flatnonzero(sizes == dim)
                x = flat[(starts[at][:, None] + np.arange(dim))].astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                codes[at] = signed(_buckets(x / np.sqrt((x * x).sum(1, keepdims=True))))
            code_lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, TABLES, dtype=np.int32), pa.array(codes.ravel()))
            data = pa.array([flat[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), code_lists, data], names=["label", "id", "n", "codes", "data"])

    coded = classes.select("label", "id", "n", "vector").mapInArrow(hashed, f"label {label_type}, id long, n long, codes array<long>, data binary")
    coded = saved(coded)
    each = coded.select("label", "id", F.length("data").alias("size"), F.posexplode("codes").alias("table", "bucket"))
    group = ["label", "size", "table", "bucket"]
    sizes = each.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    placed = each.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int"))
    # Block pairs (i, j), i <= j: a row goes to each pair that its block is in.
    to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = placed.select(*group, "id", "block", to).select(
        *group, "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second")
    )
    rows_of = coded.select("label", "id", "n", "codes", "data")
    dealt = paired.join(rows_of, ["label", "id"]).select("label", "size", "table", "bucket", "i", "j", "second", "id", "n", "codes", "data")
    where = ["label", "size", "table", "bucket", "i", "j"]
    dealt = dealt.repartition(*where).sortWithinPartitions(*where)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != held_key and held:
                    yield from _group(held_key, held)
                    held = []
                held_key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _group(held_key, held)

    def _group(where_key, parts) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(parts).combine_chunks()
        if part.num_rows < 2:
            return
        ids, weights = part["id"].to_numpy(), part["n"].to_numpy()
        codes = part["codes"].combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
        vectors = np.frombuffer(b"".join(part["data"].to_pylist()), dtype).reshape(len(ids), -1).astype(np.float64)
        two = None if where_key[4] == where_key[5] else np.asarray(part["second"])
        found = _compare(ids, weights, vectors, codes, where_key[2], two)
        if found is not None:
            counts, labels = found
            on = (counts > 0) | (labels != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(labels[on]), pa.array(counts[on])], names=["id", "to", "links"])

    found = saved(dealt.mapInArrow(compared, "id long, to long, links long"))
    joined = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = (
        classes.select("label", "class", "key", "id", "n").join(links, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "class", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    by_class = saved(by_class)
    smallest = by_class.groupBy("component").agg(F.min("key").alias("component_id"))
    by_class = by_class.drop("key").join(smallest, "component").drop("component")
    return members.join(by_class, ["label", "class"], "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id")
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
