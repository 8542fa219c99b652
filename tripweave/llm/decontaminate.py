"""Benchmark decontamination: a prefix-filtered containment join of benchmark windows with whole documents.

Every window of ``window`` consecutive item words is a set of shingles of ``shingle`` words (fewer where the
item is shorter). A document holds a window only if it holds all its shingles, so the necessary prefix is the
one rarest shingle, by its count over all documents. Documents look up each of their shingles in a bitmap of
those prefixes and hand on the few that are set, with the words around them; a join on the shingle's hash, the
bounds on position and length and a comparison of the words themselves then find the exact occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import ALNUM_BYTES, Words, map_runs, saved, signed

BITMAP_BITS = 23  # the bitmap sent to every task has this fixed size, whatever the benchmark holds


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    cells = hashes.select(F.col("hash").bitwiseAND((1 << bits) - 1).alias("cell")).distinct()
    found = np.zeros(1 << bits, bool)
    for batch in cells.toArrow().to_batches():  # at most 2 ** bits cells
        found[np.asarray(batch.column(0))] = True
    return np.packbits(found, bitorder="little")


def _marked(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    cells = hashes & np.uint64((1 << bits) - 1)
    return (bitmap[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 > 0


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """``item_id, words, length, size, hashes``: the windows of each item with the hashes of their shingles."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1), ALNUM_BYTES)
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for i, count in enumerate(words.counts.tolist()):
            length, size, first = min(window, count), min(shingle, count), int(words.first[i])
            hashes = signed(words.shingles(size)) if count else None
            for start in range(first, first + count - length + 1) if count else ():
                rows.append((ids[i], words.string(start, start + length), length, size, hashes[start : start + length - size + 1].tolist()))
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    schema = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("length", pa.int32()), ("size", pa.int32()), ("hashes", pa.list_(pa.int64()))])
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    return map_runs(rows, "text", "item_id string, words string, length int, size int, hashes array<long>", work, 1 << 16)


def _counts(documents: DataFrame, text: str, bitmap, bits: int, sizes: list[int]) -> DataFrame:
    """How often each shingle that the bitmap marks occurs in all documents."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, found = Words(batch.column(0), ALNUM_BYTES), []
        for size in sizes:
            hashes = words.shingles(size)
            found.append(hashes[_marked(bitmap.value, hashes, bits) & words.whole(size)])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["hash", "n"])

    return map_runs(documents.select(text), text, "hash long, n long", work).groupBy("hash").agg(F.sum("n").alias("n"))


def _candidates(documents: DataFrame, doc_id: str, text: str, bitmap, bits: int, sizes: list[int], window: int) -> DataFrame:
    """One row a document: its number of words, and the places whose shingle the bitmap marks with the words around."""
    place = pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("before", pa.int32()), ("around", pa.string())])
    schema = pa.schema([("n_words", pa.int64()), ("places", pa.list_(place))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1), ALNUM_BYTES)
        places: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
        for size in sizes:
            hashes = words.shingles(size)
            hits = np.flatnonzero(_marked(bitmap.value, hashes, bits) & words.whole(size))
            rows = np.searchsorted(words.first, hits, side="right") - 1
            for at, row, value in zip(hits.tolist(), rows.tolist(), signed(hashes[hits]).tolist()):
                first, end = int(words.first[row]), int(words.first[row + 1])
                start = max(first, at - window + size)
                places[row].append({"at": at - first, "hash": value, "before": at - start, "around": words.string(start, min(end, at + window))})
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words.counts.astype(np.int64)), pa.array(places, schema.field("places").type)],
            names=["doc_id", "n_words", "places"],
        )

    kind = documents.schema[doc_id].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, places array<struct<at:int,hash:long,before:int,around:string>>"
    return map_runs(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", out, work)


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, shingle: int = 5,
    share: int = 20, bits: int = BITMAP_BITS,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items`` for every row of ``documents``.

    A word is hit if it lies in an occurrence of an item's window; a document is contaminated if
    ``share * n_hit >= n_words`` and any word is hit. Null or empty texts have no words and are clean. Rows that repeat
    stay rows of their own. Items without id, text or words have no window; items that share an id count once.
    Columns other than the named ones are neither read nor returned. Empty tables give no rows, or clean ones.
    """
    spark = documents.sparkSession
    windows = saved(item_windows(benchmark, window, shingle))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most `shingle` values
    each = windows.dropDuplicates(["words"]).select("words", "length", F.posexplode("hashes").alias("offset", "hash"))
    marks = spark.sparkContext.broadcast(_bitmap(each, bits))
    counts = _counts(documents, text, marks, bits, sizes) if sizes else spark.createDataFrame([], "hash long, n long")
    prefixes = saved(
        each.join(counts, "hash", "left").groupBy("words", "length")
        .agg(F.min_by(F.struct("hash", "offset"), F.struct(F.coalesce("n", F.lit(0)), "hash", "offset")).alias("p"))
        .select("words", "length", "p.hash", "p.offset")
    )
    marks = spark.sparkContext.broadcast(_bitmap(prefixes, bits))
    rows = saved(_candidates(documents, doc_id, text, marks, bits, sizes, window).withColumn("row", F.monotonically_increasing_id()))

    start = F.col("before") - F.col("offset")
    hits = (
        rows.select("row", F.explode("places").alias("place")).select("row", "place.*").join(prefixes, "hash")
        .where((start >= 0) & (F.array_join(F.slice(F.split("around", " "), start + 1, F.col("length")), " ") == F.col("words")))
        .select("row", (F.col("at") - F.col("offset")).alias("start"), "length", "words").distinct()
    )
    hits = saved(hits)
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["end"]).alias("end"),
            (acc["n"] + F.greatest(x["end"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    items = (
        hits.select("row", "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
        .groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        rows.drop("places").join(spans.select("row", covered.alias("n_hit")), "row", "left").join(items, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items",
        )
    )
