"""Ranked lexical search over a K2-treap.

Documents are dealt into blocks. A block is a grid of its terms (rows) and documents (columns) whose cells hold the term's impact in
the document. The grid is a quadtree of which only non-empty quadrants exist: a byte with four bits says which
children a node has, their place follows from counting bits, and each node has the largest impact below it, kept as the difference
to its parent's. The written blocks are the index; a search reads nothing else.

A search goes best-first over document ranges: a range has one node per query term, its path towards the term's row, and the
sum of their weighted maxima bounds every document in it. The most promising ranges of all queries are split in one go; a range
whose bound is below the query's k-th best score so far is left. A range of one document is its exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import ALNUM_BYTES, Words, runs, saved, signed, small_batches

TOP = 20
BLOCK_BYTES = 16 << 20  # of text in a block
QUERY_BYTES = 4 << 20  # of query texts that are searched for at a time
AT_ONCE = 24  # ranges of a query that are split in one go
SALTS = 64

_ONES = np.array([bin(b).count("1") for b in range(16)], np.int64)
_NO_ID = np.iinfo(np.int64).max  # stands for a null id, which sorts last


def postings(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms of a block of texts, and the cells (row, column, tf) by row; ``hashes`` are all words, ``sizes`` how many each text has."""
    terms, row = np.unique(hashes, return_inverse=True)
    column = np.repeat(np.arange(len(sizes)), sizes)
    cells, tf = np.unique(row.astype(np.int64) * max(len(sizes), 1) + column, return_counts=True)
    return terms, cells // max(len(sizes), 1), cells % max(len(sizes), 1), tf


POSTINGS = "ids binary, sizes binary, terms binary, df binary, columns binary, tf binary, n_docs long, n_terms long"


def posting_blocks(documents: DataFrame, doc_id: str, text: str, size: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents: their ids and lengths, the terms with their document counts, and the cells by term."""
    small_batches(documents.sparkSession)

    def block(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes, hashes = (np.concatenate(p) for p in zip(*held))
        terms, rows, columns, tf = postings(hashes, sizes)
        data = [ids, sizes, terms, np.bincount(rows, minlength=len(terms)).astype(np.int32), columns.astype(np.int32), tf.astype(np.int32)]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([d.tobytes()], pa.binary()) for d in data), pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64())],
            names=["ids", "sizes", "terms", "df", "columns", "tf", "n_docs", "n_terms"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0
        for batch in batches:
            for start, stop in runs(batch.column(1)):
                part = batch.slice(start, stop - start)
                words = Words(part.column(1), ALNUM_BYTES)
                ids = np.asarray(part.column(0).fill_null(_NO_ID), dtype=np.int64)
                held.append((ids, words.counts.astype(np.int64), words.hashes))
                bytes_held += len(words.data)
                if bytes_held >= size:
                    yield block(held)
                    held, bytes_held = [], 0
        if held:
            yield block(held)

    return documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(work, POSTINGS)


def impacts(tf: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a document adds for a term of weight 1; ``sizes`` are the documents' numbers of terms."""
    m = 75 + (25 * sizes * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Treap:
    """Nodes of a quadtree from the root down, level by level; children of a node follow each other in the next level."""

    def __init__(self, bits: np.ndarray, peaks: np.ndarray, height: int) -> None:
        self.bits, self.peaks, self.height = bits, peaks, height
        # The root is node 0 and every other node is some node's child, in order.
        self.child = 1 + np.concatenate([np.zeros(1, np.int64), np.cumsum(_ONES[bits])[:-1]]) if len(bits) else np.zeros(0, np.int64)

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> Treap:
        """Cells sorted by their interleaved row and column bits, merged four to one up to the root."""
        code = np.zeros(len(rows), np.int64)
        for b in range(height):
            code |= ((rows >> b) & 1) << (2 * b + 1) | ((columns >> b) & 1) << (2 * b)
        order = np.argsort(code)
        code, peaks = code[order], values[order].astype(np.int64)
        levels = [(np.zeros(len(code), np.uint8), peaks)]
        for _ in range(height):
            up = code >> 2
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]])) if len(up) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(np.uint8(1) << (code & 3).astype(np.uint8), first) if len(up) else np.zeros(0, np.uint8)
            peaks = np.maximum.reduceat(peaks, first) if len(up) else peaks
            code = up[first]
            levels.append((bits, peaks))
        levels.reverse()
        return Treap(np.concatenate([b for b, _ in levels]), np.concatenate([p for _, p in levels]), height)

    def parents(self) -> np.ndarray:
        """The parent of each node but the root."""
        return np.repeat(np.arange(len(self.bits)), _ONES[self.bits])

    def packed(self) -> tuple[bytes, bytes]:
        """The bits of the nodes, and how far each maximum lies below its parent's."""
        falls = self.peaks.copy()
        falls[1:] = self.peaks[self.parents()] - self.peaks[1:]
        return self.bits.tobytes(), falls.astype(np.int32).tobytes()

    @staticmethod
    def unpacked(bits: bytes, falls: bytes, height: int) -> Treap:
        made = Treap(np.frombuffer(bits, np.uint8), np.zeros(0, np.int64), height)
        fall = np.frombuffer(falls, np.int32).astype(np.int64)
        peaks = fall.copy()
        start, stop = 0, min(1, len(peaks))
        parents = made.parents()
        while stop < len(peaks):  # a level at a time
            end = stop + int(_ONES[made.bits[start:stop]].sum())
            peaks[stop:end] = peaks[parents[stop - 1 : end - 1]] - fall[stop:end]
            start, stop = stop, end
        made.peaks = peaks
        return made


INDEX = "ids binary, terms binary, df binary, bits binary, falls binary, height int"


def treap_blocks(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """The index: one compressed treap per block; ``n`` documents with ``total`` terms give the impacts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                terms, df = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["df"], np.int32)
                if not len(terms):
                    continue
                sizes, columns = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["columns"], np.int32).astype(np.int64)
                values = impacts(np.frombuffer(row["tf"], np.int32).astype(np.int64), sizes[columns], n, total)
                height = max(1, int(max(len(terms), len(sizes)) - 1).bit_length())
                bits, falls = Treap.build(np.repeat(np.arange(len(terms)), df), columns, values, height).packed()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([d], pa.binary()) for d in (row["ids"], row["terms"], row["df"], press.compress(bits), press.compress(falls))), pa.array([height], pa.int32())],
                    names=["ids", "terms", "df", "bits", "falls", "height"],
                )

    return blocks.drop("n_docs", "n_terms").mapInArrow(work, INDEX)


class Queries:
    """Terms of a block of queries in one array, by query: hash and how often the query has it."""

    def __init__(self, texts: pa.Array, items: np.ndarray) -> None:
        words = Words(texts, ALNUM_BYTES)
        self.items = items
        self.terms, term = np.unique(words.hashes, return_inverse=True)
        of = np.repeat(np.arange(len(texts)), words.counts)
        pairs, times = np.unique(of * max(len(self.terms), 1) + term, return_counts=True)
        self.of, self.term, self.times = pairs // max(len(self.terms), 1), pairs % max(len(self.terms), 1), times
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], n: int) -> None:
        counts = np.array([df.get(t, 0) for t in signed(self.terms).tolist()], np.int64)
        self.weights = np.floor(1000 * np.log((2 * n + 2) / (2 * counts + 1))).astype(np.int64)


class Best:
    """The ``top`` best documents of each query so far: highest score, then smallest id."""

    def __init__(self, queries: int, top: int) -> None:
        self.top = top
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(queries, np.int64)  # a score below this one cannot be among them

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = _places(query)
        keep = place < self.top
        last = place == self.top - 1
        self.least[query[last]] = score[last]
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def _places(groups: np.ndarray) -> np.ndarray:
    """The place, from 0, of each entry within its run of equal values."""
    if not len(groups):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.concatenate([first, [len(groups)]])))


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` numbers from ``first[i]`` on, for each i."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


class Frontier:
    """Ranges still to be looked at (query, level, first column, bound) with their term paths (node, row, weight) behind each other."""

    def __init__(self, query, level, column, bound, counts, node, row, weight) -> None:
        self.query, self.level, self.column, self.bound, self.counts = query, level, column, bound, counts
        self.node, self.row, self.weight = node, row, weight

    def take(self, which: np.ndarray) -> Frontier:
        """The ranges at the places ``which``, in that order."""
        first = np.cumsum(self.counts) - self.counts
        at = _spread(first[which], self.counts[which])
        return Frontier(self.query[which], self.level[which], self.column[which], self.bound[which], self.counts[which], self.node[at], self.row[at], self.weight[at])

    def joined(self, other: Frontier) -> Frontier:
        return Frontier(*(np.concatenate([a, b]) for a, b in zip(self._all(), other._all())))

    def _all(self):
        return self.query, self.level, self.column, self.bound, self.counts, self.node, self.row, self.weight


def split(chosen: Frontier, treap: Treap) -> Frontier:
    """Both halves of each range, with the paths one row and column bit further; paths into empty quadrants end."""
    of = np.repeat(np.arange(len(chosen.query)), chosen.counts)
    shift = treap.height - 1 - chosen.level
    row_bit = (chosen.row >> shift[of]) & 1
    bits = treap.bits[chosen.node].astype(np.int64)
    halves = []
    for side in (0, 1):
        place = 2 * row_bit + side
        there = np.flatnonzero((bits >> place) & 1)
        below = bits[there] & ((1 << place[there]) - 1)
        node = treap.child[chosen.node[there]] + _ONES[below]
        halves.append((2 * of[there] + side, node, chosen.row[there], chosen.weight[there]))
    owner, node, row, weight = (np.concatenate(p) for p in zip(*halves))
    order = np.argsort(owner, kind="stable")
    owner, node, row, weight = owner[order], node[order], row[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    bound = np.add.reduceat(weight * treap.peaks[node], first) if len(owner) else np.zeros(0, np.int64)
    range_of, side = owner[first] >> 1, owner[first] & 1
    return Frontier(
        chosen.query[range_of], chosen.level[range_of] + 1, chosen.column[range_of] + (side << shift[range_of]), bound,
        np.diff(np.concatenate([first, [len(owner)]])), node, row, weight,
    )


def search_block(treap: Treap, ids: np.ndarray, terms: np.ndarray, queries: Queries, best: Best) -> None:
    """Add a block's documents to the best of each query."""
    at = np.searchsorted(terms, queries.terms)
    found = terms[np.minimum(at, len(terms) - 1)] == queries.terms
    weight = queries.weights[queries.term] * queries.times
    used = np.flatnonzero(found[queries.term] & (weight > 0))
    if not len(used):
        return
    query, first, counts = np.unique(queries.of[used], return_index=True, return_counts=True)
    weight = weight[used]
    bound = np.add.reduceat(weight, first) * treap.peaks[0]
    none = np.zeros(len(query), np.int64)
    open_ranges = Frontier(query, none, none, bound, counts, np.zeros(len(used), np.int64), at[queries.term[used]], weight)
    while len(open_ranges.query):
        order = np.lexsort((-open_ranges.bound, open_ranges.query))
        order = order[open_ranges.bound[order] >= best.least[open_ranges.query[order]]]
        now = _places(open_ranges.query[order]) < AT_ONCE
        halves = split(open_ranges.take(order[now]), treap)
        done = halves.level == treap.height
        best.add(halves.query[done], halves.bound[done], ids[halves.column[done]])
        further = np.flatnonzero(~done & (halves.bound >= best.least[halves.query]))
        open_ranges = open_ranges.take(order[~now]).joined(halves.take(further))


def _document_counts(blocks: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents hold each of ``terms``."""
    wanted = blocks.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, df = np.frombuffer(held, np.uint64), np.frombuffer(df, np.int32)
                if len(held):
                    at = np.minimum(np.searchsorted(held, wanted.value), len(held) - 1)
                    hit = held[at] == wanted.value
                    yield pa.RecordBatch.from_arrays([pa.array(signed(wanted.value[hit])), pa.array(df[at[hit]].astype(np.int64))], names=["term", "df"])

    counted = blocks.select("terms", "df").mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}  # at most one row per term of the queries held at a time


def _search(index: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``item, doc_id, score``: the best of each query among the blocks of a task."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        best = Best(len(sent.value.items), top)
        for batch in batches:
            for row in batch.to_pylist():
                treap = Treap.unpacked(unpress.decompress(row["bits"]), unpress.decompress(row["falls"]), row["height"])
                search_block(treap, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["terms"], np.uint64), sent.value, best)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value.items[best.query]), pa.array(best.id, mask=best.id == _NO_ID), pa.array(best.score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(work, "item long, doc_id long, score long")


def _item_blocks(items: DataFrame, size: int) -> Iterator[pa.Table]:
    """``item, item_id, text`` of the queries, about ``size`` bytes at a time; ``item`` numbers the rows."""
    numbered = saved(items.withColumn("item", F.monotonically_increasing_id()))
    whole = numbered.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    count = -(-int(whole) // size)
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(count, 1))))
    for block in range(count):
        yield dealt.where(F.col("block") == block).select("item", "item_id", "text").toArrow().combine_chunks()


def ranked_search(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  top: int = TOP, block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each row of ``items`` with a score above 0; document ids are integers.

    Null and empty texts have no terms: such documents are not found and such items find nothing. Rows are what is ranked: a document
    that occurs twice is found twice, and items with the same id each have their ranks. Equal scores go by ascending id, null ids last.
    Other columns are not read, whatever their names. Terms are told apart by 64-bit hashes.
    """
    blocks = saved(posting_blocks(documents, doc_id, text, block_bytes))
    n, total = (int(x or 0) for x in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    index = saved(treap_blocks(blocks, n, max(total, 1)))
    spark, kind = items.sparkSession, items.schema[item_id].dataType
    found = None
    for held in _item_blocks(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), query_bytes):
        if not len(held):
            continue
        queries = Queries(held.column("text").chunk(0), np.asarray(held.column("item")))
        queries.weigh(_document_counts(blocks, queries.terms), n)
        names = spark.createDataFrame(held.select(["item", "item_id"])).withColumn("item_id", F.col("item_id").cast(kind))
        one = _search(index, queries, top).join(names, "item")
        found = saved(one) if found is None else saved(found.unionByName(one))
    if found is None:
        found = items.select(F.lit(0).cast("long").alias("item"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.col(item_id).alias("item_id")).limit(0)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id"), "score")
