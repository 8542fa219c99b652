"""Removal of repeated runs of lines, cut where the content says.

A rolling hash over the hashes of the last lines chooses where a chunk ends, so an inserted line moves the borders
near it only. Chunks of two lines or more that occur more than once in all texts are compared byte by byte, by grouping
on their text, and stay only at their first place: the smallest id, there the first chunk. Where asked for, lines of
``LONG_WORDS`` words or more are compared likewise, each on its own, wherever the borders of the chunks around them fall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import NONSPACE_BYTES, flat_bytes, free_name, map_runs, mix, saved, shingle_hashes, signed, span_hashes

ROLLING_LINES = 2
DIVISOR = 3  # one in so many places ends a chunk
LEAST_LINES, MOST_LINES = 2, 48
LONG_WORDS = 50
BITMAP_BITS = 23
LINE = 1 << 30  # numbers from here on are lines of a text, those below are chunks


class Chunks:
    """Lines and chunks of a run of texts; lines keep their line feed, so that chunks joined give the text."""

    def __init__(self, texts: pa.Array, long_lines: bool = False) -> None:
        self.data, text_starts = flat_bytes(texts)
        feeds = np.flatnonzero(self.data == 0x0A) + 1
        self.starts = np.unique(np.concatenate([text_starts[:-1], feeds[feeds < len(self.data)]])) if len(self.data) else np.zeros(0, np.int64)
        self.starts = self.starts[self.starts < len(self.data)]
        self.ends = np.concatenate([self.starts[1:], [len(self.data)]]) if len(self.starts) else self.starts
        self.first = np.searchsorted(self.starts, text_starts)
        self.bare = self.ends - (self.data[self.ends - 1] == 0x0A) if len(self.starts) else self.ends
        self.hashes = span_hashes(self.data, self.starts, self.bare)
        self.cut = self._borders()
        self.chunk_first = np.flatnonzero(np.concatenate([[True], self.cut[:-1]])) if len(self.cut) else np.zeros(0, np.int64)
        self.chunk_end = np.concatenate([self.chunk_first[1:], [len(self.starts)]]) if len(self.chunk_first) else self.chunk_first
        self.row = np.searchsorted(self.first, self.chunk_first, side="right") - 1
        first_chunk = np.searchsorted(self.chunk_first, self.first[:-1])
        self.number = np.arange(len(self.chunk_first)) - first_chunk[self.row]
        # The hash of a chunk: of its lines' hashes in order, as differences of one running sum.
        self.chunk_hash = self._chunk_hashes()
        self.lines = self.chunk_end - self.chunk_first
        # What is compared: chunks of enough lines, then long lines, each with its text's row, number, hash and bytes.
        chunks, lines = np.flatnonzero(self.lines >= LEAST_LINES), self._long_lines() if long_lines else np.zeros(0, np.int64)
        row = np.searchsorted(self.first, lines, side="right") - 1
        self.unit_row = np.concatenate([self.row[chunks], row])
        self.unit_number = np.concatenate([self.number[chunks], lines - self.first[row] + LINE])
        self.unit_hash = np.concatenate([self.chunk_hash[chunks], mix(self.hashes[lines] ^ np.uint64(0x9FB21C651E98DF25))])
        self.unit_start = np.concatenate([self.starts[self.chunk_first[chunks]], self.starts[lines]])
        self.unit_end = np.concatenate([self.bare[self.chunk_end[chunks] - 1], self.bare[lines]])

    def _borders(self) -> np.ndarray:
        """Which lines end a chunk: a text's last, and those whose rolling hash says so, within the least and most lines."""
        n = len(self.starts)
        rolling = np.concatenate([np.zeros(min(n, ROLLING_LINES - 1), np.uint64), shingle_hashes(self.hashes, ROLLING_LINES)[: max(0, n - ROLLING_LINES + 1)]])
        wanted = rolling % np.uint64(DIVISOR) == 0
        last = np.zeros(n, bool)
        last[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = True
        cut = last.copy()
        since = 0
        for i, (want, final) in enumerate(zip(wanted.tolist(), last.tolist())):
            since += 1
            if final or since >= MOST_LINES or want and since >= LEAST_LINES:
                cut[i], since = True, 0
        return cut

    def _long_lines(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.int64)
        inside = NONSPACE_BYTES[self.data]
        begins = inside & ~np.concatenate([[False], inside[:-1]])
        begins[self.starts] = inside[self.starts]
        words = np.concatenate([[0], np.cumsum(begins)])
        return np.flatnonzero(words[self.ends] - words[self.starts] >= LONG_WORDS)

    def unit(self, i: int) -> bytes:
        return self.data[self.unit_start[i] : self.unit_end[i]].tobytes()

    def line(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.bare[i]].tobytes()

    def _chunk_hashes(self) -> np.ndarray:
        value = np.zeros(len(self.chunk_first), np.uint64)
        lines = self.chunk_end - self.chunk_first
        for i in range(int(lines.max()) if len(lines) else 0):
            on = lines > i
            value[on] = mix(value[on] * np.uint64(0x9FB21C651E98DF25) + self.hashes[self.chunk_first[on] + i])
        return value

    def text(self, chunk: int) -> bytes:
        """The chunk's lines without its last line feed."""
        data = self.data[self.starts[self.chunk_first[chunk]] : self.ends[self.chunk_end[chunk] - 1]].tobytes()
        return data[:-1] if data.endswith(b"\n") else data


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    cells = hashes.select(F.col("hash").bitwiseAND((1 << bits) - 1).alias("cell")).distinct()
    found = np.zeros(1 << bits, bool)
    for batch in cells.toArrow().to_batches():  # at most 2 ** bits cells
        found[np.asarray(batch.column(0))] = True
    return found


def line_dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", long_lines: bool = False) -> DataFrame:
    """``documents`` with repeated chunks taken out of ``text``, and ``n_lines`` and ``n_removed`` of each row.

    All rows stay, with their other columns; null texts stay null, texts without a repeated chunk stay as they are, and
    a text of which nothing is left is empty. Rows that share id and text count as one document. A repeated chunk
    that only rows without an id hold stays in all of them; otherwise such rows lose it. Single lines are no chunks;
    with ``long_lines`` those of 50 words or more go likewise.
    """
    source = documents.drop("n_lines", "n_removed")
    row, chunks = free_name(source, "_row"), free_name(source, "_chunks")
    source = source.withColumn(row, F.xxhash64(key, text))
    kind = source.schema[key].dataType.simpleString()

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = Chunks(batch.column(0), long_lines)
        return pa.RecordBatch.from_arrays([pa.array(signed(c.unit_hash))], names=["hash"])

    counted = map_runs(source.select(text), text, "hash long", hashes).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spark = documents.sparkSession
    marks = spark.sparkContext.broadcast(_bitmap(counted, BITMAP_BITS))

    def repeated(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = Chunks(batch.column(2), long_lines)
        at = np.flatnonzero(marks.value[c.unit_hash & np.uint64((1 << BITMAP_BITS) - 1)])
        rows = pa.array(c.unit_row[at])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(c.unit_number[at].astype(np.int32)), pa.array(signed(c.unit_hash[at])), pa.array([c.unit(i) for i in at.tolist()], pa.binary())],
            names=["key", "row", "number", "hash", "bytes"],
        )

    found = map_runs(source.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(text).alias("text")), "text", f"key {kind}, row long, number int, hash long, bytes binary", repeated)
    found = saved(found)
    # Grouping on the bytes is the comparison; equal chunks meet in one row per task before they move.
    texts = found.groupBy("hash", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("home"))
    homes = texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.max("home").alias("home"))
    homes = homes.where("texts = 1 and n > 1").select("hash", "home")  # different chunks of one hash all stay
    # Of rows with one id and different texts one is the home; rows without an id are all alike.
    own = F.col("key").eqNullSafe(F.col("home.key")) & (F.col("key").isNull() | (F.col("row") == F.col("home.row")))
    lists = (
        found.drop("bytes").join(homes, "hash").groupBy(F.col("row").alias(row))
        .agg(F.array_sort(F.collect_set(F.struct("number", "hash", own.alias("own")))).alias(chunks))
    )

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        at, chunks_at = names.index(text), names.index(chunks)
        c = Chunks(batch.column(at))
        first_chunk = np.searchsorted(c.chunk_first, c.first)
        new, removed = batch.column(at).to_pylist(), np.zeros(batch.num_rows, np.int64)
        for i, listed in enumerate(batch.column(chunks_at).to_pylist()):
            gone, seen = set(), set()  # lines of the run
            for item in listed or ():
                if item["own"] and item["hash"] not in seen:
                    seen.add(item["hash"])
                elif item["number"] >= LINE:
                    gone.add(int(c.first[i]) + item["number"] - LINE)
                else:
                    chunk = int(first_chunk[i]) + item["number"]
                    gone.update(range(c.chunk_first[chunk], c.chunk_end[chunk]))
            if gone:
                new[i] = b"\n".join(c.line(k) for k in range(c.first[i], c.first[i + 1]) if k not in gone).decode("utf-8", "replace")
                removed[i] = len(gone)
        columns = [pa.array(new, pa.string()) if n == text else col for n, col in zip(names, batch.columns) if n != chunks]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(c.first)), pa.array(removed)], names=[*(n for n in names if n != chunks), "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", n_lines long, n_removed long"
    return map_runs(source.join(lists, row, "left").select(*source.columns, chunks), text, schema, rewrite).drop(row)
