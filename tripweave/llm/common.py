"""Helpers the text operators share: table access, byte-level words and their hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tripweave.runtime import checkpoint

# Text is handled in runs of about this many bytes, so that arrays stay small whatever the batch holds.
RUN_BYTES = 1 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

# Words of the benchmark contract: digits, lower-case letters and everything outside ASCII.
ALNUM_BYTES = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
# Words of the shingle contract: everything but blank, tab, line feed, vertical tab, form feed and return.
NONSPACE_BYTES = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


# Rows that the JVM and Python hand each other at a time, where the session does not say: texts may be long.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that no later job computes it again or loses it with an executor."""
    return checkpoint(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` whose bytes add up to about ``size``; a longer text is a range of its own."""
    lengths = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start, done = 0, 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one array, and where each text starts; nulls are empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over all bytes."""
    power, inverse = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * power[:-1], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + lengths)


class Words:
    """The words of a run of texts: lower-cased bytes, word spans, and the first word of each text."""

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray) -> None:
        raw, self.text_starts = flat_bytes(texts)
        self.data = _LOWER[raw]
        inside = word_bytes[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.text_starts] = True
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        self.starts = np.flatnonzero(after & (~before | cut))
        self.ends = np.flatnonzero(before & (~after | cut))
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.first)
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def string(self, start: int, stop: int) -> str:
        """Words ``start`` to ``stop`` (exclusive) joined by blanks."""
        data = self.data
        return b" ".join(
            data[a:b].tobytes() for a, b in zip(self.starts[start:stop].tolist(), self.ends[start:stop].tolist())
        ).decode("utf-8", "replace")

    def shingles(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the last ones run over a text's end, see ``whole``."""
        return shingle_hashes(self.hashes, size)

    def whole(self, size: int) -> np.ndarray:
        """Which words have ``size`` words from them on in the same text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return left >= size


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(words), np.uint64)
    factor = 1
    for i in range(min(size, len(words))):
        total[: len(words) - i] += words[i:] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def map_runs(
    df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], size: int = RUN_BYTES
) -> DataFrame:
    """Apply ``work`` to record batches of about ``size`` bytes of the column ``text``."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column(batch.schema.get_field_index(text)), size):
                made = work(batch.slice(start, stop - start))
                if made is not None:
                    yield made

    return df.mapInArrow(task, schema)
