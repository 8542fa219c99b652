"""Quality of texts by a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of two short vectors; with the identity
``2 * sum_{i<j} <v_i, v_j> x_i x_j = sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)`` a text is scored in time linear in its features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import NONSPACE_BYTES, Words, flat_bytes, free_name, map_runs
from tripweave.llm.language import held_out

SAMPLE_ROWS = 12_000  # labelled rows that the model is fitted on: a bounded sample of the smallest hashes
WORD_BITS = 16
FACTORS = 6
BINS = 24
EPOCHS = 6
LEAST_SCORE = 0.3
_BYTES = np.arange(256)
_KINDS = {
    "upper": (_BYTES >= 0x41) & (_BYTES <= 0x5A), "digit": (_BYTES >= 0x30) & (_BYTES <= 0x39), "line": _BYTES == 0x0A,
    "stop": np.isin(_BYTES, list(b".,;:?'\"-()")), "symbol": np.isin(_BYTES, list(b"!#$%&*+/<=>@[\\]^_`{|}~")), "wide": _BYTES >= 0x80,
}
STATISTICS = (*_KINDS, "length", "word_length", "repeats", "distinct", "single", "longest", "metadata")
WIDTH = (1 << WORD_BITS) + len(STATISTICS) * BINS


@dataclass
class Features:
    """Features of a run of texts in one list: text ``i`` has those from ``first[i]`` to ``first[i + 1]``."""

    ids: np.ndarray
    values: np.ndarray
    first: np.ndarray


def features(texts: pa.Array, metadata: np.ndarray) -> Features:
    """Words hashed to cells, with values of length 1 a text in all, and one bin for each statistic. ``metadata`` is a bin number."""
    rows = len(texts)
    words = Words(texts, NONSPACE_BYTES)
    raw, starts = flat_bytes(texts)
    lengths, counts = np.diff(starts), words.counts
    own = np.repeat(np.arange(rows), counts)
    cells, times = np.unique(own.astype(np.uint64) << np.uint64(32) | words.hashes & np.uint64((1 << WORD_BITS) - 1), return_counts=True)
    at = (cells >> np.uint64(32)).astype(np.int64)
    weight = np.log1p(times)
    norm = np.sqrt(np.bincount(at, weight**2, rows))
    weight = weight / norm[at]

    running = {k: np.concatenate([[0], np.cumsum(mark[raw])]) for k, mark in _KINDS.items()}
    share = lambda n, of: n / np.maximum(of, 1)
    sizes = words.ends - words.starts
    same = np.concatenate([[False], (words.hashes[1:] == words.hashes[:-1]) & (own[1:] == own[:-1])]) if len(own) else np.zeros(0, bool)
    by_row = lambda x: np.bincount(own, x, rows)
    longest = np.zeros(rows)
    np.maximum.at(longest, own, sizes)
    scaled = [share(running[k][starts[1:]] - running[k][starts[:-1]], lengths) ** 0.5 for k in _KINDS]
    scaled += [np.log2(lengths + 1) / 20, share(by_row(sizes), counts) / 24, share(by_row(same), counts) ** 0.5, share(np.bincount(at, minlength=rows), counts), share(by_row(sizes == 1), counts) ** 0.5, np.log2(longest + 1) / 12]
    bins = [np.clip((s * BINS).astype(np.int64), 0, BINS - 1) for s in scaled] + [np.clip(metadata, 0, BINS - 1)]
    stat_ids = np.stack([(1 << WORD_BITS) + i * BINS + b for i, b in enumerate(bins)], 1)

    ids = np.concatenate([(cells & np.uint64(0xFFFFFFFF)).astype(np.int64), stat_ids.ravel()])
    values = np.concatenate([weight, np.full(stat_ids.size, 1 / len(STATISTICS) ** 0.5)])
    of = np.concatenate([at, np.repeat(np.arange(rows), len(STATISTICS))])
    order = np.argsort(of, kind="stable")
    return Features(ids[order], values[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x)[0], -30, 30)))

    def margins(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each text and the sums of its weighted factors; every text has features, as statistics always are."""
        if len(x.first) == 1:
            return np.zeros(0), np.zeros((0, self.factors.shape[1]))
        weighted = self.factors[x.ids] * x.values[:, None]
        sums = np.add.reduceat(weighted, x.first[:-1], axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(weighted**2, x.first[:-1], axis=0)).sum(1)
        return self.bias + np.add.reduceat(self.linear[x.ids] * x.values, x.first[:-1]) + pairs, sums


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5, epochs: int = EPOCHS, rate: float = 0.15, keep: float = 1e-5) -> Machine:
    """Fit by adaptive gradient steps on the logistic loss; rows are ``ids, values, label``. Without both labels the score is constant."""
    labels = np.array([r[2] for r in rows], float)
    share = (labels.sum() + 1) / (len(labels) + 2)
    dice = np.random.default_rng(seed)
    model = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH), dice.normal(0, 0.05, (WIDTH, FACTORS)))
    if len(set(labels)) < 2:
        return model
    seen_linear, seen_factors, seen_bias = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = dice.permutation(len(rows))
        for batch in np.split(order, range(64, len(order), 64)):
            sizes = np.array([len(rows[i][0]) for i in batch])
            x = Features(np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch]), np.concatenate([[0], np.cumsum(sizes)]))
            margin, sums = model.margins(x)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) / len(batch)
            each = np.repeat(error, sizes) * x.values
            used, where = np.unique(x.ids, return_inverse=True)
            linear = np.bincount(where, each, len(used)) + keep * model.linear[used]
            weighted = model.factors[x.ids]
            slope = each[:, None] * (np.repeat(sums, sizes, 0) - weighted * x.values[:, None])
            factors = np.stack([np.bincount(where, slope[:, f], len(used)) for f in range(FACTORS)], 1) + keep * model.factors[used]
            seen_linear[used] += linear**2
            seen_factors[used] += factors**2
            seen_bias += error.sum() ** 2
            model.linear[used] -= rate * linear / np.sqrt(seen_linear[used])
            model.factors[used] -= 0.3 * rate * factors / np.sqrt(seen_factors[used])
            model.bias -= rate * error.sum() / np.sqrt(seen_bias)
    return model


def _bin(column: str | None) -> F.Column:
    """Bin of a numeric metadata column: its binary magnitude, null a bin of its own."""
    if column is None:
        return F.lit(0)
    value = F.col(column).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(BINS - 1)).otherwise(F.least(F.log2(F.greatest(value, F.lit(0.0)) + 1), F.lit(BINS - 2.0))).cast("int")


def fit_on(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", metadata: str | None = None, most: int = SAMPLE_ROWS) -> Machine:
    """Fit on up to ``most`` rows of ``labels`` joined to their documents; null labels are not used."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), _bin(metadata).alias("bin")).join(F.broadcast(chosen), "key")  # at most `most` short rows
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("values", pa.list_(pa.float32())), ("label", pa.int32()), ("hash", pa.int64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0), np.asarray(batch.column(1)))
        offsets = pa.array(x.first.astype(np.int32))
        columns = [pa.ListArray.from_arrays(offsets, pa.array(x.ids.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x.values.astype(np.float32))), batch.column(2), batch.column(3)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    # Of rows that share a key the fit gets the one with the least text, so that its rows stay bounded.
    rows = rows.groupBy("key").agg(F.min(F.struct("text", "bin", "label")).alias("r")).select("r.*", F.xxhash64("key").alias("hash"))
    found = map_runs(rows, "text", "ids array<int>, values array<float>, label int, hash long", work).toArrow().sort_by("hash")
    return fit([(np.asarray(i.values), np.asarray(v.values, dtype=float), l) for i, v, l in zip(found["ids"], found["values"], found["label"].to_pylist())])


def score(documents: DataFrame, model: Machine, text: str = "text", metadata: str | None = None, name: str = "score") -> DataFrame:
    """``documents`` with a column ``name``, the chance of label 1; null texts are scored like empty ones.

    All rows and columns stay, repeated ones too; an older column of that name is replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))
    kept = documents.drop(name)
    bin_name = free_name(documents, "_metadata_bin")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(bin_name)
        x = features(batch.column(batch.schema.get_field_index(text)), np.asarray(batch.column(at)))
        made = pa.array(Machine(*sent.value).scores(x).astype(float))
        rest = [c for i, c in enumerate(batch.columns) if i != at]
        return pa.RecordBatch.from_arrays([*rest, made], names=[*(n for n in batch.schema.names if n != bin_name), name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{name}` double"
    return map_runs(kept.withColumn(bin_name, _bin(metadata)), text, schema, work)


def quality(documents: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, least: float = LEAST_SCORE) -> DataFrame:
    """``doc_id, held_out, score, predicted``: fit on labels not held out, then score every row."""
    model = fit_on(documents, labels.where(~held_out("doc_id", parts, part)), metadata="n_chars")
    scored = score(documents.select("doc_id", "text", "n_chars"), model, metadata="n_chars")
    return scored.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
