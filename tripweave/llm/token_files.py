"""Token counts from flat token files: a scan for end-of-document ids, stitched across blocks by a prefix scan.

A flat file is nothing but token ids of one width, each document ended by one separator id; there is no index.
``write_token_files`` makes such files; ``scan_token_files`` reads any. The scan splits files into blocks, finds the
separators of a block in one vectorised comparison, and needs only each block's first and last separator to put
together the documents that cross a border: a running count gives the document's number in the file, a running
maximum the separator before.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tripweave.llm.common import runs, saved
from tripweave.runtime import shared_folder

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256  # the id that the vocabulary leaves free for ends of documents
WIDTH = 2  # bytes of an id
BLOCK_TOKENS = 1 << 20

# Fixed value: the public pattern that splits texts before byte pairs of this vocabulary are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def _encoder(ranks: bytes):
    """The tokenizer, once per Python process."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_token_files(documents: DataFrame, folder: str, key: str = "doc_id", text: str = "text", ranks: str = RANKS, separator: int = SEPARATOR) -> DataFrame:
    """Write one flat file per task under ``folder``; returns ``key, path, number``: where each row's tokens went.

    Null texts are written as empty documents. A task that is run again writes a new file; rows name the files of
    finished attempts only, and files that no row names are not read.
    """
    spark = documents.sparkSession
    with open(ranks, "rb") as f:  # read by the driver and sent on: less than a megabyte
        sent = spark.sparkContext.broadcast(f.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, number, sink = f"{folder}/{uuid.uuid4().hex}.bin", 0, None
        for batch in batches:
            if sink is None:
                system, place = _open(path)
                system.create_dir(place.rpartition("/")[0])
                sink = system.open_output_stream(place)
            encoder = _encoder(sent.value)
            for start, stop in runs(batch.column(1)):
                ids: list[np.ndarray] = []
                for value in batch.column(1).slice(start, stop - start).to_pylist():
                    ids += [encoder.encode_to_numpy(value or "", disallowed_special=()), np.array([separator])]
                sink.write(np.concatenate(ids).astype(f"<u{WIDTH}").tobytes())
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([path] * rows), pa.array(np.arange(number, number + rows))], names=["key", "path", "number"])
            number += rows
        if sink is not None:
            sink.close()

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(task, f"key {kind}, path string, number long")


def scan_token_files(files: DataFrame, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK_TOKENS) -> DataFrame:
    """``path, number, n_tokens`` of every document in the flat files of ``files.path``; separators are not counted.

    Tokens behind a file's last separator are a document of their own. Empty files, and no files, give no rows; paths
    that repeat are scanned once; a null path is skipped. Other columns of ``files`` are not read.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            sizes = [system.get_file_info(place).size // width for system, place in map(_open, paths)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "tokens"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = _open(path)
                with system.open_input_file(place) as source:
                    ids = np.frombuffer(source.read_at(min(block, tokens - start) * width, start * width), f"<u{width}")
                ends = np.flatnonzero(ids == separator) + start
                rest = start + len(ids) if start + len(ids) == tokens else None
                row = {
                    "path": path, "start": start, "ends": len(ends), "first": int(ends[0]) if len(ends) else None, "last": int(ends[-1]) if len(ends) else None,
                    "lengths": np.diff(ends) - 1, "file_end": rest,
                }
                yield pa.RecordBatch.from_pylist([row], schema=found)

    found = pa.schema([("path", pa.string()), ("start", pa.int64()), ("ends", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("lengths", pa.list_(pa.int64())), ("file_end", pa.int64())])
    sizes = files.where("path is not null").select("path").distinct().mapInArrow(measure, "path string, tokens long")
    blocks = sizes.where("tokens > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block).cast("long"))).alias("start"), "tokens")
    marks = blocks.repartition("path", "start").mapInArrow(search, "path string, start long, ends long, first long, last long, lengths array<long>, file_end long")
    before = W.Window.partitionBy("path").orderBy("start").rowsBetween(W.Window.unboundedPreceding, -1)  # one short row a block
    stitched = (
        saved(marks)
        .withColumn("done", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)))
    )
    crossing = F.array(F.struct(F.col("done").alias("number"), (F.col("first") - F.col("open") - 1).alias("n_tokens")))
    inner = F.transform("lengths", lambda n, i: F.struct((F.col("done") + i + 1).alias("number"), n.alias("n_tokens")))
    tail = F.col("file_end") - F.coalesce("last", "open") - 1
    unended = F.array(F.struct((F.col("done") + F.col("ends")).alias("number"), tail.alias("n_tokens")))
    none = F.array().cast("array<struct<number:bigint,n_tokens:bigint>>")
    all_rows = F.concat(
        F.when(F.col("ends") > 0, F.concat(crossing, inner)).otherwise(none), F.when(tail > 0, unended).otherwise(none)
    )
    return stitched.select("path", F.explode(all_rows).alias("d")).select("path", "d.number", "d.n_tokens")


def token_counts(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens``: tokenise into flat files in the shared folder, scan them, and name the documents again.

    Every row of ``documents`` gives one row, repeated ones too; null and empty texts have no tokens.
    """
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    places = saved(write_token_files(documents, folder, key, text))
    return places.join(scan_token_files(places), ["path", "number"]).select(F.col("key").alias("doc_id"), "n_tokens")
