"""A corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, tokens. Part of ``tripweave.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm.common import free_name, saved, table
from tripweave.llm.decontaminate import decontaminate
from tripweave.llm.language import held_out
from tripweave.llm.line_dedup import line_dedup
from tripweave.llm.pieces import MARK, encode_decode
from tripweave.llm.quality import LEAST_SCORE, fit_on, score
from tripweave.llm.shingle_join import one_of_each


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on the labels that op6 learns from."""
    model = fit_on(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)), metadata="n_chars")
    name = free_name(docs, "_score")
    return score(docs, model, metadata="n_chars", name=name).where(F.col(name) >= LEAST_SCORE).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines taken out; documents go only if nothing but white space is left of them by that."""
    changed = F.col("n_removed") > 0
    kept = line_dedup(docs).where(~changed | F.regexp_like("text", F.lit(r"\S")))
    size = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that Jaccard links connect."""
    return one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    row = free_name(docs, "_row")
    named = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    bad = decontaminate(named, table(spark, sf_dir, "benchmark"), doc_id=row).where("contaminated").select(F.col("doc_id").alias(row))
    return named.join(saved(bad), row, "left_anti").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether these decode to the text."""
    round_trip = F.col("decoded").eqNullSafe(F.translate("text", MARK, " "))
    return encode_decode(docs).withColumn("round_trip", round_trip).drop("decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

# A factorisation machine and content-defined chunks have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
