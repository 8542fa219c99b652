"""The registered query of each text operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripweave.llm.collocations import collocations
from tripweave.llm.common import table
from tripweave.llm.decontaminate import decontaminate
from tripweave.llm import pieces, secrets
from tripweave.llm.language import language_id
from tripweave.llm.line_dedup import line_dedup
from tripweave.llm.near_vectors import near_vectors
from tripweave.llm.page_text import extract
from tripweave.llm.quality import quality
from tripweave.llm.ranked_search import ranked_search
from tripweave.llm.robust_rules import robust_rules
from tripweave.llm.shingle_join import jaccard_components
from tripweave.llm.token_files import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), long_lines=True).select("doc_id", "n_lines", "n_removed", "text")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_rules(table(spark, sf_dir, "documents")).drop("distance")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts, op2_decontamination, op3_language_id, op4_jaccard_join, op5_near_vectors, op6_quality, op7_secrets, op8_sentencepiece, op9_line_dedup, op10_page_text,
        op11_collocations, op12_robust_rules, op13_ranked_search,
    )
    return {f.__name__: f for f in every}
