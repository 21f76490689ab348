"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quiltomics.llm.chat import repair
from quiltomics.llm.common import table
from quiltomics.llm.decontam import contaminated
from quiltomics.llm.language import language_digest
from quiltomics.llm.minhash import near_duplicates
from quiltomics.llm.packing import packing_digest
from quiltomics.llm.phrases import ORACLE as PHRASE_ORACLE
from quiltomics.llm.phrases import collocations
from quiltomics.llm.quality import quality_digest
from quiltomics.llm.search import ORACLE as SEARCH_ORACLE
from quiltomics.llm.search import search_digest
from quiltomics.llm.sharding import shard_digest
from quiltomics.llm.spelling import spelling_variants
from quiltomics.llm.tokens import section_tokens
from quiltomics.llm.toxicity import toxicity_digest
from quiltomics.llm.urls import filter_urls


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return section_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_digest(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_digest(table(spark, folder, "documents"))


def op5_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    return search_digest(table(spark, folder, "embeddings"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return repair(table(spark, folder, "conversations"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_digest(table(spark, folder, "documents"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_maxscore": op5_maxscore,
    "op6_decontamination": op6_decontamination,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_quality": op8_quality,
    "op9_chat_format": op9_chat_format,
    "op10_language_id": op10_language_id,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_url_filter": op12_url_filter,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op5_maxscore": SEARCH_ORACLE, "op11_phrase_collocations": PHRASE_ORACLE}
