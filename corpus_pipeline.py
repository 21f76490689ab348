"""Corpus pipeline: language, quality, near-duplicates, benchmark leaks, packing.

Every stage takes the documents its predecessor kept and returns the columns of ``documents``; the last
returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltomics.llm.common import free_name, table
from quiltomics.llm.decontam import decontaminate
from quiltomics.llm.language import fit_languages, identify
from quiltomics.llm.minhash import deduplicated
from quiltomics.llm.packing import packing_digest
from quiltomics.llm.quality import THRESHOLD, fit_quality, score_quality
from quiltomics.session import settled, ship_package

#: A text that scores less is rejected, as is one without a letter. One whose 3-grams the learned languages
#: do not know scores 0; with up to two families of two languages every other text scores 0.25 or more.
LANGUAGE_SCORE = 0.2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    ship_package(spark)
    language, certainty = free_name(docs, "_language"), free_name(docs, "_certainty")
    found = identify(docs, fit_languages(docs), (language, certainty))
    kept = found.where((F.col(language) != "und") & (F.col(certainty) >= LANGUAGE_SCORE))
    return kept.drop(language, certainty)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality."""
    ship_package(spark)
    quality = free_name(docs, "_quality")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), quality)
    return scored.where(F.col(quality) >= THRESHOLD).drop(quality)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    ship_package(spark)
    return deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    ship_package(spark)
    return packing_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("minhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned and iterative stages have no SQL form; tests check them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage keeps is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
