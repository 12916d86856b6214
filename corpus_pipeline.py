"""The corpus pipeline: quality, language, near copies, packing; each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.llm import language, near_dedup, packing, quality
from backuplake.llm.queries import WORDS, tokenizer
from backuplake.session import pin
from backuplake.sources.bindings import read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted good; learned from all labels."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), F.lit(True))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return language.keep_known(docs, F.lit(True))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return near_dedup.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the kept documents lies in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer(WORDS), end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Classifiers and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
