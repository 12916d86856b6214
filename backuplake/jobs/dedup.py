"""Chunk deduplication, reference counting and compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_index(chunks: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per digest: where it was first seen, its references and what sharing saves.

    Partial aggregation folds a hot digest on the map side, so a chunk of zeros costs one row
    per task. `chunks`: digest, length, and the `order` columns that say what came first.
    """
    return (
        chunks.groupBy("digest")
        .agg(
            F.min(F.struct(*order)).alias("_first"),
            F.count(F.lit(1)).alias("ref_count"),
            F.max("length").alias("length"),
        )
        .select(
            "digest",
            *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order],
            "ref_count",
            "length",
            ((F.col("ref_count") - 1) * F.col("length")).alias("saved_bytes"),
        )
    )


def chunk_store(chunks: DataFrame) -> DataFrame:
    """One copy of the data per digest."""
    return chunks.groupBy("digest").agg(F.first("data").alias("data"), F.max("length").alias("length"))


def compact(store: DataFrame, references: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Kept and dropped chunks: those whose references sum to zero or that have none go."""
    live = references.groupBy(key).agg(F.sum("delta").alias("_refs")).filter("_refs > 0").select(key)
    return store.join(live, key, "left_semi"), store.join(live, key, "left_anti")
