"""Replica distribution with failover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.operators.aggregates import placement_outcome
from backuplake.operators.joins import failover_nodes, replicas


def locations(chunks: DataFrame, label: str, ring: DataFrame, failures: DataFrame, factor: int = 3) -> DataFrame:
    """Where each replica ended up.

    `failures` lists the uploads (chunk_id, node_id) that did not succeed. A failed upload is
    tried once on the next node; if that fails too it is recorded as FAILED on the first node,
    and if there is no next node it is left out.
    """
    failed = failures.select("chunk_id", "node_id").distinct()
    placed = replicas(chunks, label, ring, factor).select("chunk_id", "replica", "node_id")
    first = placed.join(failed.withColumn("_failed", F.lit(True)), ["chunk_id", "node_id"], "left")
    retry = first.join(failover_nodes(ring), "node_id", "left")
    again = failed.select("chunk_id", F.col("node_id").alias("next_node_id"), F.lit(True).alias("_failed_again"))
    tried = retry.join(again, ["chunk_id", "next_node_id"], "left")
    moved = F.col("_failed") & F.col("_failed_again").isNull()
    return tried.filter(F.col("_failed").isNull() | F.col("next_node_id").isNotNull()).select(
        "chunk_id",
        "replica",
        F.when(moved, F.col("next_node_id")).otherwise(F.col("node_id")).alias("node_id"),
        F.when(F.col("_failed") & F.col("_failed_again"), "FAILED").otherwise("UPLOADED").alias("status"),
    )


def distribute(chunks: DataFrame, label: str, ring: DataFrame, failures: DataFrame, factor: int = 3) -> DataFrame:
    """Outcome per chunk; a chunk without any location has failed."""
    outcome = placement_outcome(locations(chunks, label, ring, failures, factor), factor)
    return chunks.select("chunk_id").join(outcome, "chunk_id", "left").select(
        "chunk_id",
        F.coalesce("uploaded", F.lit(0)).alias("uploaded"),
        F.coalesce("outcome", F.lit("FAILED")).alias("outcome"),
    )
