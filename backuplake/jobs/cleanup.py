"""Age-based clean-up. Every step returns what stays and what goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.operators.joins import unique_keys

FINISHED = ["COMPLETED", "FAILED"]


def cutoff(as_of: Column, days: int = 30) -> Column:
    return as_of - F.make_interval(days=F.lit(days))


def _split(df: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    test = F.coalesce(gone, F.lit(False))
    return df.filter(~test), df.filter(test)


def expired_files(files: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Soft-deleted files older than the cut go; exactly `days` old stays."""
    return _split(files, F.col("is_deleted") & (F.col("backup_time") < cutoff(as_of, days)))


def finished_jobs(jobs: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Completed and failed jobs by end time, else start time."""
    at = F.coalesce("end_time", "start_time")
    return _split(jobs, F.col("status").isin(FINISHED) & (at < cutoff(as_of, days)))


def orphaned_chunks(
    chunks: DataFrame, kept_files: DataFrame, as_of: Column, days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """Old chunks no live file refers to. `kept_files` (after the purge): chunk_id, is_deleted."""
    live = unique_keys(kept_files.filter(~F.col("is_deleted")), "chunk_id").withColumn("_live", F.lit(True))
    flagged = chunks.join(live, "chunk_id", "left")
    kept, gone = _split(flagged, F.col("_live").isNull() & (F.col("created_at") < cutoff(as_of, days)))
    return kept.drop("_live"), gone.drop("_live")
