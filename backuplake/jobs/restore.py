"""Synthetic full backups, restores and integrity audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.functions.features import digest
from backuplake.jobs.chunking import reassemble
from backuplake.operators.aggregates import synthetic_ratios
from backuplake.operators.asof import latest_before
from backuplake.operators.joins import file_chunks, restore_plan
from backuplake.operators.windows import latest_state
from backuplake.session import pin


def synthetic_manifest(base: DataFrame, incrementals: DataFrame, by: Sequence[str]) -> DataFrame:
    """The newest live state of every path: one union, one aggregation, whatever the chain length."""
    return latest_state(base, incrementals, ["path"], by)


def synthetic_full(
    base: DataFrame, incrementals: DataFrame, chunks: DataFrame, by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Manifest and ratios of a synthetic full backup. The manifest is the product and is
    written once; the ratios are taken from what was written.

    Inputs: path, chunks (array of ids), size, is_deleted and the `by` columns.
    `chunks`: chunk_id, chunk_size, packed_size.
    """
    manifest = pin(synthetic_manifest(base, incrementals, by), "manifest")
    stored = file_chunks(manifest, chunks).select(
        F.col("chunk_id").alias("digest"), F.col("chunk_size").alias("size"), "packed_size"
    )
    return manifest, synthetic_ratios(stored, base.unionByName(incrementals).select("size"))


def restore(
    requests: DataFrame, manifest: DataFrame, store: DataFrame, existing: DataFrame, overwrite: bool = False
) -> DataFrame:
    """Restored files with their verdict.

    `requests`: restore_id, backup_id, files. `manifest`: backup_id, path, chunks, checksum.
    `store`: chunk_id, data. `existing`: paths already at the target; unless `overwrite` is set,
    they are taken out before any chunk is read and carry no data.
    """
    keys = ["restore_id", "backup_id", "path"]
    open_files = manifest.select("backup_id", "path", "chunks")
    if not overwrite:
        open_files = open_files.join(existing.select("path"), "path", "left_anti")
    plan = restore_plan(requests, open_files, store)
    files = reassemble(plan.select(*keys, "pos", "data"), keys)
    wanted = requests.select("restore_id", "backup_id", F.explode("files").alias("path"))
    listed = wanted.join(manifest.select("backup_id", "path", "checksum"), ["backup_id", "path"], "left")
    present = existing.select("path").distinct().withColumn("_exists", F.lit(True))
    joined = listed.join(files, keys, "left").join(present, "path", "left")
    status = F.when(F.col("checksum").isNull(), "NOT_IN_BACKUP")
    if not overwrite:
        status = status.when(F.col("_exists"), "SKIPPED_EXISTS")
    status = status.when(digest(F.coalesce("data", F.lit(b""))) == F.col("checksum"), "RESTORED").otherwise("CORRUPT")
    return joined.withColumn("status", status).select(*keys, "data", "status")


def versions_at(requests: DataFrame, snapshots: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """Each request with the version it restores, at a time of its own: snapshot_id, checksum and `status`.

    `snapshots`: the keys, ts, snapshot_id, checksum, is_deleted. The newest version up to the request's time counts
    (of versions of one time the one with the greatest id, checksum, deletion); RESTORABLE, DELETED if it is a deletion,
    NOT_YET if there is none. Any number of times per file, in one pass.
    """
    rows = snapshots.withColumn("_tie", F.struct("snapshot_id", "checksum", "is_deleted"))
    found = latest_before(requests, rows, keys, at, "ts", "_tie", ["snapshot_id", "checksum", "is_deleted"])
    status = F.when(F.col("snapshot_id").isNull(), "NOT_YET").when(F.coalesce("is_deleted", F.lit(False)), "DELETED").otherwise("RESTORABLE")
    live = [F.when(F.col("status") == "RESTORABLE", F.col(c)).alias(c) for c in ("snapshot_id", "checksum")]
    return found.withColumn("status", status).select(*requests.columns, *live, "status")


def audit(rows: DataFrame, checksum: str = "checksum", data: str = "data") -> DataFrame:
    """Adds `is_corrupt`: the stored digest does not match the data."""
    return rows.withColumn("is_corrupt", ~digest(F.col(data)).eqNullSafe(F.col(checksum)))
