"""Row-wise reshaping and keyed partial updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake import schemas
from backuplake.operators.joins import unique_keys


def parse_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Six fields out of JSON text, typed without raising on bad input.

    Both spellings of the event field names are accepted.
    """
    alternates = {"eventTime": "timestamp", "tenantId": "tenant_id", "backupType": "backup_type"}
    names = schemas.RAW_EVENT_FIELDS + list(alternates.values())
    fields = df.select(F.json_tuple(F.col(value).cast("string"), *names).alias(*[f"_{n}" for n in names]))

    def pick(name: str) -> Column:
        return F.coalesce(f"_{name}", f"_{alternates[name]}") if name in alternates else F.col(f"_{name}")

    return fields.select(
        F.try_to_timestamp(pick("eventTime")).alias("timestamp"),
        pick("tenantId").alias("tenant_id"),
        pick("backupType").alias("backup_type"),
        pick("size").try_cast("double").alias("size"),
        pick("duration").try_cast("double").alias("duration"),
        pick("file_count").try_cast("bigint").alias("file_count"),
    )


def flatten_events(events: DataFrame) -> DataFrame:
    """The payload union as one wide row with `event_kind`."""
    kind = (
        F.when(F.col("started").isNotNull(), "started")
        .when(F.col("completed").isNotNull(), "completed")
        .when(F.col("failed").isNotNull(), "failed")
    )
    return events.select(
        "event_id",
        "timestamp",
        "device_id",
        "tenant_id",
        kind.alias("event_kind"),
        F.coalesce("started.backup_id", "completed.backup_id", "failed.backup_id").alias("backup_id"),
        F.col("started.backup_type").alias("backup_type"),
        F.col("completed.final_size_bytes").alias("final_size_bytes"),
        F.col("completed.duration_seconds").alias("duration_seconds"),
        F.col("completed.file_count").alias("file_count"),
        F.col("completed.deduplication_ratio").alias("deduplication_ratio"),
        F.col("completed.compression_ratio").alias("compression_ratio"),
        F.col("failed.error_code").alias("error_code"),
        F.col("failed.error_message").alias("error_message"),
    )


def job_response(jobs: DataFrame) -> DataFrame:
    """Public view of a job row."""
    return jobs.select(
        "job_id",
        "device_id",
        "status",
        "progress",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        "estimated_duration",
    )


def key_info(keys: DataFrame) -> DataFrame:
    """Public view of a key row: no secrets, creation time as ISO text."""
    return keys.select(
        "key_id",
        "device_id",
        "algorithm",
        "key_derivation",
        F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
        "is_active",
    )


def anomaly_detail(df: DataFrame, size: str, ratio: str, duration: str, errors: str) -> DataFrame:
    """Adds the detail record of an anomaly result; missing numbers read as zero."""
    return df.withColumn(
        "details",
        F.struct(
            F.coalesce(size, F.lit(0)).alias("backup_size"),
            F.coalesce(ratio, F.lit(0)).alias("compression_ratio"),
            F.coalesce(duration, F.lit(0)).alias("duration"),
            F.coalesce(errors, F.lit(0)).alias("error_count"),
        ),
    )


def apply_updates(old: DataFrame, updates: DataFrame, key: str, stamp: dict[str, Column] | None = None) -> DataFrame:
    """Overlays non-null update fields on existing rows; updates without a row are dropped.

    `updates` has at most one row per key. `stamp` sets columns on the touched rows.
    """
    fields = [c for c in updates.columns if c != key]
    new = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = old.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields})
    if stamp:
        out = out.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in stamp.items()})
    return out.select(*old.columns)


def soft_delete(files: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks listed files as deleted and keeps their records."""
    marks = unique_keys(deletes, *keys).withColumn("_hit", F.lit(True))
    return (
        files.join(marks, list(keys), "left")
        .withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_hit", F.lit(False)))
        .select(*files.columns)
    )
