"""Explicit schemas of the domain tables, as DDL text; nothing is inferred. All timestamps are UTC."""

from __future__ import annotations


def column_names(ddl: str) -> list[str]:
    """Names of a flat schema's columns."""
    return [part.split()[0] for part in ddl.split(",")]


# Field names and types of the records on the wire.
# Flat JSON payload of the streaming job, before casting.
RAW_EVENT_FIELDS = ["eventTime", "tenantId", "backupType", "size", "duration", "file_count"]

STARTED = "struct<backup_id:string, backup_type:string>"
COMPLETED = (
    "struct<backup_id:string, final_size_bytes:bigint, duration_seconds:bigint, file_count:int,"
    " deduplication_ratio:double, compression_ratio:double>"
)
FAILED = "struct<backup_id:string, error_code:string, error_message:string>"

BACKUP_EVENT = (
    "event_id string, timestamp timestamp, device_id string, tenant_id string, user_id string,"
    f" started {STARTED}, completed {COMPLETED}, failed {FAILED}"
)
DEVICE_KEYS = (
    "keyId string, deviceId string, algorithm string, keyDerivation string, iterations int,"
    " createdAt bigint, isActive boolean"
)
BACKUP_TRAINING = (
    "file_count int, total_size bigint, device_cpu double, device_memory double, network_speed double,"
    " backup_duration double"
)
