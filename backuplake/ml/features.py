"""Feature frames, scaling and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.functions.features import cyclical_features, time_features

# Feature names in order, with the default of each where one is given.
BACKUP_FEATURES = {
    "file_count": 100.0,
    "total_size": 1_000_000.0,
    "device_cpu": 50.0,
    "device_memory": 70.0,
    "network_speed": 100.0,
}
HEALTH_FEATURES = {
    "cpu_usage": 50.0,
    "memory_usage": 60.0,
    "disk_io": 100.0,
    "network_io": 50.0,
    "backup_speed": 10.0,
}
METADATA_BEFORE_TIME = [
    "file_count",
    "total_size_bytes",
    "compressed_size_bytes",
    "compression_ratio",
    "deduplication_ratio",
    "backup_duration_seconds",
    "throughput_mbps",
]
METADATA_AFTER_TIME = [
    "cpu_usage_percent",
    "memory_usage_percent",
    "disk_io_rate",
    "network_utilization",
    "error_count",
    "retry_count",
    "checksum_failures",
    "file_type_diversity",
    "average_file_size",
    "modified_files_ratio",
    "new_files_ratio",
]
# Training defaults and current-state defaults of the window model's inputs.
WINDOW_TRAINING = {"system_load": 0.0, "user_activity": 0.0, "backup_success_rate": 1.0, "resource_availability": 1.0}
WINDOW_CURRENT = {"system_load": 0.5, "user_activity": 0.3, "backup_success_rate": 0.95, "resource_availability": 0.8}


def _or_default(df: DataFrame, name: str, default: float) -> Column:
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def backup_features(df: DataFrame) -> dict[str, Column]:
    return {n: _or_default(df, n, v) for n, v in BACKUP_FEATURES.items()}


def health_features(df: DataFrame, training: bool = False) -> dict[str, Column]:
    """Missing readings count as zero in training and as a usual value when scoring."""
    return {n: _or_default(df, n, 0.0 if training else v) for n, v in HEALTH_FEATURES.items()}


def metadata_features(df: DataFrame, as_of: Column | None = None) -> dict[str, Column]:
    """22 features of a backup; missing values are zero, a missing time is `as_of`."""
    ts = F.col("timestamp") if "timestamp" in df.columns else as_of
    if as_of is not None:
        ts = F.coalesce(ts, as_of)
    calendar = time_features(ts)
    out = {n: _or_default(df, n, 0.0) for n in METADATA_BEFORE_TIME}
    out |= {n: calendar[n].cast("double") for n in ["hour", "day_of_week", "day_of_month", "month"]}
    return out | {n: _or_default(df, n, 0.0) for n in METADATA_AFTER_TIME}


def window_features(df: DataFrame, ts: str = "timestamp", defaults: dict[str, float] = WINDOW_TRAINING) -> dict[str, Column]:
    """15 features of an hour: calendar, cyclical, and the state of system and user."""
    at = F.col(ts)
    out = {n: c.cast("double") for n, c in time_features(at).items()} | cyclical_features(at)
    return out | {n: _or_default(df, n, v) for n, v in defaults.items()}


def with_features(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    return df.withColumns(features)


def assemble(df: DataFrame, names: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol=output, handleInvalid="keep").transform(df)


def standardise(df: DataFrame, names: Sequence[str], fitted_on: DataFrame | None = None, suffix: str = "_scaled") -> DataFrame:
    """Zero mean and unit population deviation; a constant feature becomes zero."""
    source = df if fitted_on is None else fitted_on
    stats = source.agg(
        *[F.avg(n).alias(f"_{n}_mean") for n in names], *[F.stddev_pop(n).alias(f"_{n}_std") for n in names]
    )
    # One-row right side.
    joined = df.join(F.broadcast(stats), F.lit(True), "left")
    scaled = {
        f"{n}{suffix}": (F.col(n) - F.col(f"_{n}_mean"))
        / F.when(F.col(f"_{n}_std") > 0, F.col(f"_{n}_std")).otherwise(F.lit(1.0))
        for n in names
    }
    return joined.withColumns(scaled).drop(*[f"_{n}_{k}" for n in names for k in ("mean", "std")])


def range_of(df: DataFrame, name: str) -> DataFrame:
    """One row with the target's least and greatest value."""
    return df.agg(F.min(name).alias("_least"), F.max(name).alias("_most"))


def to_unit(value: Column, least: Column, most: Column) -> Column:
    return (value - least) / F.when(most > least, most - least).otherwise(F.lit(1.0))


def from_unit(value: Column, least: Column, most: Column) -> Column:
    return value * F.when(most > least, most - least).otherwise(F.lit(1.0)) + least


def split(df: DataFrame, key: Column, seed: int = 42, train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a digest of their key: the same rows whatever the partitioning."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return df.filter(bucket < train_percent), df.filter(bucket >= train_percent)


def horizon(current: DataFrame, start: Column, hours: int = 24) -> DataFrame:
    """The next hours beside each row of current values."""
    end = start + F.make_interval(hours=F.lit(hours - 1))
    return current.withColumn("timestamp", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))))
